"""The queries of this subpackage with SQL, and the shape of all of them, over the smallest tables."""

import glob
import os

import pytest

from codeloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
FOUND = {"p2_found": ["first_id", "copy_id"], "p3_found": ["program_id", "function_name"], "p4_found": ["program_a", "program_b"], "p5_found": ["program_a", "program_b"], "p6_found": ["original_path"], "p7_found": ["program_id", "lang"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "pii_type", "pii_text"]}


def values(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    import duckdb

    df = Q.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == FOUND.get(name, df.columns)
    if name in FOUND:
        assert len(set(rows)) == len(rows)
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        result = con.execute(Q.oracle_sql()[name])
        columns = [c[0] for c in result.description]
        assert values(rows, df.columns) == values(result.fetchall(), columns)
