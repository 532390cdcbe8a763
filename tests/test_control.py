import os

import pytest
from pyspark.sql import functions as F

from codeloom.operators import control as K
from codeloom.operators import report as R
from codeloom.plans import control as P


def test_banners(spark):
    rows = spark.createDataFrame([("g++ (Ubuntu) 13.2.0",), ("Apple clang version 15.0.0 (x)",), ("Microsoft C",), (None,)], "b string").select(K.compiler_family(F.col("b")), K.compiler_version(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("gcc", "13.2.0"), ("clang", "15.0.0"), ("msvc", None), ("unknown", None)]


def test_plan_commands(spark):
    plan = spark.createDataFrame([(0, "5", True, False, 2, "r", 0), (1, None, False, None, None, None, 3)], "place int, limit string, repair boolean, runtime boolean, workers int, repository string, seed int")
    got = {r.place: (r.label, r.arguments) for r in K.plan_commands(plan, 4).collect()}
    assert got == {0: ("limit=5 repair repository=r", "--limit 5 --workers 2 --repair --repository r"), 1: ("limit=all", "--limit all --workers 4 --seed 3")}
    assert K.plan_commands(plan).where("place = 1").first().arguments.startswith("--limit all --workers 1")


def test_until_failure(spark):
    df = spark.createDataFrame([(0, True), (1, False), (2, True)], "place int, ok boolean")
    assert K.until_failure(df).count() == 2 and K.until_failure(df, True).count() == 3 and K.until_failure(df.where("ok")).count() == 2


def test_skips(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "program string, ts int, reason string")
    failures = K.failures_by_program(log)
    assert {(r.program, r["count"], r.reason) for r in failures.collect()} == {("a", 2, "y"), ("b", 1, "z")}
    programs = spark.createDataFrame([("a",), ("b",), ("c",)], "ProgramID string")
    assert {r[0] for r in K.without_skipped(programs, failures).collect()} == {"b", "c"}
    assert [r[0] for r in K.limited(programs, 2).collect()] == ["a", "b"] and K.limited(programs, 0).count() == 3
    assert K.sampled(programs.repartition(3), 2, 1).collect() == K.sampled(programs, 2, 1).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_skip_lists_of_all_rounds(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/experiment_results.parquet").select("Program", "FinishedAt", "FailureReason").collect()
    times = {}
    for program, ts, reason in rows:
        if reason not in (None, "", "None"):
            times.setdefault(program, []).append(ts)
    got = {r.program: r for r in P.skip_list(spark, sf_dir).collect()}
    assert set(got) == set(times)
    for program, seen in times.items():
        known = [t for t in seen if t is not None]
        assert (got[program]["count"], got[program].first_seen, got[program].last_seen) == (len(seen), min(known, default=None), max(known, default=None))
    every = {r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark_dataset.parquet").select("ProgramID").collect()}
    assert {r[0] for r in P.not_skipped(spark, sf_dir).collect()} == {p for p in every if len(times.get(p, [])) < 2}


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 1.0, None)], "k string, v double, n int")
    assert "| a\\|b | 1.00 | N/A |" in R.markdown(df, "T") and "k  a|b" in R.text(df, "T")
    with pytest.raises(ValueError):
        R.markdown(spark.range(5), "T", 4)
    assert [R.duration(x) for x in (3723, 123, 3, None, -1)] == ["1h02m03s", "2m03s", "3s", "N/A", "N/A"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_experiment_report(spark):
    summary, detail = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("summary_results", "experiment_results"))
    text = R.experiment_report(summary, detail, {"workers": 4, "repair": None}, "Run 1")
    assert text.startswith("# Run 1\n") and "| workers | 4 |" in text and "| repair | N/A |" in text
    assert [line for line in text.split("\n") if line.startswith("## ")] == ["## Configuration", "## Results", "## Stages", "## Errors", "## Repair rounds"]
    assert text.count("| Avg ") == 10
