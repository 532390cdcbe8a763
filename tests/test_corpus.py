from pyspark.sql import functions as F

from codeloom.operators import corpus as C

MAIN = "int main() { return 0; }\n"


def files(spark):
    rows = [
        ("/r/a/one/x/1.cpp", "a/one/x/1.cpp", MAIN),
        ("/r/a/one/x/2.CC", "a/one/x/2.CC", MAIN),
        ("/r/a/one/3.cxx", "a/one/3.cxx", "TEST(a, b) {}\n" + MAIN),
        ("/r/a/two/4.cpp", "a/two/4.cpp", '#include "here.h"\n#include "gone.h"\nint f();\n'),
        ("/r/a/two/here.h", "a/two/here.h", "int h();\n"),
        ("/r/a/two/.git/5.cpp", "a/two/.git/5.cpp", MAIN),
        ("/r/a/two/6.cpp", "a/two/6.cpp", ""),
        ("/r/a/two/README.md", "a/two/README.md", "x"),
        ("/r/a/two/7.cpp", "a/two/7.cpp", None),
    ]
    return spark.createDataFrame(rows, "OriginalPath string, File string, Content string").withColumn("path", F.lit("clash"))


def sources(spark):
    return C.sources(files(spark).drop("path"))


def test_sources_and_classes(spark):
    got = {r.path: r.program_type for r in C.classify(sources(spark)).collect()}
    assert got == {"/r/a/one/x/1.cpp": "executable", "/r/a/one/x/2.CC": "executable", "/r/a/one/3.cxx": "test", "/r/a/two/4.cpp": "library"}


def test_unresolved(spark):
    listing = files(spark).select(F.col("OriginalPath").alias("path"))
    assert [r.path for r in C.unresolved(sources(spark), listing, False).collect()] == ["/r/a/two/4.cpp"]
    assert C.unresolved(sources(spark), listing, True).count() == 0


def test_duplicates_and_summary(spark):
    hashed = C.with_hash(sources(spark))
    dup = {(r.original, r.path) for r in C.duplicates(hashed).where("not is_unique").collect()}
    assert dup == {("/r/a/one/x/1.cpp", "/r/a/one/x/2.CC")}
    got = {r.metric: r.value for r in C.dedup_summary(hashed).collect()}
    assert got == {"TotalFiles": 5.0, "UniqueFiles": 4.0, "DuplicateFiles": 1.0, "DuplicateRatio": 20.0}
    empty = {r.metric: r.value for r in C.dedup_summary(hashed.limit(0)).collect()}
    assert empty["TotalFiles"] == 0 and empty["DuplicateRatio"] == 0


def test_filter_report_counts_warnings_twice(spark):
    got = {r.metric: r.value for r in C.filter_report(C.classify(sources(spark)), C.unresolved(sources(spark), files(spark).select(F.col("OriginalPath").alias("path")), False)).collect()}
    assert got["OriginalCPPFiles"] == 5 and got["distinct_total"] == 4 and got["FilterRate"] == 40.0


def test_numbers_are_dense_over_partitions(spark):
    df = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("p"))
    rows = C.number(df, "p").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 1001))
    assert [r.p for r in rows] == sorted(r.p for r in rows)
    assert C.number(df.limit(0), "p").count() == 0


def test_owner(spark):
    urls = ["https://github.com/ann/repo.git", "https://code.x.example/bob/r", "git@host.example:carl/r.git", "unknown", "https://github.com/dot.ted/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, u string").orderBy("i").select(C.owner(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["ann", "bob", "unknown", "unknown", "unknown"]


def test_scan(spark):
    df = files(spark).withColumn("cat", F.lit("a")).withColumn("repo", F.get(F.split("File", "/"), F.lit(1)))
    got = {r.repo: r for r in C.repository_scan(df, "cat", "repo", "OriginalPath", "Content").collect()}
    assert got["two"].header_files == 1 and got["two"].readme_exists and got["two"].maximum_loc == 3
    assert got["one"].cpp_files == 3 and got["one"].total_loc == 4


def test_mapping_prefers_the_name(spark):
    raw = spark.createDataFrame([("/r/c/q/b.cpp", "c/q/b.cpp", "h"), ("/r/c/q/program_000001.cpp", "c/q/program_000001.cpp", "h"), ("/r/x.cpp", "x.cpp", "g")], "path string, File string, sha string")
    programs = spark.createDataFrame([("p1", "program_000001.cpp", "h"), ("p2", "program_000002.cpp", "h"), ("p3", "z.cpp", "none"), ("p4", "y.cpp", "g")], "ProgramID string, Filename string, sha string")
    urls = spark.createDataFrame([("q", "u")], "Repository string, GitHubURL string")
    got = {r.ProgramID: (r.OriginalPath, r.Category, r.Repository, r.GitHubURL) for r in C.source_mapping(programs, raw, urls).collect()}
    assert got == {"p1": ("c/q/program_000001.cpp", "c", "q", "u"), "p2": ("c/q/b.cpp", "c", "q", "u"), "p3": ("unknown",) * 4, "p4": ("x.cpp", "unknown", "unknown", "unknown")}


def test_copy_plan(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "rel string, length long")
    b = spark.createDataFrame([("x", 1), ("y", 9)], "rel string, length long")
    assert {r.rel: r.action for r in C.copy_plan(a, b).collect()} == {"x": "skipped", "y": "copied", "z": "copied"}
