"""Queries about the control of runs, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import control as K
from codeloom.plans.corpus import table

RAW_ROOT = "/srv/datasets/"


def compiler_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "compile_report").select(F.concat_ws(" ", "Compiler", F.lit("(build)"), "CompilerVersion").alias("banner"))
    return rows.groupBy("banner").agg(F.count("*").alias("n")).select("banner", "n", K.compiler_family(F.col("banner")).alias("family"), K.compiler_version(F.col("banner")).alias("version"))


def original_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files whose originals are known to the compile reports."""
    raw = table(spark, sf_dir, "raw_sources").select("File")
    return K.original_paths(raw, table(spark, sf_dir, "compile_report").select(F.col("OriginalPath").alias("path")), RAW_ROOT)


def plan_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan with one experiment per repository."""
    rows = table(spark, sf_dir, "repository_statistics")
    size = F.col("CppFiles")
    plan = rows.select(F.col("RepositoryName").alias("place"), F.when(size % 3 != 0, size.cast("string")).alias("limit"), F.col("ReadmeExists").alias("repair"), (size % 2 == 0).alias("runtime"), F.when(size % 5 != 0, size % 5).cast("int").alias("workers"), F.when(size % 7 != 0, F.col("RepositoryName")).alias("repository"), (size % 4).cast("int").alias("seed"))
    return K.plan_commands(plan, 4)


def plan_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments up to the first failure: the customers in their order, those with a debt of over 900 fail."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), (F.col("c_acctbal") > -900).alias("ok"))
    return K.until_failure(rows).agg(F.count("*").alias("run"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failures, in whatever round."""
    rows = table(spark, sf_dir, "experiment_results")
    return rows.where("FailureReason not in ('', 'None')").select(F.col("Program").alias("program"), F.col("FinishedAt").alias("ts"), F.col("FailureReason").alias("reason"))


def skip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.failures_by_program(_log(spark, sf_dir))


def not_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.without_skipped(table(spark, sf_dir, "benchmark_dataset").select("ProgramID"), K.failures_by_program(_log(spark, sf_dir)))


def repository_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.of_repositories(table(spark, sf_dir, "benchmark_dataset").select("ProgramID", "Repository"), ["contest-archive", "unknown"])


def limited_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's limit of 25 programs."""
    return K.limited(table(spark, sf_dir, "benchmark_dataset").select("ProgramID"), 25)


def sampled_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run on 25 programs drawn with a seed."""
    return K.sampled(table(spark, sf_dir, "benchmark_dataset").select("ProgramID"), 25, 7)


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named sums of a run, as a logger counts them."""
    rows = table(spark, sf_dir, "experiment_results")
    return rows.groupBy("RunId", F.coalesce(F.lower(F.trim("ErrorCategory")), F.lit("none")).alias("label")).agg(F.count("*").alias("n"), F.sum(F.coalesce("PassedTestCount", F.lit(0))).alias("passed_tests"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run by name that has results."""
    return table(spark, sf_dir, "experiment_results").agg(F.max("RunId").alias("run"))


QUERIES = (compiler_banners, original_paths, plan_expansion, plan_outcome, skip_list, not_skipped, repository_filter, limited_programs, sampled_programs, run_counters, latest_run)

_LOG = "f AS (SELECT Program AS program, FinishedAt AS ts, FailureReason AS reason FROM experiment_results WHERE FailureReason NOT IN ('', 'None')), s AS (SELECT program, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen FROM f GROUP BY 1)"
SQL = {
    "compiler_banners": r"WITH b AS (SELECT concat_ws(' ', Compiler, '(build)', CompilerVersion) AS banner, count(*) AS n FROM compile_report GROUP BY 1) SELECT banner, n, CASE WHEN contains(lower(banner), 'clang') THEN 'clang' WHEN contains(lower(banner), 'g++') OR contains(lower(banner), 'gcc') THEN 'gcc' WHEN contains(lower(banner), 'microsoft') THEN 'msvc' ELSE 'unknown' END AS family, nullif(regexp_extract(banner, '(\d+\.\d+\.\d+)', 1), '') AS version FROM b",
    "original_paths": f"WITH p AS (SELECT File, CASE WHEN '{RAW_ROOT}' || File IN (SELECT OriginalPath FROM compile_report WHERE OriginalPath IS NOT NULL) THEN '{RAW_ROOT}' || File ELSE File END AS path FROM raw_sources) SELECT File, path, regexp_replace(path, '/?[^/]*$', '') AS directory FROM p",
    "plan_expansion": """WITH p AS (SELECT RepositoryName AS place, coalesce(CASE WHEN CppFiles % 3 <> 0 THEN CppFiles::VARCHAR END, 'all') AS lim, ReadmeExists AS repair, CppFiles % 2 = 0 AS runtime, coalesce(CASE WHEN CppFiles % 5 <> 0 THEN CppFiles % 5 END, 4, 1) AS workers, CASE WHEN CppFiles % 7 <> 0 THEN RepositoryName END AS repository, CppFiles % 4 AS seed FROM repository_statistics)
      SELECT place, concat_ws(' ', 'limit=' || lim, CASE WHEN repair THEN 'repair' END, CASE WHEN runtime THEN 'runtime' END, 'repository=' || repository) AS label,
      concat_ws(' ', '--limit', lim, '--workers', workers::VARCHAR, CASE WHEN repair THEN '--repair' END, CASE WHEN runtime THEN '--runtime' END, '--repository ' || repository, CASE WHEN seed <> 0 THEN '--seed ' || seed END) AS arguments FROM p""",
    "plan_outcome": "WITH o AS (SELECT c_custkey AS place, c_acctbal > -900 AS ok FROM customer), s AS (SELECT min(place) AS stop FROM o WHERE NOT ok) SELECT count(*) AS run, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM o, s WHERE stop IS NULL OR place <= stop",
    "skip_list": f"WITH {_LOG}, l AS (SELECT program, reason FROM f QUALIFY row_number() OVER (PARTITION BY program ORDER BY ts DESC NULLS LAST, reason DESC) = 1) SELECT program, count, first_seen, last_seen, reason FROM s JOIN l USING (program)",
    "not_skipped": f"WITH {_LOG} SELECT ProgramID FROM benchmark_dataset WHERE ProgramID NOT IN (SELECT program FROM s WHERE count >= 2 AND program IS NOT NULL)",
    "repository_filter": "SELECT ProgramID, Repository FROM benchmark_dataset WHERE Repository IN ('contest-archive', 'unknown')",
    "limited_programs": "SELECT ProgramID FROM benchmark_dataset ORDER BY 1 LIMIT 25",
    "sampled_programs": "SELECT ProgramID FROM benchmark_dataset ORDER BY md5(ProgramID || ':7'), ProgramID LIMIT 25",
    "run_counters": "SELECT RunId, coalesce(lower(trim(ErrorCategory)), 'none') AS label, count(*) AS n, sum(coalesce(PassedTestCount, 0))::BIGINT AS passed_tests FROM experiment_results GROUP BY 1, 2",
    "latest_run": "SELECT max(RunId) AS run FROM experiment_results",
}
