"""Queries over readers, writers and names of files, and the SQL that checks them. Files are written below the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import fixed as X
from codeloom.lineage import ensure_checkpoint_dir
from codeloom.operators import control as K
from codeloom.operators import testgen as G
from codeloom.plans.corpus import table
from codeloom.sources import files as S

REPORT = ("RepositoryName", "RepositoryOwner", "RepositoryURL", "DatasetSource", "CppFiles", "HeaderFiles", "TotalLOC", "ReadmeExists", "LastCommit")


def _place(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written with a header and read again: every cell is a string."""
    path = _place(spark, "report")
    S.write_report(table(spark, sf_dir, "repository_statistics").select(*REPORT), path)
    return S.read_report(spark, path)


def compile_report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiler's messages through a report in as many files as there are partitions: quotes and line ends survive."""
    path = _place(spark, "report")
    rows = table(spark, sf_dir, "compile_report").select("File", "Status", F.regexp_replace("Stderr", "\r\n?", "\n").alias("Stderr"), "WarningCount", "OriginalPath")
    S.write_report(rows, path, single=False)
    out = S.read_report(spark, path)
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that is not there is an empty one."""
    return S.read_report(spark, f"{sf_dir}/no_such_report.csv", "Metric string, Value string").agg(F.count("*").alias("n"))


def repository_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and addresses out of a list with comments, blank lines, and lines with too few fields."""
    path = _place(spark, "list")
    rows = table(spark, sf_dir, "repository_statistics")
    line = F.concat_ws("\t ", F.regexp_replace("DatasetSource", r"\s+", "-"), F.col("RepositoryURL"))
    lines = rows.select(F.explode(F.array(F.concat(F.lit("# "), line), F.lit("  "), F.concat(F.lit("  "), line, F.lit("  ")))).alias("value"))
    lines.write.text(path)
    return S.read_repositories(spark, path)


def clone_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the codes and messages of the reports would say about clones."""
    rows = table(spark, sf_dir, "compile_report").select("ReturnCode", F.coalesce("Stderr", F.lit("")).alias("message"))
    return rows.groupBy("ReturnCode", S.clone_status(F.col("ReturnCode"), F.col("message")).alias("status")).agg(F.count("*").alias("n"))


def skip_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skip list as a JSON map: entries with counts, and of the old form with a bare reason."""
    path = _place(spark, "skips")
    rows = table(spark, sf_dir, "repository_statistics").where("RepositoryName is not null")
    entry = F.to_json(F.struct(F.col("DatasetSource").alias("reason"), F.col("CppFiles").alias("count"), F.lit("compile").alias("stage"), F.col("LastCommit").alias("first_seen")))
    value = F.when(F.col("HeaderFiles") % 2 == 0, entry).otherwise(F.concat(F.lit('"old '), F.col("HeaderFiles"), F.lit('"')))
    # One JSON document is one row by its form.
    one = rows.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), "RepositoryName", F.lit('":'), value)), ","), F.lit("}")).alias("value"))
    one.write.text(path)
    return S.read_skip_list(spark, path)


def plan_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of experiments as JSON, read and expanded to commands."""
    path = _place(spark, "plan")
    rows = table(spark, sf_dir, "repository_statistics").where("RepositoryName is not null")
    experiment = F.to_json(F.struct(F.col("CppFiles").cast("string").alias("limit"), F.col("ReadmeExists").alias("repair"), (F.col("CppFiles") % 4).cast("int").alias("workers"), F.col("RepositoryName").alias("repository")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("RepositoryName", experiment.alias("e")))), lambda r: r["e"])
    rows.agg(F.concat(F.lit('{"experiments": ['), F.array_join(ordered, ", "), F.lit("]}")).alias("value")).write.text(path)
    return K.plan_commands(S.read_plan(spark, path)).select(F.col("place").cast("bigint").alias("place"), "arguments")


def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of each experiment: by its limit, and whether it repairs."""
    rows = table(spark, sf_dir, "repository_statistics")
    limit = F.when(F.col("CppFiles") % 3 != 0, F.col("CppFiles"))
    return rows.select("RepositoryName", S.archive_name_column(limit, F.col("ReadmeExists")).alias("archive"))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of run folders: what each has depends on its rows."""
    runs = table(spark, sf_dir, "experiment_results").groupBy("RunId").agg(F.count("*").alias("n"))
    file = F.when(F.col("n") % 3 == 0, "csv/detail.csv").when(F.col("n") % 3 == 1, "experiment_results.csv").otherwise("logs/run.log")
    return runs.select(F.concat_ws("/", F.col("RunId"), file).alias("path"))


def latest_run_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_in_listing(_listing(spark, sf_dir))


def texts_that_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are small enough for an input, by kind."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.groupBy("doc_kind").agg(F.count_if(G.fits(F.col("text"))).alias("fitting"), F.count("*").alias("n"))


def answered_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read as answers of a model: cases between dashes."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.size(G.model_cases(F.col("text"))).alias("cases"), F.get(G.model_cases(F.col("text")), F.lit(0)).alias("first"))


QUERIES = (report_round_trip, compile_report_round_trip, missing_report, repository_list, clone_outcomes, skip_list_file, plan_file, archive_names, latest_run_with_results, texts_that_fit, answered_cases)

_SPACE = " || ".join(f"chr({ord(c)})" for c in X.WHITE_SPACE)

SQL = {
    "report_round_trip": "SELECT " + ", ".join(f"{c}::VARCHAR AS {c}" for c in REPORT) + " FROM repository_statistics",
    "compile_report_round_trip": r"WITH r AS (SELECT File, Status, nullif(regexp_replace(Stderr, '\r\n?', chr(10), 'g'), '') AS Stderr, WarningCount::VARCHAR AS WarningCount, OriginalPath FROM compile_report) SELECT File, Status, Stderr, WarningCount, OriginalPath, count(*) AS n FROM r GROUP BY ALL",
    "missing_report": "SELECT 0::BIGINT AS n",
    "repository_list": r"SELECT regexp_replace(DatasetSource, '\s+', '-', 'g') AS category, RepositoryURL AS url FROM repository_statistics WHERE DatasetSource IS NOT NULL AND RepositoryURL IS NOT NULL",
    "clone_outcomes": "WITH r AS (SELECT ReturnCode, lower(coalesce(Stderr, '')) AS m FROM compile_report) SELECT ReturnCode, CASE WHEN ReturnCode = 0 THEN 'success' WHEN contains(m, 'already exists') THEN 'exists' WHEN contains(m, 'not found') OR contains(m, '404') THEN '404' ELSE 'error' END AS status, count(*) AS n FROM r GROUP BY ALL",
    "skip_list_file": "SELECT RepositoryName AS program, CASE WHEN HeaderFiles % 2 = 0 THEN DatasetSource ELSE 'old ' || HeaderFiles END AS reason, CASE WHEN HeaderFiles % 2 = 0 THEN coalesce(CppFiles, 1) ELSE 1 END AS count, CASE WHEN HeaderFiles % 2 = 0 THEN 'compile' END AS stage, CASE WHEN HeaderFiles % 2 = 0 THEN LastCommit END AS first_seen, NULL::VARCHAR AS last_seen FROM repository_statistics WHERE RepositoryName IS NOT NULL",
    "plan_file": "SELECT row_number() OVER (ORDER BY RepositoryName) - 1 AS place, concat_ws(' ', '--limit', coalesce(CppFiles::VARCHAR, 'all'), '--workers', coalesce(CppFiles % 4, 1)::VARCHAR, CASE WHEN ReadmeExists THEN '--repair' END, '--repository ' || RepositoryName) AS arguments FROM repository_statistics WHERE RepositoryName IS NOT NULL",
    "archive_names": "SELECT RepositoryName, 'EXP_' || CASE WHEN CppFiles % 3 <> 0 AND CppFiles <> 0 THEN CppFiles::VARCHAR ELSE 'ALL' END || CASE WHEN ReadmeExists THEN '_REPAIR' ELSE '' END AS archive FROM repository_statistics",
    "latest_run_with_results": "WITH r AS (SELECT RunId, count(*) AS n FROM experiment_results WHERE RunId IS NOT NULL GROUP BY 1) SELECT max(RunId) AS run, arg_max(CASE WHEN n % 3 = 0 THEN RunId || '/csv' ELSE RunId END, RunId) AS results FROM r WHERE n % 3 < 2",
    "texts_that_fit": f"SELECT doc_kind, count(*) FILTER (length(text) <= {X.MAX_INPUT_SIZE}) AS fitting, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "answered_cases": f"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, '---'), lambda x: trim(x, {_SPACE})), lambda x: x <> '') AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(c)::INT AS cases, c[1] AS first FROM s",
}
