"""Readers and writers: corpora of files, reports, plans and repository lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from codeloom.functions.text import decode
from codeloom.operators.corpus import SOURCE_EXTENSION

DETAIL = "Program string, Round string, ErrorType string, ErrorCategory string, FailureReason string, TranslationTime string, CompileTime string, RuntimeTime string, ValidationTime string, RepairTime string, GeneratedTestCount string, PassedTestCount string"
SKIP_LIST = S.MapType(S.StringType(), S.StringType())


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, content, length, text) of every C++ source below ``root``; nothing below .git is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    good = F.rlike(F.lower("path"), F.lit(SOURCE_EXTENSION)) & ~F.contains("path", F.lit("/.git/"))
    base = root.rstrip("/").split("://")[-1]
    rel = F.expr(f"substring(path, locate({json.dumps(base)}, path) + {len(base) + 1})")
    return files.where(good).select("path", rel.alias("rel"), "content", "length", decode(F.col("content")).alias("text"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, length) of all files, without their contents: the column is pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    return files.select("path", F.expr(f"substring(path, locate({json.dumps(base)}, path) + {len(base) + 1})").alias("rel"), "length")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A report with a header, every cell a string; a missing file is an empty report."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema or S.StructType([]))
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).option("mode", "PERMISSIVE")
    return reader.csv(path)


def write_report(df: DataFrame, path: str, single: bool = True, mode: str = "overwrite") -> None:
    """A report with a header. One file only where the report is small by its nature."""
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    (rows.coalesce(1) if single else rows).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_dataset(programs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The numbered data set, one row per program; never over an older one."""
    programs.write.mode(mode).parquet(path)


def archive_name(limit: int | None, repair: bool) -> str:
    return f"EXP_{limit if limit else 'ALL'}" + "_REPAIR" * repair


def archive_name_column(limit: Column, repair: Column) -> Column:
    """The same of columns; a limit of 0 or null is none."""
    number = F.when(limit != 0, limit.cast("string"))
    return F.concat(F.lit("EXP_"), F.coalesce(number, F.lit("ALL")), F.when(repair, "_REPAIR").otherwise(""))


def archive(df: DataFrame, root: str, limit: int | None, repair: bool) -> str:
    """Results under their experiment's name; an archive is not overwritten."""
    path = f"{root.rstrip('/')}/{archive_name(limit, repair)}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    """(category, url) of a list with two fields a line; comments and blank lines are left out."""
    line = F.trim("value")
    parts = F.split(line, r"\s+")
    return spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#")) & (F.size(parts) >= 2)).select(F.get(parts, F.lit(0)).alias("category"), F.get(parts, F.lit(1)).alias("url"))


def clone_status(code, message):
    """Column: what became of a clone, by its code and message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(code == 0, "success").when(F.contains(low, F.lit("already exists")), "exists").when(F.contains(low, F.lit("not found")) | F.contains(low, F.lit("404")), "404").otherwise("error")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """One row per experiment of a JSON plan, with its place in it. YAML is read on the driver, where the library is there."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        with open(path, encoding="utf-8") as f:
            plan = yaml.safe_load(f)
    else:
        plan = json.loads("\n".join(r.value for r in spark.read.text(path).toLocalIterator()))
    if not isinstance(plan, dict) or not isinstance(plan.get("experiments"), list):
        raise ValueError("a plan needs a list named experiments")
    rows = [(i, json.dumps(e)) for i, e in enumerate(plan["experiments"])]
    schema = "limit string, repair boolean, runtime boolean, workers int, repository string, seed int"
    return spark.createDataFrame(rows, "place int, e string").select("place", F.from_json("e", schema).alias("e")).select("place", "e.*")


def read_skip_list(spark: SparkSession, path: str) -> DataFrame:
    """(program, reason, count, stage, first_seen, last_seen) of a JSON map; entries of the old form, a bare reason, count once."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "program string, reason string, count int, stage string, first_seen string, last_seen string")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", SKIP_LIST)).alias("program", "v"))
    entry = F.from_json("v", "reason string, count int, stage string, first_seen string, last_seen string")
    old = F.col("v").isNotNull() & ~F.startswith("v", F.lit("{"))
    return rows.select("program", F.when(old, F.col("v")).otherwise(entry["reason"]).alias("reason"), F.when(old, 1).otherwise(F.coalesce(entry["count"], F.lit(1))).alias("count"), entry["stage"].alias("stage"), entry["first_seen"].alias("first_seen"), entry["last_seen"].alias("last_seen"))


def latest_in_listing(paths: DataFrame) -> DataFrame:
    """(run, results) of a listing (path below the root): the last run by name that has a csv folder or, flat, a results file; and the
    folder its results are in. One aggregate over however many files."""
    parts = F.split("path", "/")
    rows = paths.select(F.get(parts, F.lit(0)).alias("run"), (F.get(parts, F.lit(1)) == "csv").alias("csv"), (F.size(parts) == 2) & (F.get(parts, F.lit(1)) == "experiment_results.csv"))
    rows = rows.toDF("run", "csv", "flat").where("csv or flat").select("run", (F.col("csv") & F.lit(True)).alias("csv"))
    last = rows.agg(F.max(F.struct("run", "csv")).alias("r"))
    return last.select("r.run", F.when(F.col("r.csv"), F.concat_ws("/", "r.run", F.lit("csv"))).otherwise(F.col("r.run")).alias("results"))


def latest_run(spark: SparkSession, root: str) -> str | None:
    """The same for a folder of any file system: names are looked at from the last one on until a run has results."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path(root)):
        return None
    for name in sorted((f.getPath().getName() for f in files.listStatus(path(root)) if f.isDirectory()), reverse=True):
        run = f"{root.rstrip('/')}/{name}"
        if files.exists(path(f"{run}/csv")) or files.exists(path(f"{run}/experiment_results.csv")):
            return run
    return None


def latest(runs: DataFrame) -> DataFrame:
    """The same over a listing (name, has_results), as one aggregate."""
    return runs.where("has_results").agg(F.max("name").alias("name"))


def append_cache(entries: DataFrame, path: str, keys: list[str]) -> None:
    """New entries of a cache on disk: keys that it has are left as they are."""
    spark = entries.sparkSession
    fresh = entries.dropDuplicates(keys)
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
