"""Selection and control of runs, as data: which programs, which experiments, which run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compiler_family(banner: Column) -> Column:
    """The compiler by the first line of its version text."""
    low = F.lower(banner)
    return F.when(F.contains(low, F.lit("clang")), "clang").when(F.contains(low, F.lit("g++")) | F.contains(low, F.lit("gcc")), "gcc").when(F.contains(low, F.lit("microsoft")), "msvc").otherwise("unknown")


def compiler_version(banner: Column) -> Column:
    return F.nullif(F.regexp_extract(banner, r"(\d+\.\d+\.\d+)", 1), F.lit(""))


def original_paths(raw: DataFrame, listing: DataFrame, prefix: str) -> DataFrame:
    """(File, path, directory): the original of each raw file if it is still there, else the raw path itself."""
    wanted = raw.select("File", F.concat(F.lit(prefix), F.col("File")).alias("wanted"))
    there = listing.select(F.col("path").alias("wanted"), F.lit(True).alias("there")).distinct()
    path = F.when(F.col("there"), F.col("wanted")).otherwise(F.col("File"))
    return wanted.join(there, "wanted", "left").select("File", path.alias("path")).withColumn("directory", F.regexp_replace("path", "/?[^/]*$", ""))


def plan_commands(plan: DataFrame, workers: int | None = None) -> DataFrame:
    """(place, label, arguments) of a plan's experiments. An experiment's own number of workers goes before the general one,
    and that before 1; a seed of 0 counts as none."""
    limit = F.coalesce(F.nullif("limit", F.lit("")), F.lit("all"))
    number = F.coalesce("workers", F.lit(workers).cast("int"), F.lit(1))
    label = F.concat_ws(" ", F.concat(F.lit("limit="), limit), F.when(F.col("repair"), "repair"), F.when(F.col("runtime"), "runtime"), F.when(F.col("repository").isNotNull(), F.concat(F.lit("repository="), "repository")))
    arguments = F.concat_ws(
        " ", F.lit("--limit"), limit, F.lit("--workers"), number.cast("string"), F.when(F.col("repair"), "--repair"), F.when(F.col("runtime"), "--runtime"),
        F.when(F.col("repository").isNotNull(), F.concat(F.lit("--repository "), "repository")), F.when(F.col("seed") != 0, F.concat(F.lit("--seed "), F.col("seed").cast("string"))),
    )
    return plan.select("place", label.alias("label"), arguments.alias("arguments"))


def until_failure(outcomes: DataFrame, go_on: bool = False) -> DataFrame:
    """The experiments (place, ok) that run: all, or those up to the first failure. One aggregated value decides."""
    if go_on:
        return outcomes
    first = outcomes.where("not ok").agg(F.min("place").alias("_stop"))
    return outcomes.crossJoin(F.broadcast(first)).where("_stop is null or place <= _stop").drop("_stop")


def failures_by_program(log: DataFrame) -> DataFrame:
    """(program, count, first_seen, last_seen, reason) of a log (program, ts, reason); the reason is that of the last failure."""
    return log.groupBy("program").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max(F.struct("ts", "reason"))["reason"].alias("reason"))


def without_skipped(programs: DataFrame, failures: DataFrame, key: str = "ProgramID", threshold: int = 2) -> DataFrame:
    """Programs that failed fewer than ``threshold`` times, whether or not in a row."""
    bad = failures.where(F.col("count") >= threshold).select(F.col("program").alias(key))
    return programs.join(bad, key, "left_anti")


def of_repositories(programs: DataFrame, names: list[str], column: str = "Repository") -> DataFrame:
    return programs.where(F.col(column).isin(names)) if names else programs


def limited(programs: DataFrame, n: int | None, key: str = "ProgramID") -> DataFrame:
    """The first ``n`` programs by key; 0 or none is no limit."""
    return programs.orderBy(key).limit(n) if n else programs


def sampled(programs: DataFrame, n: int, seed: int, key: str = "ProgramID") -> DataFrame:
    """``n`` programs, the same for the same seed whatever the partitions: those with the least hashes."""
    return programs.orderBy(F.md5(F.concat_ws(":", key, F.lit(seed))), key).limit(n)
