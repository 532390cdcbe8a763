"""Differential tests as joins and aggregates over one row per program and test case.

Facts have the columns program, test_index, test_input, expected (null: take the oracle's output), oracle_ok, oracle_output,
candidate_ok, candidate_output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import fixed as X
from codeloom.functions.text import strip
from codeloom.lineage import checkpointed


def judge(facts: DataFrame) -> DataFrame:
    """Adds ``passed`` and ``verdict``. A case whose oracle failed is skipped; outputs are compared without white space at
    their ends; a given expectation goes before the oracle's output, but the oracle must have run all the same."""
    want = strip(F.coalesce("expected", "oracle_output", F.lit("")))
    equal = want == strip(F.coalesce("candidate_output", F.lit("")))
    passed = F.col("oracle_ok") & F.col("candidate_ok") & equal
    verdict = F.when(~F.col("oracle_ok"), "skipped").when(~F.col("candidate_ok"), "crash").when(equal, "pass").otherwise("mismatch")
    return facts.withColumn("passed", F.coalesce(passed, F.lit(False))).withColumn("verdict", verdict)


def report(results: DataFrame) -> DataFrame:
    """One row per program with its counts, whether all passed, and the one-line summary."""
    one = results.groupBy("program").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if("oracle_ok").alias("validated"))
    one = one.withColumn("oracle_failures", F.col("total") - F.col("validated")).withColumn("failed", F.col("validated") - F.col("passed"))
    one = one.withColumn("all_passed", (F.col("validated") > 0) & (F.col("failed") == 0)).withColumn("oracle_failed", (F.col("total") > 0) & (F.col("validated") == 0))
    text = F.concat(
        F.lit("Differential Testing: "), F.col("passed"), F.lit("/"), F.col("validated"), F.lit(" passed"),
        F.when(F.col("failed") > 0, F.concat(F.lit(", "), F.col("failed"), F.lit(" FAILED"))).otherwise(""),
        F.when(F.col("oracle_failures") > 0, F.concat(F.lit(", "), F.col("oracle_failures"), F.lit(" skipped (oracle failed)"))).otherwise(""),
    )
    return one.withColumn("summary", F.when(F.col("validated") == 0, "Differential Testing: no cases could be validated (oracle failed)").otherwise(text))


def failures(results: DataFrame) -> DataFrame:
    return results.where(F.col("oracle_ok") & ~F.col("passed")).select("program", "test_index", "test_input", "verdict")


def representatives(failed: DataFrame, most: int = X.MAX_COMPACT_FAILURES, seed: int = 42, drawn: int = 2) -> DataFrame:
    """(program, test_index, reason): every failure where there are at most ``most``; else the first, the shortest and the
    longest input and ``drawn`` others by a hash. Of equally long inputs the last index counts as the longest, the first
    as the shortest. Picks are aggregates, so no program's failures are gathered."""
    slim = failed.select("program", F.col("test_index").alias("i"), F.length("test_input").alias("len"), F.md5(F.concat_ws(":", "program", "test_index", F.lit(seed))).alias("h"))
    slim = checkpointed(slim)
    sizes = slim.groupBy("program").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    both = slim.join(sizes, "program")
    few = both.where(F.col("n") <= most).select("program", "i", F.lit("all").alias("reason"))
    many = both.where(F.col("n") > most)
    # Two picks in one aggregate: with more than one failure left, the shortest and the longest are never the same.
    picks = many.where("i <> first").groupBy("program", "first").agg(F.min(F.struct("len", "i"))["i"].alias("shortest"), F.max(F.struct("len", "i"))["i"].alias("longest"))
    out = few.unionByName(picks.unpivot("program", ["first", "shortest", "longest"], "reason", "i").select("program", "i", "reason"))
    left = many.join(picks.drop("first"), "program").where("i not in (first, shortest, longest)").select("program", "i", "h") if drawn else None
    for _ in range(drawn):
        pick = checkpointed(left.groupBy("program").agg(F.min(F.struct("h", "i"))["i"].alias("i")))
        left = left.join(pick.withColumnRenamed("i", "_i"), "program").where("i <> _i").drop("_i")
        out = out.unionByName(pick.withColumn("reason", F.lit("drawn")))
    return out.withColumnRenamed("i", "test_index")


def first_failures(failed: DataFrame, n: int = X.MAX_DETAILED_FAILURES) -> DataFrame:
    """The first ``n`` failures of each program. Each salted part keeps its own first ones before they are ranked together,
    so a program with very many failures is no single sort."""
    from pyspark.sql import Window

    salted = failed.withColumn("_s", F.pmod(F.xxhash64("test_index"), F.lit(16)))
    part = Window.partitionBy("program", "_s").orderBy("test_index")
    small = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
    whole = Window.partitionBy("program").orderBy("test_index")
    return small.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n).drop("_s", "_r")


def distinct_runs(facts: DataFrame, source: str, given: str) -> DataFrame:
    """One row per (hash of source, hash of input): what has to be run once, with how many cases wait for it."""
    return facts.groupBy(F.sha2(F.col(source).cast("binary"), 256).alias("source_sha"), F.sha2(F.col(given).cast("binary"), 256).alias("input_sha")).agg(F.count("*").alias("cases"))


def quoted(c: Column) -> Column:
    """Text in quotes as Python would write it: single quotes unless only they are inside; the usual escapes."""
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    out = c
    for raw, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escape))
    return F.when(double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def failure_lines(failed: DataFrame, n: int = X.MAX_DETAILED_FAILURES) -> DataFrame:
    """(program, lines): the first failures as text, one line each with a quoted input."""
    line = F.concat(F.lit("#"), F.col("test_index"), F.lit(" "), F.col("verdict"), F.lit(" input="), quoted(F.col("test_input")))
    rows = first_failures(failed, n).select("program", F.struct("test_index", line.alias("line")).alias("r"))
    return rows.groupBy("program").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n").alias("lines"))


def compact_summary(results: DataFrame, most: int = X.MAX_COMPACT_FAILURES, seed: int = 42, drawn: int = 2) -> DataFrame:
    """(program, text): the representative failures of each program, with input, expected and given output, as a repair prompt has
    them; or that all tests passed. At most ``most`` failures of a program are gathered, by definition."""
    failed = results.where(F.col("oracle_ok") & ~F.col("passed"))
    chosen = representatives(failed.select("program", "test_index", "test_input"), most, seed, drawn).select("program", "test_index")
    expected = F.coalesce("expected", "oracle_output", F.lit(""))
    line = F.concat(F.lit("  Test "), F.col("test_index"), F.lit(": input="), quoted(strip("test_input")), F.lit(" | expected="), quoted(expected), F.lit(" | got="), quoted(F.coalesce("candidate_output", F.lit(""))))
    shown = failed.join(chosen, ["program", "test_index"]).groupBy("program").agg(F.sort_array(F.collect_list(F.struct("test_index", line.alias("line")))).alias("r"))
    counts = results.groupBy("program").agg(F.count_if(F.col("oracle_ok") & ~F.col("passed")).alias("failed"), F.count_if(~F.col("oracle_ok")).alias("skipped"))
    n = F.size("r")
    head = F.concat(F.lit("FAILED TEST CASES ("), n, F.lit(" shown of "), F.col("failed"), F.lit(" total):"))
    more = F.when(F.col("failed") > n, F.concat(F.lit("  ... ("), F.col("failed") - n, F.lit(" more failures omitted — the "), n, F.lit(" most representative are shown above)")))
    fine = F.when(F.col("skipped") > 0, F.concat(F.lit("All validated tests passed ("), F.col("skipped"), F.lit(" oracle failures skipped)."))).otherwise("All tests passed.")
    text = F.when(F.col("failed") == 0, fine).otherwise(F.concat_ws("\n", head, F.array_join(F.transform("r", lambda r: r["line"]), "\n"), more))
    return counts.join(shown, "program", "left").select("program", text.alias("text"))
