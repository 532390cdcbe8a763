"""Experiment statistics: two engines that look alike and differ on purpose.

Engine A looks at the summary rows of programs called ``program_...`` (all rows, if there is none), counts repeated
rows as often as they come, gives percentages, and averages only values above 0. Engine B joins summary and detail
fully, counts each program once, gives fractions, and has stricter parsers.

Optional columns are resolved by the schema, not per row: if a column exists, its blanks count as blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import lenient as L

PREFIX = "program_"
_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def _pick(df: DataFrame, *names: str) -> Column:
    """The first of the columns that the schema has, else null."""
    return next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None))


def _double(df: DataFrame, *names: str) -> Column:
    kind = next((dict(df.dtypes)[n] for n in names if n in df.columns), "void")
    c = _pick(df, *names)
    return F.coalesce(c.cast("double"), F.lit(0.0)) if kind in _NUMERIC else L.to_double(c)


def _int(df: DataFrame, *names: str) -> Column:
    kind = next((dict(df.dtypes)[n] for n in names if n in df.columns), "void")
    c = _pick(df, *names)
    return F.coalesce(c.cast("bigint"), F.lit(0)) if kind in ("int", "bigint", "smallint", "tinyint") else L.to_int(c)


def _above(c: Column) -> Column:
    """The value if above 0. NaN is not."""
    return F.when((c > 0) & ~F.isnan(c.cast("double")), c)


def _mean(c: Column) -> Column:
    return F.coalesce(F.avg(_above(c)), F.lit(0.0))


def bench_rows(df: DataFrame) -> DataFrame:
    """Rows whose Program has the prefix; every row, if none has. The flag is one aggregated value, joined back."""
    flag = df.agg(F.coalesce(F.bool_or(F.startswith("Program", F.lit(PREFIX))), F.lit(False)).alias("_any"))
    keep = F.coalesce(F.startswith("Program", F.lit(PREFIX)), F.lit(False)) | ~F.col("_any")
    return df.crossJoin(F.broadcast(flag)).where(keep).drop("_any")


def rates_a(summary: DataFrame) -> DataFrame:
    rows = bench_rows(summary)
    compiled = L.to_bool(_pick(summary, "CompilePass", "FinalCompilePass"))
    final, runtime, functional = (L.to_bool(_pick(summary, n)) for n in ("FinalCompilePass", "RuntimePass", "FunctionalPass"))
    one = rows.agg(F.count("*").alias("total_programs"), F.count_if(compiled).alias("compile_pass"), F.count_if(runtime).alias("runtime_pass"), F.count_if(functional).alias("functional_pass"), F.count_if(final).alias("final_compile_pass"), F.count_if(final & runtime & functional).alias("overall_success"))
    rate = lambda c: F.col(c) * 100.0 / F.greatest("total_programs", F.lit(1))
    return one.select("*", (F.col("total_programs") - F.col("compile_pass")).alias("compile_fail"), rate("compile_pass").alias("compile_success_rate"), rate("runtime_pass").alias("runtime_success_rate"), rate("functional_pass").alias("functional_success_rate"), rate("overall_success").alias("overall_success_rate"))


def timing_a(summary: DataFrame, detail: DataFrame) -> DataFrame:
    total = _double(summary, "TotalTime")
    one = bench_rows(summary).agg(_mean(_double(summary, "TranslationTime")).alias("avg_translation_time"), _mean(_double(summary, "ValidationTime")).alias("avg_validation_time"), _mean(total).alias("avg_total_time"), F.coalesce(F.max(_above(total)), F.lit(0.0)).alias("total_experiment_time"))
    rounds = bench_rows(detail).agg(_mean(_double(detail, "CompileTime")).alias("avg_compile_time"), _mean(_double(detail, "RuntimeTime")).alias("avg_runtime_time"))
    return one.crossJoin(rounds)


def repair_a(summary: DataFrame) -> DataFrame:
    rounds = _int(summary, "RepairRounds")
    gain = F.startswith("Program", F.lit(PREFIX)) & ~L.to_bool(_pick(summary, "InitialCompilePass")) & L.to_bool(_pick(summary, "FunctionalPass"))
    return bench_rows(summary).agg(F.count(_above(rounds)).alias("programs_repaired"), _mean(rounds).alias("avg_repair_rounds"), F.coalesce(F.max(_above(rounds)), F.lit(0)).alias("max_repair_rounds"), F.count_if(gain).alias("repair_success_gain"))


def repair_distribution_a(summary: DataFrame) -> DataFrame:
    return bench_rows(summary).groupBy(_int(summary, "RepairRounds").alias("rounds")).agg(F.count("*").alias("programs"))


def tests_a(summary: DataFrame) -> DataFrame:
    mean = lambda n: _mean(_int(summary, n)).alias
    return bench_rows(summary).agg(mean("GeneratedTestCount")("avg_generated_tests"), mean("ExecutedTestCount")("avg_executed_tests"), mean("PassedTestCount")("avg_passed_tests"), (_mean(_double(summary, "SuccessRate")) * 100).alias("avg_test_success_rate"))


def tokens_a(summary: DataFrame) -> DataFrame:
    """Over all rows with prompt or completion tokens, whatever their program is called."""
    rows = summary.select(_int(summary, "PromptTokens", "prompt_tokens").alias("p"), _int(summary, "CompletionTokens", "completion_tokens").alias("c"), _int(summary, "TotalTokens", "total_tokens").alias("t")).where("p > 0 or c > 0")
    one = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "pct"])
    per = lambda c: F.col(c) / F.greatest("n", F.lit(1))
    return one.select(F.col("p").alias("total_prompt_tokens"), F.col("c").alias("total_completion_tokens"), F.col("t").alias("total_tokens"), per("p").alias("avg_prompt_tokens"), per("c").alias("avg_completion_tokens"), per("t").alias("avg_tokens"))


def errors_a(detail: DataFrame) -> DataFrame:
    """(kind, label, n): error types and categories of programs with the prefix, without fallback."""
    rows = detail.where(F.startswith("Program", F.lit(PREFIX)))
    error = _pick(detail, "ErrorType").cast("string")
    types = rows.select(error.alias("label")).where("label not in ('', 'None')").groupBy("label").agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "label", "n")
    category = _pick(detail, "ErrorCategory", "FinalErrorType").cast("string")
    categories = rows.select(category.alias("label")).where("label not in ('', 'None', 'none')").groupBy("label").agg(F.count("*").alias("n")).select(F.lit("category").alias("kind"), "label", "n")
    return types.unionByName(categories)


def _error(detail: DataFrame) -> Column:
    """The error type of a round, null for none; a table without the column has unknown errors in every round."""
    error = F.col("ErrorType") if "ErrorType" in detail.columns else F.lit("Unknown")
    return F.when((error != "") & (error != "None"), error)


def last_rows(summary: DataFrame) -> DataFrame:
    """One row per program: of repeated ones the greatest by (TotalTime, the other columns in order). Row order is not
    reproducible, so it cannot decide."""
    columns = ["TotalTime", "InitialCompilePass", "FinalCompilePass", "RuntimePass", "FunctionalPass", "RepairRounds"]
    return summary.groupBy("Program").agg(F.max(F.struct(*columns)).alias("r")).select("Program", "r.*")


def programs_b(summary: DataFrame, detail: DataFrame) -> DataFrame:
    """One row per program of either table, with sums and counts over its rounds instead of lists of them, since one
    program may have any number of rounds."""
    s = last_rows(summary).select("Program", *[L.strict_bool(F.col(a)).alias(b) for a, b in (("InitialCompilePass", "initial_compile"), ("FinalCompilePass", "final_compile"), ("RuntimePass", "runtime"), ("FunctionalPass", "functional"))], L.strict_int(F.col("RepairRounds")).alias("repair_rounds"), _double(summary, "TotalTime").alias("total_time"))
    times = [(n, _above(_double(detail, n))) for n in ("TranslationTime", "CompileTime", "RuntimeTime", "ValidationTime", "RepairTime") if n in detail.columns]
    tests = F.coalesce(_pick(detail, "GeneratedTestCount").cast("bigint"), F.lit(0))
    error = _error(detail).isNotNull()
    d = detail.groupBy("Program").agg(F.count("*").alias("rounds"), F.count_if(error).alias("errors"), F.sum(tests).alias("tests"), *[F.sum(c).alias(f"sum_{n}") for n, c in times], *[F.count(c).alias(f"n_{n}") for n, c in times])
    out = s.join(d, "Program", "full_outer")
    flags = {c: F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("initial_compile", "final_compile", "runtime", "functional")}
    zeros = [c for c in out.columns if c not in flags and c != "Program"]
    return out.select("Program", *flags.values(), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in zeros])


def aggregate_b(programs: DataFrame) -> DataFrame:
    share = lambda c: F.count_if(c) / F.greatest(F.count("*"), F.lit(1))
    active = (F.col("repair_rounds") > 0) | (F.col("rounds") > 0)
    ratio = lambda a, b: F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), F.lit(0.0))
    return programs.agg(
        F.count("*").alias("total_programs"),
        share(F.col("final_compile")).alias("compile_success_rate"),
        share(F.col("runtime")).alias("runtime_success_rate"),
        share(F.col("functional")).alias("functional_success_rate"),
        share(F.col("final_compile") & F.col("runtime") & F.col("functional")).alias("overall_success_rate"),
        ratio("sum_TranslationTime", "n_TranslationTime").alias("avg_translation_time"),
        ratio("sum_ValidationTime", "n_ValidationTime").alias("avg_validation_time"),
        _mean(F.col("total_time")).alias("avg_runtime"),
        F.coalesce(F.avg(F.when(active, F.col("repair_rounds"))), F.lit(0.0)).alias("avg_repair_count"),
        ratio("tests", "rounds").alias("avg_generated_test_count"),
    )


def distributions_b(programs: DataFrame, detail: DataFrame) -> DataFrame:
    """(section, label, n): error types over all rounds; repair rounds over programs that had any round or repair."""
    errors = detail.select(_error(detail).alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    repair = programs.where("repair_rounds > 0 or rounds > 0").groupBy(F.col("repair_rounds").cast("string").alias("label")).agg(F.count("*").alias("n"))
    return errors.select(F.lit("error").alias("section"), "label", "n").unionByName(repair.select(F.lit("repair").alias("section"), "label", "n"))


def report_long(programs: DataFrame, detail: DataFrame) -> DataFrame:
    """(section, key, value) of the four-section report."""
    one = aggregate_b(programs)
    agg = one.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in one.columns]).unpivot([], one.columns, "key", "value").select(F.lit("aggregate").alias("section"), "key", "value")
    dist = distributions_b(programs, detail).select("section", F.col("label").alias("key"), F.col("n").cast("double").alias("value"))
    per = programs.select(F.lit("program").alias("section"), F.col("Program").alias("key"), F.round("total_time", 6).alias("value"))
    return agg.unionByName(dist).unionByName(per)


#: The names of the summary, with the columns and the format of each value.
SUMMARY_TABLE = (
    ("Programs", "%d", "total_programs"),
    ("Compile Success", "%d/%d (%.1f%%)", "compile_pass", "total_programs", "compile_success_rate"),
    ("Runtime Success", "%d/%d (%.1f%%)", "runtime_pass", "total_programs", "runtime_success_rate"),
    ("Functional Success", "%d/%d (%.1f%%)", "functional_pass", "total_programs", "functional_success_rate"),
    ("Overall Success", "%d/%d (%.1f%%)", "overall_success", "total_programs", "overall_success_rate"),
    ("Avg Translation Time", "%.2fs", "avg_translation_time"),
    ("Avg Compile Time", "%.4fs", "avg_compile_time"),
    ("Avg Runtime", "%.4fs", "avg_runtime_time"),
    ("Avg Validation Time", "%.4fs", "avg_validation_time"),
    ("Avg Total Time", "%.2fs", "avg_total_time"),
    ("Avg Repair Rounds", "%.2f", "avg_repair_rounds"),
    ("Programs Repaired", "%d", "programs_repaired"),
    ("Repair Gain", "%d", "repair_success_gain"),
    ("Avg Generated Tests", "%.1f", "avg_generated_tests"),
    ("Avg Executed Tests", "%.1f", "avg_executed_tests"),
    ("Avg Passed Tests", "%.1f", "avg_passed_tests"),
    ("Avg Test Success Rate", "%.1f%%", "avg_test_success_rate"),
)


def summary_table(summary: DataFrame, detail: DataFrame) -> DataFrame:
    """(place, metric, value): the figures of engine A as named and formatted text. Four rows of one line each are put side by side."""
    one = rates_a(summary)
    for more in (timing_a(summary, detail), repair_a(summary), tests_a(summary)):
        one = one.crossJoin(F.broadcast(more))
    rows = [F.struct(F.lit(i).alias("place"), F.lit(name).alias("metric"), F.format_string(form, *columns).alias("value")) for i, (name, form, *columns) in enumerate(SUMMARY_TABLE)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def top_errors(detail: DataFrame, n: int = 12) -> DataFrame:
    """The most frequent error types with their share of all errors in percent and a text bar."""
    counts = detail.select(_error(detail).alias("ErrorType")).where("ErrorType is not null").groupBy("ErrorType").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.orderBy(F.desc("n"), "ErrorType").limit(n).crossJoin(F.broadcast(total))
    share = F.col("n") * 100.0 / F.col("total")
    return out.select("ErrorType", "n", share.alias("share"), F.repeat(F.lit("█"), F.floor(share / 5).cast("int")).alias("bar"))


def stage_success(summary: DataFrame) -> DataFrame:
    """(stage, passed, rate) in percent."""
    one = rates_a(summary)
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(p).alias("passed"), F.col(r).alias("rate")) for s, p, r in (("compile", "compile_pass", "compile_success_rate"), ("runtime", "runtime_pass", "runtime_success_rate"), ("functional", "functional_pass", "functional_success_rate"))])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def repository_success(programs: DataFrame, summary: DataFrame) -> DataFrame:
    """Per repository: programs with a summary, success of the last stage, mean time above 0, repairs. The program table
    has one row per program and is joined on its key; nothing is gathered per repository."""
    s = last_rows(summary)
    rows = s.join(programs.select(F.col("ProgramID").alias("Program"), "Repository"), "Program", "left")
    ok = L.strict_bool(F.col("FinalCompilePass")) & L.strict_bool(F.col("RuntimePass")) & L.strict_bool(F.col("FunctionalPass"))
    return rows.groupBy(F.coalesce("Repository", F.lit("unknown")).alias("repository")).agg(F.count("*").alias("programs"), F.count_if(ok).alias("successful"), (F.count_if(ok) * 100.0 / F.count("*")).alias("rate"), F.round(_mean(F.coalesce("TotalTime", F.lit(0.0))), 6).alias("avg_time"), F.sum(L.strict_int(F.col("RepairRounds"))).alias("repairs"))


def findings(summary: DataFrame) -> DataFrame:
    """(stage, level): "high" from 90 percent, "some" above 0, else "none"."""
    return stage_success(summary).select("stage", F.when(F.col("rate") >= 90, "high").when(F.col("rate") > 0, "some").otherwise("none").alias("level"))
