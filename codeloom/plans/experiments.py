"""Queries over the experiment tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import fixed as X
from codeloom.operators import statistics as S
from codeloom.plans.corpus import _SPACE, table


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "summary_results")


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "experiment_results")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places: the order of a sum decides the last bits."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stats_a_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.rates_a(_summary(spark, sf_dir)))


def stats_a_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.timing_a(_summary(spark, sf_dir), _detail(spark, sf_dir)))


def stats_a_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.repair_a(_summary(spark, sf_dir)))


def stats_a_repair_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repair_distribution_a(_summary(spark, sf_dir))


def stats_a_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.tests_a(_summary(spark, sf_dir)))


def stats_a_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.tokens_a(_summary(spark, sf_dir)))


def stats_a_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.errors_a(_detail(spark, sf_dir))


def stats_summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named and formatted figures of a report."""
    return S.summary_table(_summary(spark, sf_dir), _detail(spark, sf_dir))


def errors_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributions of a detail table without error types: every round's error is unknown."""
    detail = _detail(spark, sf_dir).drop("ErrorType")
    return S.distributions_b(S.programs_b(_summary(spark, sf_dir), detail), detail).where("section = 'error'")


def stats_b_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.aggregate_b(S.programs_b(_summary(spark, sf_dir), _detail(spark, sf_dir))))


def stats_b_per_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rounded(S.programs_b(_summary(spark, sf_dir), _detail(spark, sf_dir)))
    return out.select("Program", "initial_compile", "final_compile", "runtime", "functional", "repair_rounds", "total_time", "rounds", "errors", "tests", "sum_TranslationTime", "n_TranslationTime", "sum_RepairTime", "n_RepairTime")


def stats_b_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = _detail(spark, sf_dir)
    return S.distributions_b(S.programs_b(_summary(spark, sf_dir), detail), detail)


def report_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = _detail(spark, sf_dir)
    return S.report_long(S.programs_b(_summary(spark, sf_dir), detail), detail)


def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.top_errors(_detail(spark, sf_dir)))


def stage_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.stage_success(_summary(spark, sf_dir)))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.findings(_summary(spark, sf_dir))


def repository_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.repository_success(table(spark, sf_dir, "benchmark_dataset"), _summary(spark, sf_dir)))


QUERIES = (stats_a_rates, stats_a_timing, stats_a_repair, stats_a_repair_distribution, stats_a_tests, stats_a_tokens, stats_a_errors, stats_b_rates, stats_b_per_program, stats_b_distributions, report_long, top_errors, stage_success, findings, repository_success, stats_summary_table, errors_unknown)

_TRIM = f"lower(trim({{0}}, {_SPACE}))"
_BOOL = lambda c, words: f"coalesce({_TRIM.format(c)} IN ({', '.join(repr(w) for w in words)}), false)"
_A = lambda c: _BOOL(c, X.TRUE_WORDS_A)
_B = lambda c: _BOOL(c, X.TRUE_WORDS_B)
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INT_A = f"coalesce(CASE WHEN regexp_matches(trim(RepairRounds, {_SPACE}), '{_FLOAT}') THEN trunc(try_cast(trim(RepairRounds, {_SPACE}) AS DOUBLE))::BIGINT END, 0)"
_INT_B = rf"coalesce(CASE WHEN regexp_matches(trim(RepairRounds, {_SPACE}), '^[+-]?\d+$') THEN try_cast(trim(RepairRounds, {_SPACE}) AS BIGINT) END, 0)"
_POS = lambda c: f"CASE WHEN {c} > 0 AND {c}::VARCHAR <> 'nan' THEN {c} END"
_MEAN = lambda c: f"round(coalesce(avg({_POS(c)}), 0.0), 6)"
_SUMMARY = "s AS (SELECT * FROM summary_results WHERE starts_with(Program, 'program_') OR NOT (SELECT bool_or(starts_with(Program, 'program_')) FROM summary_results))"
_DETAIL = "d AS (SELECT * FROM experiment_results WHERE starts_with(Program, 'program_') OR NOT (SELECT bool_or(starts_with(Program, 'program_')) FROM experiment_results))"
_RATES = f"""{_SUMMARY}, n AS (SELECT count(*) AS total_programs, count(*) FILTER ({_A('FinalCompilePass')}) AS compile_pass, count(*) FILTER ({_A('RuntimePass')}) AS runtime_pass, count(*) FILTER ({_A('FunctionalPass')}) AS functional_pass,
  count(*) FILTER ({_A('FinalCompilePass')} AND {_A('RuntimePass')} AND {_A('FunctionalPass')}) AS overall_success FROM s)"""
_R = lambda c: f"round({c} * 100.0::DOUBLE / greatest(total_programs, 1), 6)"
_LAST = "SELECT * FROM summary_results QUALIFY row_number() OVER (PARTITION BY Program ORDER BY TotalTime DESC NULLS LAST, InitialCompilePass DESC NULLS LAST, FinalCompilePass DESC NULLS LAST, RuntimePass DESC NULLS LAST, FunctionalPass DESC NULLS LAST, RepairRounds DESC NULLS LAST) = 1"
_TIMES = ("TranslationTime", "CompileTime", "RuntimeTime", "ValidationTime", "RepairTime")
_PROGRAMS = f"""l AS ({_LAST}),
s AS (SELECT Program, {_B('InitialCompilePass')} AS ic, {_B('FinalCompilePass')} AS fc, {_B('RuntimePass')} AS ru, {_B('FunctionalPass')} AS fu, {_INT_B} AS rr, coalesce(TotalTime, 0.0) AS tt FROM l),
d AS (SELECT Program, count(*) AS rounds, count(*) FILTER (ErrorType <> '' AND ErrorType <> 'None') AS errors, sum(coalesce(GeneratedTestCount, 0))::BIGINT AS tests,
  {', '.join(f"sum({_POS(t)}) AS sum_{t}, count({_POS(t)}) AS n_{t}" for t in _TIMES)} FROM experiment_results GROUP BY 1),
p AS (SELECT coalesce(s.Program, d.Program) AS Program, coalesce(ic, false) AS initial_compile, coalesce(fc, false) AS final_compile, coalesce(ru, false) AS runtime, coalesce(fu, false) AS functional, coalesce(rr, 0) AS repair_rounds, coalesce(tt, 0.0) AS total_time,
  coalesce(rounds, 0) AS rounds, coalesce(errors, 0) AS errors, coalesce(tests, 0) AS tests, {', '.join(f"coalesce(sum_{t}, 0.0) AS sum_{t}, coalesce(n_{t}, 0) AS n_{t}" for t in _TIMES)} FROM s FULL JOIN d ON s.Program = d.Program)"""
_AGG = {
    "total_programs": "count(*)",
    "compile_success_rate": "count(*) FILTER (final_compile) / greatest(count(*), 1)",
    "runtime_success_rate": "count(*) FILTER (runtime) / greatest(count(*), 1)",
    "functional_success_rate": "count(*) FILTER (functional) / greatest(count(*), 1)",
    "overall_success_rate": "count(*) FILTER (final_compile AND runtime AND functional) / greatest(count(*), 1)",
    "avg_translation_time": "coalesce(sum(sum_TranslationTime) / nullif(sum(n_TranslationTime), 0), 0.0)",
    "avg_validation_time": "coalesce(sum(sum_ValidationTime) / nullif(sum(n_ValidationTime), 0), 0.0)",
    "avg_runtime": f"coalesce(avg({_POS('total_time')}), 0.0)",
    "avg_repair_count": "coalesce(avg(CASE WHEN repair_rounds > 0 OR rounds > 0 THEN repair_rounds END), 0.0)",
    "avg_generated_test_count": "coalesce(sum(tests) / nullif(sum(rounds), 0), 0.0)",
}
_ERRORS = "SELECT ErrorType, count(*) AS n FROM experiment_results WHERE ErrorType <> '' AND ErrorType <> 'None' GROUP BY 1"
_DIST = f"SELECT 'error' AS section, ErrorType AS label, n FROM ({_ERRORS}) UNION ALL SELECT 'repair', repair_rounds::VARCHAR, count(*) FROM p WHERE repair_rounds > 0 OR rounds > 0 GROUP BY ALL"
_STAGES = f"WITH {_RATES} SELECT unnest(['compile', 'runtime', 'functional']) AS stage, unnest([compile_pass, runtime_pass, functional_pass]) AS passed, unnest([{_R('compile_pass')}, {_R('runtime_pass')}, {_R('functional_pass')}]) AS rate FROM n"

SQL = {
    "stats_a_rates": f"WITH {_RATES} SELECT *, compile_pass AS final_compile_pass, total_programs - compile_pass AS compile_fail, {_R('compile_pass')} AS compile_success_rate, {_R('runtime_pass')} AS runtime_success_rate, {_R('functional_pass')} AS functional_success_rate, {_R('overall_success')} AS overall_success_rate FROM n",
    "stats_a_timing": f"WITH {_SUMMARY}, {_DETAIL} SELECT {_MEAN('TranslationTime')} AS avg_translation_time, {_MEAN('ValidationTime')} AS avg_validation_time, {_MEAN('TotalTime')} AS avg_total_time, round(coalesce(max({_POS('TotalTime')}), 0.0), 6) AS total_experiment_time, (SELECT {_MEAN('CompileTime')} FROM d) AS avg_compile_time, (SELECT {_MEAN('RuntimeTime')} FROM d) AS avg_runtime_time FROM s",
    "stats_a_repair": f"WITH {_SUMMARY}, r AS (SELECT *, {_INT_A} AS rr FROM s) SELECT count({_POS('rr')}) AS programs_repaired, {_MEAN('rr')} AS avg_repair_rounds, coalesce(max({_POS('rr')}), 0) AS max_repair_rounds, count(*) FILTER (starts_with(Program, 'program_') AND NOT {_A('InitialCompilePass')} AND {_A('FunctionalPass')}) AS repair_success_gain FROM r",
    "stats_a_repair_distribution": f"WITH {_SUMMARY} SELECT {_INT_A} AS rounds, count(*) AS programs FROM s GROUP BY 1",
    "stats_a_tests": f"WITH {_SUMMARY} SELECT {_MEAN('GeneratedTestCount')} AS avg_generated_tests, {_MEAN('ExecutedTestCount')} AS avg_executed_tests, {_MEAN('PassedTestCount')} AS avg_passed_tests, round(coalesce(avg({_POS('SuccessRate')}), 0.0) * 100, 6) AS avg_test_success_rate FROM s",
    "stats_a_tokens": "WITH r AS (SELECT coalesce(PromptTokens, 0) AS p, coalesce(CompletionTokens, 0) AS c, coalesce(TotalTokens, 0) AS t FROM summary_results), n AS (SELECT count(*) AS n, coalesce(sum(p), 0)::BIGINT AS p, coalesce(sum(c), 0)::BIGINT AS c, coalesce(sum(t), 0)::BIGINT AS t FROM r WHERE p > 0 OR c > 0) SELECT p AS total_prompt_tokens, c AS total_completion_tokens, t AS total_tokens, round(p / greatest(n, 1), 6) AS avg_prompt_tokens, round(c / greatest(n, 1), 6) AS avg_completion_tokens, round(t / greatest(n, 1), 6) AS avg_tokens FROM n",
    "stats_a_errors": "SELECT 'type' AS kind, ErrorType AS label, count(*) AS n FROM experiment_results WHERE starts_with(Program, 'program_') AND ErrorType <> '' AND ErrorType <> 'None' GROUP BY ALL UNION ALL SELECT 'category', ErrorCategory, count(*) FROM experiment_results WHERE starts_with(Program, 'program_') AND ErrorCategory NOT IN ('', 'None', 'none') GROUP BY ALL",
    "stats_b_rates": f"WITH {_PROGRAMS} SELECT " + ", ".join(f"{s} AS {n}" if n == "total_programs" else f"round({s}, 6) AS {n}" for n, s in _AGG.items()) + " FROM p",
    "stats_b_per_program": f"WITH {_PROGRAMS} SELECT Program, initial_compile, final_compile, runtime, functional, repair_rounds, round(total_time, 6) AS total_time, rounds, errors, tests, round(sum_TranslationTime, 6) AS sum_TranslationTime, n_TranslationTime, round(sum_RepairTime, 6) AS sum_RepairTime, n_RepairTime FROM p",
    "stats_b_distributions": f"WITH {_PROGRAMS} {_DIST}",
    "report_long": f"WITH {_PROGRAMS}, a AS (SELECT " + ", ".join(f"round(({s})::DOUBLE, 6) AS {n}" for n, s in _AGG.items()) + f" FROM p) SELECT 'aggregate' AS section, unnest([{', '.join(repr(n) for n in _AGG)}]) AS key, unnest([{', '.join(_AGG)}]) AS value FROM a UNION ALL SELECT section, label, n::DOUBLE FROM ({_DIST}) UNION ALL SELECT 'program', Program, round(total_time, 6) FROM p",
    "top_errors": f"WITH e AS ({_ERRORS}), t AS (SELECT *, n * 100.0::DOUBLE / sum(n) OVER () AS share FROM e) SELECT ErrorType, n, round(share, 6) AS share, repeat('█', floor(share / 5)::INT) AS bar FROM t ORDER BY n DESC, ErrorType LIMIT 12",
    "stage_success": _STAGES,
    "errors_unknown": "SELECT 'error' AS section, 'Unknown' AS label, count(*) AS n FROM experiment_results",
    "stats_summary_table": f"""WITH {_RATES}, {_DETAIL}, r AS (SELECT *, {_INT_A} AS rr FROM s),
      o AS (SELECT count({_POS('rr')}) AS repaired, count(*) FILTER (starts_with(Program, 'program_') AND NOT {_A('InitialCompilePass')} AND {_A('FunctionalPass')}) AS gain, coalesce(avg({_POS('TranslationTime')}), 0.0) AS tt, coalesce(avg({_POS('ValidationTime')}), 0.0) AS vt, coalesce(avg({_POS('TotalTime')}), 0.0) AS xt, coalesce(avg({_POS('rr')}), 0.0) AS mr, coalesce(avg({_POS('GeneratedTestCount')}), 0.0) AS gt, coalesce(avg({_POS('ExecutedTestCount')}), 0.0) AS et, coalesce(avg({_POS('PassedTestCount')}), 0.0) AS pt, coalesce(avg({_POS('SuccessRate')}), 0.0) AS sr FROM r),
      e AS (SELECT coalesce(avg({_POS('CompileTime')}), 0.0) AS ct, coalesce(avg({_POS('RuntimeTime')}), 0.0) AS rt FROM d)
      SELECT unnest(range(17))::INT AS place, unnest([{', '.join(repr(x[0]) for x in S.SUMMARY_TABLE)}]) AS metric, unnest([total_programs::VARCHAR,
        {', '.join(f"{c} || '/' || total_programs || ' (' || printf('%.1f', {c} * 100.0::DOUBLE / greatest(total_programs, 1)) || '%)'" for c in ('compile_pass', 'runtime_pass', 'functional_pass', 'overall_success'))},
        printf('%.2fs', tt), printf('%.4fs', ct), printf('%.4fs', rt), printf('%.4fs', vt), printf('%.2fs', xt), printf('%.2f', mr), repaired::VARCHAR, gain::VARCHAR, printf('%.1f', gt), printf('%.1f', et), printf('%.1f', pt), printf('%.1f', sr * 100) || '%']) AS value FROM n, o, e""",
    "findings": f"SELECT stage, CASE WHEN rate >= 90 THEN 'high' WHEN rate > 0 THEN 'some' ELSE 'none' END AS level FROM ({_STAGES})",
    "repository_success": f"WITH l AS ({_LAST}), r AS (SELECT l.*, coalesce(b.Repository, 'unknown') AS repository, {_B('FinalCompilePass')} AND {_B('RuntimePass')} AND {_B('FunctionalPass')} AS ok, {_INT_B} AS rr FROM l LEFT JOIN benchmark_dataset b ON ProgramID = Program) SELECT repository, count(*) AS programs, count(*) FILTER (ok) AS successful, round(count(*) FILTER (ok) * 100.0::DOUBLE / count(*), 6) AS rate, round(coalesce(avg({_POS('TotalTime')}), 0.0), 6) AS avg_time, sum(rr)::BIGINT AS repairs FROM r GROUP BY 1",
}
