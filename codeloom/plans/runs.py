"""Queries over test facts and call logs, and the SQL that checks them.

The reference's facts are made by programs it runs. Here they are views over the driver's tables whose definition is the same in
both engines: a supplier's line items are the test cases of a program, and the events of a user are the calls of a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import fixed as X
from codeloom.operators import difftest as D
from codeloom.operators import telemetry as M
from codeloom.operators import testgen as G
from codeloom.plans.corpus import _q, table


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test cases of a program, numbered in the order of all columns."""
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return rows.select(
        F.col("l_suppkey").alias("program"),
        F.row_number().over(order).cast("bigint").alias("test_index"),
        F.concat(F.repeat(F.lit("9"), F.pmod(F.col("l_quantity").cast("int"), F.lit(17))), F.lit(" "), F.col("l_partkey")).alias("test_input"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat("l_returnflag", F.lit(" "))).alias("expected"),
        (F.col("l_discount") < 0.095).alias("oracle_ok"),
        F.col("l_returnflag").alias("oracle_output"),
        (F.col("l_tax") < 0.075).alias("candidate_ok"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("\n"), F.col("l_returnflag"), F.lit("\n"))).otherwise(F.col("l_linestatus")).alias("candidate_output"),
    )


def diff_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.judge(_facts(spark, sf_dir)).select("program", "test_index", "passed", "verdict")


def diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.report(D.judge(_facts(spark, sf_dir)))


def representative_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the drawn ones."""
    return D.representatives(D.failures(D.judge(_facts(spark, sf_dir))), drawn=0)


def representative_failures_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.representatives(D.failures(D.judge(_facts(spark, sf_dir))))


def mismatch_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_failures(D.failures(D.judge(_facts(spark, sf_dir))))


def failure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.failure_lines(D.failures(D.judge(_facts(spark, sf_dir))))


def exec_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).select(F.col("program").cast("string").alias("source"), "test_input")
    return D.distinct_runs(rows, "source", "test_input")


def case_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets for as many cases as each summary says were generated."""
    rows = table(spark, sf_dir, "summary_results").select(F.coalesce("GeneratedTestCount", F.lit(0)).alias("count")).distinct()
    return rows.select("count", F.explode(G.budgets(F.col("count"), (*G.STRATEGIES, "llm"))).alias("b")).select("count", "b.strategy", "b.budget")


def edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))
    return rows.select("i", G.edge_case(F.col("i")).alias("input"))


def clamped_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))
    return rows.select("i", *[G.boundary_value(F.col("i"), k).alias(k) for k in ("short", "int", "long")])


def input_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.input_structures(table(spark, sf_dir, "benchmark_dataset"), "ProgramID", "Content")


def generated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.generate(table(spark, sf_dir, "benchmark_dataset"), "ProgramID", "Content", 20)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "ts", F.col("user_id").alias("session"), "event_type", "value", (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 5 != 0).alias("retryable"), F.floor(F.abs("value") * 10).cast("bigint").alias("tokens"))


def _metered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls with prompt and completion tokens, seconds, and retries."""
    calls = _calls(spark, sf_dir)
    prompt = F.floor(F.col("tokens") / 3)
    return calls.select("session", prompt.alias("prompt"), (F.col("tokens") - prompt).alias("completion"), (F.col("event_id") % 7 / 4.0).alias("seconds"), F.when(F.col("ok"), 0).otherwise(F.col("event_id") % 3).cast("bigint").alias("retries"))


def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.session_totals(_metered(spark, sf_dir))


def program_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.program_totals(_metered(spark, sf_dir), "session")


def last_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five reasons of failures of each run."""
    rows = table(spark, sf_dir, "experiment_results").where("FailureReason not in ('', 'None') and RunId is not null")
    rows = rows.select("RunId", "FinishedAt", "Program", "Round", "FailureReason").distinct()
    return M.last_messages(rows, "RunId", ["FinishedAt", "Program", "Round", "FailureReason"], "FailureReason")


def compact_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without drawn failures."""
    return D.compact_summary(D.judge(_facts(spark, sf_dir)), drawn=0)


def running_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.running_sum(_calls(spark, sf_dir), "session", F.to_date("ts"), ["ts", "event_id"], "tokens", "running").select("event_id", "session", "running")


def last_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).groupBy("session").agg(F.max(F.struct("ts", "event_id", "event_type", "tokens")).alias("r")).select("session", "r.event_id", "r.event_type", "r.tokens")


def rolling_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling mean time, and progress through each session's own calls."""
    calls = _calls(spark, sf_dir)
    rows = M.rolling_mean(calls, "session", F.to_date("ts"), ["ts", "event_id"], "value")
    rows = M.running_sum(rows.withColumn("one", F.lit(1)), "session", F.to_date("ts"), ["ts", "event_id"], "one", "done")
    sizes = calls.groupBy("session").agg(F.count("*").alias("total"), F.min("ts").alias("start"))
    rows = rows.join(sizes, "session").withColumn("seconds", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6)
    made = M.progress(F.col("done"), F.col("total"), F.col("seconds"), F.col("rolling"))
    return rows.select("event_id", F.round("rolling", 6).alias("rolling"), "done", *[F.round(c, 6).alias(n) if n in ("eta_seconds", "per_minute") else c.alias(n) for n, c in made.items()])


def success_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of calls with the same outcome, by session and outcome: gaps and islands."""
    return M.longest_runs(_calls(spark, sf_dir), "session", F.to_date("ts"), ["ts", "event_id"], "ok")


def phase_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "experiment_results")
    timed = M.phases(rows, {"translation": "TranslationTime", "compile": "CompileTime", "runtime": "RuntimeTime", "validation": "ValidationTime", "repair": "RepairTime"})
    out = M.phase_shares(timed, 1_000_000.0)
    return out.select("phase", F.round("seconds", 4).alias("seconds"), "calls", F.round("mean", 6).alias("mean"), F.round("percent", 6).alias("percent"))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).select("program", "test_input")
    return M.cache_outcomes(rows, ["program", "test_input"], ["test_input"])


def translation_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs whose source is found under (name, first 16 digits of its hash) in a cache of every other program."""
    rows = table(spark, sf_dir, "benchmark_dataset").select("ProgramID", F.substring(F.sha2(F.col("Content").cast("binary"), 256), 1, 16).alias("sha16"))
    cached = rows.where(F.col("ProgramID").substr(-1, 1).isin("0", "2", "4", "6", "8")).withColumn("hit", F.lit(True))
    return rows.join(cached, ["ProgramID", "sha16"], "left").select("ProgramID", "sha16", F.coalesce("hit", F.lit(False)).alias("hit"))


def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs without a summary yet."""
    done = table(spark, sf_dir, "summary_results").select(F.col("Program").alias("ProgramID"))
    return table(spark, sf_dir, "benchmark_dataset").select("ProgramID").join(done, "ProgramID", "left_anti")


def retry_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "experiment_results").select(F.coalesce("FailureReason", F.lit("")).alias("reason"), F.coalesce("ErrorType", F.lit("")).alias("kind"))
    rows = rows.groupBy("reason", "kind").agg(F.count("*").alias("n"))
    return rows.withColumn("retryable", M.is_retryable(F.col("reason"), F.col("kind")))


def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "experiment_results").groupBy("Round").agg(F.count("*").alias("n"))
    return rows.select("Round", "n", M.backoff_seconds(F.col("Round")).alias("wait"))


def adaptive_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).select("session", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("seq"), "ok", "retryable")
    return M.adaptive_limits(calls, 8)


QUERIES = (
    diff_results, diff_report, representative_failures, representative_failures_drawn, mismatch_detail, failure_lines, exec_cache_keys, case_budgets, edge_cases, clamped_boundaries,
    input_structures, generated_cases, session_totals, program_tokens, last_errors, compact_summaries, running_tokens, last_call, rolling_eta, success_runs, phase_timing, cache_stats, translation_cache, resume_remaining,
    retry_classes, retry_backoff, adaptive_limit,
)

_FACTS = """
f AS (SELECT l_suppkey AS program, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS test_index,
  repeat('9', (trunc(l_quantity)::INT) % 17) || ' ' || l_partkey AS test_input, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag || ' ' END AS expected, l_discount < 0.095 AS oracle_ok, l_returnflag AS oracle_output,
  l_tax < 0.075 AS candidate_ok, CASE WHEN l_linestatus = 'O' THEN chr(10) || l_returnflag || chr(10) ELSE l_linestatus END AS candidate_output FROM lineitem),
e AS (SELECT *, trim(coalesce(expected, oracle_output, ''), ' ' || chr(10)) = trim(coalesce(candidate_output, ''), ' ' || chr(10)) AS eq FROM f),
r AS (SELECT *, oracle_ok AND candidate_ok AND eq AS passed, CASE WHEN NOT oracle_ok THEN 'skipped' WHEN NOT candidate_ok THEN 'crash' WHEN eq THEN 'pass' ELSE 'mismatch' END AS verdict FROM e),
x AS (SELECT program, test_index, test_input, verdict, count(*) OVER (PARTITION BY program) AS n, row_number() OVER (PARTITION BY program ORDER BY test_index) AS i FROM r WHERE oracle_ok AND NOT passed),
short AS (SELECT * FROM x WHERE n > 8 AND i > 1 QUALIFY row_number() OVER (PARTITION BY program ORDER BY length(test_input), test_index) = 1),
long AS (SELECT * FROM x WHERE n > 8 AND i > 1 AND (program, test_index) NOT IN (SELECT (program, test_index) FROM short) QUALIFY row_number() OVER (PARTITION BY program ORDER BY length(test_input) DESC, test_index DESC) = 1)
"""
_CALLS = "c AS (SELECT event_id, ts, user_id AS session, event_type, value, event_type <> 'error' AS ok, event_id % 5 <> 0 AS retryable, floor(abs(value) * 10)::BIGINT AS tokens FROM events)"
_TIMES = {"translation": "TranslationTime", "compile": "CompileTime", "runtime": "RuntimeTime", "validation": "ValidationTime", "repair": "RepairTime"}

SQL = {
    "diff_results": f"WITH {_FACTS} SELECT program, test_index, passed, verdict FROM r",
    "diff_report": f"""WITH {_FACTS}, n AS (SELECT program, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (oracle_ok) AS validated FROM r GROUP BY 1)
      SELECT *, total - validated AS oracle_failures, validated - passed AS failed, validated > 0 AND validated = passed AS all_passed, total > 0 AND validated = 0 AS oracle_failed,
      CASE WHEN validated = 0 THEN 'Differential Testing: no cases could be validated (oracle failed)' ELSE 'Differential Testing: ' || passed || '/' || validated || ' passed' || CASE WHEN validated > passed THEN ', ' || (validated - passed) || ' FAILED' ELSE '' END || CASE WHEN total > validated THEN ', ' || (total - validated) || ' skipped (oracle failed)' ELSE '' END END AS summary FROM n""",
    "representative_failures": f"WITH {_FACTS} SELECT program, test_index, 'all' AS reason FROM x WHERE n <= 8 UNION ALL SELECT program, test_index, 'first' FROM x WHERE n > 8 AND i = 1 UNION ALL SELECT program, test_index, 'shortest' FROM short UNION ALL SELECT program, test_index, 'longest' FROM long",
    "representative_failures_drawn": f"""WITH {_FACTS}, p AS (SELECT program, test_index, 'first' AS reason FROM x WHERE n > 8 AND i = 1 UNION ALL SELECT program, test_index, 'shortest' FROM short UNION ALL SELECT program, test_index, 'longest' FROM long),
      d AS (SELECT program, test_index FROM x WHERE n > 8 AND (program, test_index) NOT IN (SELECT (program, test_index) FROM p) QUALIFY row_number() OVER (PARTITION BY program ORDER BY md5(program || ':' || test_index || ':42'), test_index) <= 2)
      SELECT program, test_index, 'all' AS reason FROM x WHERE n <= 8 UNION ALL SELECT * FROM p UNION ALL SELECT *, 'drawn' FROM d""",
    "mismatch_detail": f"WITH {_FACTS} SELECT program, test_index, test_input, verdict, i AS rank FROM x WHERE i <= 10",
    "failure_lines": f"WITH {_FACTS} SELECT program, string_agg('#' || test_index || ' ' || verdict || ' input=''' || test_input || '''', chr(10) ORDER BY test_index) AS lines FROM x WHERE i <= 10 GROUP BY 1",
    "exec_cache_keys": f"WITH {_FACTS} SELECT sha256(program::VARCHAR) AS source_sha, sha256(test_input) AS input_sha, count(*) AS cases FROM f GROUP BY ALL",
    "case_budgets": "WITH c AS (SELECT DISTINCT coalesce(GeneratedTestCount, 0) AS count FROM summary_results), e AS (SELECT count, greatest(count // 4, 1) AS each FROM c) SELECT count, unnest(['random', 'boundary', 'edge', 'heuristic', 'llm']) AS strategy, unnest([each + (0 < count - each * 4)::INT, each + (1 < count - each * 4)::INT, each + (2 < count - each * 4)::INT, each + (3 < count - each * 4)::INT, greatest(count // 4, 1)]) AS budget FROM e",
    "edge_cases": "SELECT p_partkey AS i, [" + ", ".join(_q(x.rstrip("\n")) + " || chr(10)" for x in X.EDGE_INPUTS) + f"][p_partkey % {len(X.EDGE_INPUTS)} + 1] AS input FROM part",
    "clamped_boundaries": f"WITH v AS (SELECT p_partkey AS i, {list(X.BOUNDARY_VALUES)}[p_partkey % {len(X.BOUNDARY_VALUES)} + 1]::BIGINT AS v FROM part) SELECT i, greatest(-32768, least(32767, v)) AS short, v AS int, v AS long FROM v",
    "session_totals": f"WITH {_CALLS} SELECT count(*) AS calls, sum(tokens // 3)::BIGINT AS prompt_tokens, sum(tokens - tokens // 3)::BIGINT AS completion_tokens, sum(tokens)::BIGINT AS total_tokens, sum(CASE WHEN ok THEN 0 ELSE event_id % 3 END)::BIGINT AS retries, sum((event_id % 7) / 4.0::DOUBLE) AS elapsed FROM c",
    "program_tokens": f"WITH {_CALLS} SELECT session, count(*) AS calls, sum(tokens // 3)::BIGINT AS prompt_tokens, sum(tokens - tokens // 3)::BIGINT AS completion_tokens, sum(tokens)::BIGINT AS total_tokens FROM c GROUP BY 1",
    "last_errors": "WITH e AS (SELECT DISTINCT RunId, FinishedAt, Program, Round, FailureReason FROM experiment_results WHERE FailureReason NOT IN ('', 'None') AND RunId IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY RunId ORDER BY FinishedAt DESC NULLS LAST, Program DESC NULLS LAST, Round DESC NULLS LAST, FailureReason DESC) AS i FROM e) SELECT RunId, (6 - i)::INT AS place, substr(FailureReason, 1, 120) AS message FROM r WHERE i <= 5",
    "compact_summaries": f"""WITH {_FACTS}, s AS (SELECT program, test_index FROM x WHERE n <= 8 UNION ALL SELECT program, test_index FROM x WHERE n > 8 AND i = 1 UNION ALL SELECT program, test_index FROM short UNION ALL SELECT program, test_index FROM long),
      t AS (SELECT program, count(*) AS shown, string_agg('  Test ' || test_index || ': input=''' || trim(test_input) || ''' | expected=''' || replace(coalesce(expected, oracle_output, ''), chr(10), '\\n') || ''' | got=''' || replace(coalesce(candidate_output, ''), chr(10), '\\n') || '''', chr(10) ORDER BY test_index) AS body FROM r JOIN s USING (program, test_index) GROUP BY 1),
      c AS (SELECT program, count(*) FILTER (oracle_ok AND NOT passed) AS failed, count(*) FILTER (NOT oracle_ok) AS skipped FROM r GROUP BY 1)
      SELECT c.program, CASE WHEN failed = 0 THEN CASE WHEN skipped > 0 THEN 'All validated tests passed (' || skipped || ' oracle failures skipped).' ELSE 'All tests passed.' END ELSE
        concat_ws(chr(10), 'FAILED TEST CASES (' || shown || ' shown of ' || failed || ' total):', body, CASE WHEN failed > shown THEN '  ... (' || (failed - shown) || ' more failures omitted — the ' || shown || ' most representative are shown above)' END) END AS text FROM c LEFT JOIN t USING (program)""",
    "input_structures": f"""WITH c AS (SELECT ProgramID, regexp_replace(regexp_replace(regexp_replace(Content, '\\r\\n?', chr(10), 'g'), {_q(X.BLOCK_COMMENT)}, ' ', 'gs'), {_q(X.LINE_COMMENT)}, ' ', 'g') AS t FROM benchmark_dataset WHERE Content IS NOT NULL),
      d AS (SELECT ProgramID, unnest(regexp_extract_all(t, {_q(X.READ_DECLARATION)}, 1)) AS kind, unnest(regexp_extract_all(t, {_q(X.READ_DECLARATION)}, 2)) AS rest, generate_subscripts(regexp_extract_all(t, {_q(X.READ_DECLARATION)}, 1), 1) AS i FROM c),
      k AS (SELECT ProgramID, regexp_extract(rest, '^[a-zA-Z_]\\w*') AS name, replace(arg_max(kind, i), ' ', '') AS kind FROM d GROUP BY 1, 2),
      s1 AS (SELECT ProgramID, flatten(list_transform(regexp_extract_all(t, {_q(X.READ_SCALARS)}, 1), lambda x: string_split(x, '>>'))) AS l FROM c),
      s2 AS (SELECT ProgramID, regexp_replace(x, '\\s', '', 'g') AS name, min(i) AS i FROM (SELECT ProgramID, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM s1) GROUP BY 1, 2),
      s AS (SELECT ProgramID, string_agg(name || ':' || coalesce(kind, 'int'), ',' ORDER BY i) AS scalars FROM s2 LEFT JOIN k USING (ProgramID, name) GROUP BY 1),
      a1 AS (SELECT ProgramID, regexp_extract_all(regexp_replace(t, {_q(X.READ_LOOP)}, '\\0' || chr(1) || '\\2' || chr(2), 'g'), '\\x01\\w+\\x02|' || {_q(X.READ_ELEMENT)}) AS l FROM c),
      a2 AS (SELECT ProgramID, i, starts_with(x, chr(1)) AS loop, CASE WHEN starts_with(x, chr(1)) THEN trim(x, chr(1) || chr(2)) ELSE regexp_extract(x, {_q(X.READ_ELEMENT)}, 1) END AS name FROM (SELECT ProgramID, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM a1)),
      a3 AS (SELECT *, last_value(CASE WHEN loop THEN name END IGNORE NULLS) OVER (PARTITION BY ProgramID ORDER BY i ROWS UNBOUNDED PRECEDING) AS bound FROM a2),
      a4 AS (SELECT ProgramID, name, min(i) AS i, arg_min(coalesce('<' || bound, ''), i) AS bound FROM a3 WHERE NOT loop GROUP BY 1, 2),
      a AS (SELECT ProgramID, string_agg(name || ':' || coalesce(kind, 'int') || bound, ',' ORDER BY i) AS arrays FROM a4 LEFT JOIN k USING (ProgramID, name) GROUP BY 1)
      SELECT c.ProgramID, coalesce(scalars, '') AS scalars, coalesce(arrays, '') AS arrays, 0 AS nested FROM c LEFT JOIN s USING (ProgramID) LEFT JOIN a USING (ProgramID)""",
    "running_tokens": f"WITH {_CALLS} SELECT event_id, session, sum(tokens) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM c",
    "last_call": f"WITH {_CALLS} SELECT session, event_id, event_type, tokens FROM c QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) = 1",
    "rolling_eta": f"""WITH {_CALLS}, s AS (SELECT session, count(*) AS total, min(ts) AS start FROM c GROUP BY 1),
      w AS (SELECT event_id, total, ts, start, avg(value) OVER (PARTITION BY session ORDER BY ts, event_id ROWS 19 PRECEDING) AS m, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS done FROM c JOIN s USING (session) WHERE value > 0),
      t AS (SELECT *, (epoch_us(ts) - epoch_us(start)) / 1e6 AS seconds FROM w)
      SELECT event_id, round(m, 6) AS rolling, done, floor(done * 100 / greatest(total, 1))::BIGINT AS percent, greatest(total - done, 0) AS remaining, round(greatest(total - done, 0) * m, 6) AS eta_seconds,
      round(done / greatest(CASE WHEN seconds > 0 THEN seconds / 60.0 ELSE 0.001 END, 0.001), 6) AS per_minute FROM t""",
    "success_runs": f"WITH {_CALLS}, i AS (SELECT session, ok, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) - row_number() OVER (PARTITION BY session, ok ORDER BY ts, event_id) AS g FROM c), n AS (SELECT session, ok, g, count(*) AS n FROM i GROUP BY ALL) SELECT session, ok, max(n) AS longest FROM n GROUP BY ALL",
    "phase_timing": "WITH l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS phase, {c} AS v FROM experiment_results" for n, c in _TIMES.items()) + "), p AS (SELECT phase, sum(v) AS seconds, count(*) AS calls, avg(v) AS mean FROM l WHERE v > 0 AND v::VARCHAR <> 'nan' GROUP BY 1), a AS (SELECT * FROM p UNION ALL SELECT 'other', greatest(1000000.0 - sum(seconds), 0.0), 0, 0.0 FROM p) SELECT phase, round(seconds, 4) AS seconds, calls, round(mean, 6) AS mean, round(seconds / 1000000.0 * 100, 6) AS percent FROM a",
    "cache_stats": f"WITH {_FACTS}, k AS (SELECT count(*) AS n FROM f GROUP BY program, test_input) SELECT (sum(n) - count(*))::BIGINT AS hits, count(*) AS misses, (sum(n) - count(*)) / sum(n) AS hit_rate FROM k",
    "translation_cache": "SELECT ProgramID, substr(sha256(Content), 1, 16) AS sha16, right(ProgramID, 1) IN ('0', '2', '4', '6', '8') AS hit FROM benchmark_dataset",
    "resume_remaining": "SELECT ProgramID FROM benchmark_dataset WHERE ProgramID NOT IN (SELECT Program FROM summary_results WHERE Program IS NOT NULL)",
    "retry_classes": "SELECT coalesce(FailureReason, '') AS reason, coalesce(ErrorType, '') AS kind, count(*) AS n, " + " OR ".join([f"contains(lower(coalesce(FailureReason, '')), {_q(t)})" for t in X.RETRYABLE_TEXTS] + [f"contains(lower(coalesce(ErrorType, '')), {_q(t)})" for t in X.RETRYABLE_CLASS_PARTS]) + " AS retryable FROM experiment_results GROUP BY 1, 2, 4",
    "retry_backoff": "SELECT Round, count(*) AS n, pow(2.0, Round) AS wait FROM experiment_results GROUP BY Round",
    "adaptive_limit": f"""WITH RECURSIVE {_CALLS}, o AS (SELECT session, ok, retryable, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY session) AS n FROM c),
      st AS (
        SELECT DISTINCT session, 0::BIGINT AS i, 8 AS cur, 0 AS fails, 0 AS succ, -1e18::DOUBLE AS prev, 0 AS red, 0 AS res FROM o
        UNION ALL
        SELECT q.session, q.i,
          CASE WHEN raise THEN cur + 1 WHEN lower_ THEN cur - 1 ELSE cur END,
          CASE WHEN ok THEN 0 WHEN NOT retryable THEN fails WHEN lower_ THEN 0 ELSE fails + 1 END,
          CASE WHEN ok THEN CASE WHEN raise THEN 0 ELSE succ + 1 END WHEN NOT retryable THEN succ ELSE 0 END,
          CASE WHEN lower_ THEN tm ELSE prev END, red + lower_::INT, res + raise::INT
        FROM (SELECT o.session, o.i, o.ok, o.retryable, o.tm, st.cur, st.fails, st.succ, st.prev, st.red, st.res,
            o.ok AND st.succ + 1 >= 8 AND st.cur < 8 AS raise, NOT o.ok AND o.retryable AND st.fails + 1 >= 2 AND st.cur > 2 AND o.tm - st.prev > 5.0 AS lower_
          FROM st JOIN o ON o.session = st.session AND o.i = st.i + 1) q)
      SELECT st.session::VARCHAR AS session, o.n AS calls, cur AS current_limit, red AS total_reductions, res AS total_restorations FROM st JOIN o ON o.session = st.session AND o.i = st.i WHERE o.i = o.n""",
}
