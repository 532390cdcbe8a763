import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import fixed as X
from codeloom.operators import boundary as B
from codeloom.operators import difftest as D
from codeloom.operators import telemetry as M
from codeloom.operators import testgen as G

FACTS = "program string, test_index long, test_input string, expected string, oracle_ok boolean, oracle_output string, candidate_ok boolean, candidate_output string"


def facts(spark):
    return spark.createDataFrame(
        [
            ("a", 1, "5", "10", True, "10", True, " 10\n"),
            ("a", 2, "0", None, True, "0", True, "1"),
            ("a", 3, "7", None, False, None, True, "x"),
            ("a", 4, "8", "1", True, "16", True, "16"),
            ("b", 1, "1", None, True, " 2", True, "2"),
            ("c", 1, "1", None, False, "", False, ""),
        ],
        FACTS,
    )


def test_verdicts_and_report(spark):
    judged = D.judge(facts(spark))
    assert [r.verdict for r in judged.orderBy("program", "test_index").collect()] == ["pass", "mismatch", "skipped", "mismatch", "pass", "skipped"]
    by = {r.program: r for r in D.report(judged).collect()}
    assert by["a"].summary == "Differential Testing: 1/3 passed, 2 FAILED, 1 skipped (oracle failed)"
    assert by["b"].all_passed and not by["c"].all_passed and by["c"].oracle_failed
    assert by["a"].passed + by["a"].failed + by["a"].oracle_failures == by["a"].total


def test_representatives(spark):
    rows = [("p", i, "x" * n, "mismatch") for i, n in enumerate([5, 3, 9, 1, 1, 9, 4, 4, 6, 2])] + [("few", 0, "x", "crash")]
    failed = spark.createDataFrame(rows, "program string, test_index long, test_input string, verdict string")
    got = {(r.program, r.reason): r.test_index for r in D.representatives(failed, drawn=0).collect()}
    assert got == {("p", "first"): 0, ("p", "shortest"): 3, ("p", "longest"): 5, ("few", "all"): 0}
    assert D.representatives(failed).where("program = 'p'").select("test_index").distinct().count() == 5
    assert D.first_failures(failed, 3).where("program = 'p'").count() == 3
    assert "#0 crash input='x'" in {r.program: r.lines for r in D.failure_lines(failed).collect()}["few"]


def test_running_sum_and_rolling_mean(spark):
    draw = random.Random(3)
    rows = [(i, i // 40, draw.choice("ab"), float(draw.randrange(-2, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, day long, s string, v double")
    got = {r.i: r.c for r in M.running_sum(df, "s", F.col("day"), ["i"], "v", "c").collect()}
    mean = {r.i: r.rolling for r in M.rolling_mean(df, "s", F.col("day"), ["i"], "v", 5).collect()}
    for key in "ab":
        total, last = 0.0, []
        for i, _, s, v in rows:
            if s == key:
                total += v
                assert got[i] == total
                if v > 0:
                    last = [*last, v][-5:]
                    assert abs(mean[i] - sum(last) / len(last)) < 1e-9


def test_running_sum_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 1)], "s string, i int, v int")
    assert sorted(r.c for r in M.running_sum(df, "s", F.col("i"), ["i"], "v", "c").collect()) == [1, 5, 12]


def test_stretches_of_one_key(spark, monkeypatch):
    """One session, cut into stretches shorter than most of what is looked at."""
    monkeypatch.setattr(M, "STRETCH", 30)
    draw = random.Random(11)
    rows = [(i, i // 50, "one", float(draw.randrange(-2, 9)), draw.random() < 0.7) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, day long, s string, v double, ok boolean")
    mean = {r.i: r.rolling for r in M.rolling_mean(df, "s", F.col("day"), ["i"], "v", 20).collect()}
    last: list[float] = []
    for i, _, _, v, _ in rows:
        if v > 0:
            last = [*last, v][-20:]
            assert abs(mean[i] - sum(last) / len(last)) < 1e-9
    assert len(mean) == sum(r[3] > 0 for r in rows)
    runs = {r.ok: r.longest for r in M.longest_runs(df, "s", F.col("day"), ["i"], "ok").collect()}
    for ok in (True, False):
        assert runs[ok] == max(len(x) for x in "".join("x" if r[4] == ok else " " for r in rows).split())


def test_adaptive_controller(spark):
    draw = random.Random(8)
    rows, t = [], 0.0
    for i in range(600):
        t += draw.choice([0.5, 3.0])
        rows.append((draw.choice(["x", "y"]), t, i, draw.random() < 0.6, draw.random() < 0.9))
    got = {r.session: r for r in M.adaptive_limits(spark.createDataFrame(rows, "session string, at double, seq long, ok boolean, retryable boolean"), 6).collect()}
    for key in "xy":
        a = M.Adaptive(6)
        for s, at, _, ok, retryable in rows:
            if s == key:
                a.success() if ok else a.failure(at, retryable)
        assert (got[key].current_limit, got[key].total_reductions, got[key].total_restorations) == (a.current, a.reductions, a.raises)
        assert 2 <= a.current <= 6


def test_adaptive_rules():
    a = M.Adaptive(4)
    a.failure(0.0, True)
    a.failure(1.0, False)
    assert a.current == 4
    a.failure(2.0, True)
    assert a.current == 3 and a.failures == 0
    a.failure(3.0, True)
    a.failure(4.0, True)
    assert a.current == 3  # within the cool-down
    a.failure(8.0, True)
    assert a.current == 2
    for _ in range(8):
        a.success()
    assert a.current == 3


def test_phases_and_retries(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, None), (float("nan"), -1.0)], "a double, b double")
    timed = M.phases(df, {"A": "a", "B": "b"})
    got = {r.phase: r for r in M.phase_shares(timed, 10.0).collect()}
    assert got["A"].seconds == 3.0 and got["A"].calls == 2 and got["other"].seconds == 7.0 and "B" not in got
    rows = spark.createDataFrame([("HTTP 503", ""), ("bad key", "ReadTimeout"), ("bad key", "ValueError"), (None, None)], "m string, k string").select(M.is_retryable(F.col("m"), F.col("k"))).collect()
    assert [r[0] for r in rows] == [True, True, False, False]


def test_budgets(spark):
    rows = spark.createDataFrame([(50,), (3,), (10,)], "n int").select("n", G.budgets(F.col("n"), (*G.STRATEGIES, "llm")).alias("b")).collect()
    got = {r.n: [b.budget for b in r.b] for r in rows}
    assert got == {50: [13, 13, 12, 12, 12], 3: [1, 1, 1, 1, 1], 10: [3, 3, 2, 2, 2]}


PROGRAM = "int main() { int n; string s; double d[5]; cin >> n >> s; // cin >> z;\n for (int i = 0; i < n; i++) cin >> d[i]; }"


def test_structures(spark):
    rows = [("p", PROGRAM), ("q", ""), ("r", None), ("g", "cin >> a[i][j];"), ("b", "for (;i < m;) ; for (;j < n;) cin >> x[j]; for (;k < z;) cin >> x[k] ; cin >> y [ i ];"), ("k", "long  long v; cin >> v\n>> w; cin >> v;")]
    got = {r.id: r for r in G.structures(spark.createDataFrame(rows, "id string, c string"), "id", "c").collect()}
    assert set(got) == {"p", "q", "g", "b", "k"}
    assert [tuple(r) for r in got["p"].scalars] == [("n", "int"), ("s", "string")] and [tuple(r) for r in got["p"].arrays] == [("d", "double", "n")]
    assert [tuple(r) for r in got["g"].arrays] == [("a", "int", None)] and got["g"].nested == []
    assert [tuple(r) for r in got["b"].arrays] == [("x", "int", "n"), ("y", "int", "z")]
    assert [tuple(r) for r in got["k"].scalars] == [("v", "longlong"), ("w", "int")]


def test_generated_cases_fit_what_is_read(spark):
    rows = [("p", PROGRAM, None), ("q", "", "5 5\n---\n\n---7"), ("r", None, "1"), ("s", "short v; char c; float f; Foo g; cin >> v >> c >> f;", None)]
    df = spark.createDataFrame(rows, "id string, c string, told string")
    got = G.generate(df, "id", "c", 40, (*G.STRATEGIES, "llm"), answer="told").collect()
    assert got == G.generate(df.repartition(3), "id", "c", 40, (*G.STRATEGIES, "llm"), answer="told").orderBy("id", "case").collect() or sorted(got) == sorted(G.generate(df.repartition(3), "id", "c", 40, (*G.STRATEGIES, "llm"), answer="told").collect())
    assert {r.id for r in got} == {"p", "q", "s"} and all(len(r.input) <= X.MAX_INPUT_SIZE and r.input.endswith("\n") for r in got)
    every = G.generate(df, "id", "c", 40).collect()
    assert {(r.id, r.strategy): n for r, n in ((r, sum((x.id, x.strategy) == (r.id, r.strategy) for x in every)) for r in every)} == {(k, s): 10 for k in "pqs" for s in G.STRATEGIES}
    assert {r.input for r in got if r.strategy == "llm"} <= {"5 5\n", "7\n"}
    for r in every:
        lines = r.input.rstrip("\n").split("\n")
        if r.id == "p" and r.input not in X.EDGE_INPUTS:
            assert 1 <= int(lines[0]) <= X.MAX_ARRAY_SIZE and len(lines) == 2 + int(lines[0]) and lines[1].startswith("s") and all("." in x for x in lines[2:])
        if r.id == "s" and r.strategy == "boundary":
            assert int(lines[0]) in {max(-32768, min(32767, v)) for v in X.BOUNDARY_VALUES} and len(lines) == 3 and lines[1].islower()
        if r.strategy == "edge" and r.id != "p":
            assert r.input in X.EDGE_INPUTS
    # The boundary values are shuffled once and then go round.
    shown = {k: [int(r.input.split()[0]) for r in every if (r.id, r.strategy) == (k, "boundary")] for k in "q"}["q"]
    assert set(shown) == set(X.BOUNDARY_VALUES)


def test_mixed_draws_have_seven_boundary_values(spark):
    rows = spark.range(4000).select(G.value(F.lit("int"), F.lit("heuristic"), F.xxhash64("id"), F.lit(None).cast("bigint")).cast("long").alias("v")).collect()
    values = [r.v for r in rows]
    assert {v for v in values if abs(v) > X.RANDOM_REACH} == {1000000, -1000000} and values.count(0) > 900 and 65535 not in values


def test_clamp_and_edges(spark):
    r = spark.range(9).select(G.boundary_value(F.col("id"), "short").alias("s"), G.boundary_value(F.col("id"), "long").alias("l"), G.edge_case(F.col("id")).alias("e")).collect()
    assert max(x.s for x in r) == 32767 and min(x.s for x in r) == -32768 and [x.l for x in r] == list(X.BOUNDARY_VALUES)
    assert [x.e for x in r][:6] == list(X.EDGE_INPUTS)
    parts = spark.createDataFrame([("1\n---\n\n---2 3",)], "a string").select(G.model_cases(F.col("a"))).first()[0]
    assert parts == ["1", "2 3"]


def test_execute_runs_equal_pairs_once(spark):
    cases = spark.createDataFrame([("s", "1", 1), ("s", "1", 2), ("s", "2", 3), ("t", "1", 4)], "source string, input string, i int")

    def make():
        seen = set()

        def run(source, given):
            assert (source, given) not in seen
            seen.add((source, given))
            return B.Outcome(0 if source == "s" else 1, given * 2)

        return run

    got = {r.i: (r.ok, r.output) for r in B.execute(cases, make).collect()}
    assert got == {1: (True, "11"), 2: (True, "11"), 3: (True, "22"), 4: (False, "11")}


def test_commands():
    assert B.run_command(["/bin/sh", "-c", "cat"], "hi").out == "hi"
    assert B.run_command(["/no/such/program"]).code == B.NOT_FOUND
    assert B.run_command(["/bin/sh", "-c", "sleep 5"], seconds=0.2).code == B.TIMED_OUT


def test_ask_retries(spark):
    def make():
        calls = {}

        def client(p):
            calls[p] = calls.get(p, 0) + 1
            if p == "flaky" and calls[p] < 3:
                raise TimeoutError("timeout")
            if p == "never":
                raise ValueError("bad")
            return p.upper()

        return client

    df = spark.createDataFrame([("flaky",), ("never",), ("fine",)], "prompt string")
    got = {r.prompt: (r.answer, r.tries) for r in B.ask(df, make, retryable=lambda e: isinstance(e, TimeoutError), sleep=lambda s: None).collect()}
    assert got == {"flaky": ("FLAKY", 3), "never": (None, 1), "fine": ("FINE", 1)}


@pytest.mark.parametrize("seconds,expected", [(0.0, 1.0 / 0.001), (60.0, 1.0)])
def test_progress(spark, seconds, expected):
    made = M.progress(F.lit(1), F.lit(3), F.lit(seconds), F.lit(2.0))
    r = spark.range(1).select(*[c.alias(n) for n, c in made.items()]).first()
    assert (r.percent, r.remaining, r.eta_seconds) == (33, 2, 4.0) and abs(r.per_minute - expected) < 1e-6


def test_quoted_as_python_does(spark):
    texts = ["a", "it's", 'it\'s "x"', 'say "x"', "tab\t nl\n cr\r back\\slash", ""]
    got = [r.q for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(D.quoted(F.col("t")).alias("q")).collect()]
    assert got == [repr(t) for t in texts]


def test_compact_summary(spark):
    rows = [("p", i, f"{i}\n", None, True, "1", True, "2" if i < 12 else "1") for i in range(14)] + [("q", 0, "x", "1", False, None, True, "1"), ("q", 1, "x", "1", True, "9", True, "1\n"), ("r", 0, "x", None, True, "1", True, "1")]
    facts = spark.createDataFrame(rows, "program string, test_index long, test_input string, expected string, oracle_ok boolean, oracle_output string, candidate_ok boolean, candidate_output string")
    got = {r.program: r.text for r in D.compact_summary(D.judge(facts)).collect()}
    assert got["q"] == "All validated tests passed (1 oracle failures skipped)." and got["r"] == "All tests passed."
    lines = got["p"].split("\n")
    assert lines[0] == "FAILED TEST CASES (5 shown of 12 total):" and lines[1] == "  Test 0: input='0' | expected='1' | got='2'" and len(lines) == 7 and "7 more failures omitted" in lines[-1]
