import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codeloom.operators.telemetry import Adaptive
from codeloom.sources import files as S
from codeloom.streaming import telemetry as T


def test_corpus_reader(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "x.CPP").write_bytes("é\r\nb".encode())
    (tmp_path / "a" / ".git" / "y.cpp").write_text("no")
    (tmp_path / "a" / "z.h").write_text("no")
    rows = S.read_corpus(spark, str(tmp_path)).collect()
    assert [(r.rel, r.text, r.length) for r in rows] == [("a/x.CPP", "é\nb", 5)]
    assert {r.rel for r in S.listing(spark, str(tmp_path)).collect()} >= {"a/x.CPP", "a/z.h"}


def test_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"\nnext', 1)], "p string, q string, n int")
    S.write_report(df, str(tmp_path / "r"))
    assert [tuple(r) for r in S.read_report(spark, str(tmp_path / "r")).collect()] == [("a,b", 'say "x"\nnext', "1")]
    assert S.read_report(spark, str(tmp_path / "none"), S.DETAIL).count() == 0


def test_archive_is_not_overwritten(spark, tmp_path):
    df = spark.range(1)
    assert S.archive(df, str(tmp_path), 10, True).endswith("EXP_10_REPAIR")
    with pytest.raises(AnalysisException):
        S.archive(df, str(tmp_path), 10, True)
    assert S.archive_name(None, False) == "EXP_ALL"


def test_lists_and_plans(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# c\n\nalgo  https://x/y  extra\nalone\n")
    assert [tuple(r) for r in S.read_repositories(spark, str(tmp_path / "r.txt")).collect()] == [("algo", "https://x/y")]
    (tmp_path / "p.json").write_text(json.dumps({"experiments": [{"limit": 5, "repair": True}, {"limit": "all", "seed": 0}]}))
    plan = S.read_plan(spark, str(tmp_path / "p.json")).orderBy("place").collect()
    assert [(r.limit, r.repair, r.seed) for r in plan] == [("5", True, None), ("all", None, 0)]
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(ValueError):
        S.read_plan(spark, str(tmp_path / "bad.json"))
    (tmp_path / "s.json").write_text(json.dumps({"p": "old", "q": {"reason": "r", "count": 3, "stage": "s"}}))
    got = {r.program: (r.reason, r["count"]) for r in S.read_skip_list(spark, str(tmp_path / "s.json")).collect()}
    assert got == {"p": ("old", 1), "q": ("r", 3)}


def test_latest_run_and_clone_status(spark, tmp_path):
    for name in ("run_1/csv", "run_2/csv", "run_3"):
        (tmp_path / name).mkdir(parents=True)
    assert S.latest_run(spark, str(tmp_path)).endswith("run_2") and S.latest_run(spark, str(tmp_path / "no")) is None
    rows = spark.createDataFrame([(0, None), (1, "already exists"), (1, "Repository Not Found"), (1, "x")], "c int, m string").select(S.clone_status(F.col("c"), F.col("m"))).collect()
    assert [r[0] for r in rows] == ["success", "exists", "404", "error"]


def test_cache_appends_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    S.append_cache(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int").limit(1), path, ["k"])
    S.append_cache(spark.createDataFrame([("a", 9), ("b", 3)], "k string, v int"), path, ["k"])
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 3}


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_token_stream_resumes(spark, tmp_path):
    schema = "ts timestamp, session string, tokens long, seconds double, ok boolean, phase string"
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1, 1.0, True, "x"), ("2024-01-01 00:01:00", "a", 2, 0.0, False, "x")], schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    df = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = T.run_available(T.token_totals(df), "tokens1", str(tmp_path / "c1"))
    assert [tuple(r) for r in out.collect()] == [("a", 2, 3)]
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    assert [tuple(r) for r in T.run_available(T.token_totals(df), "tokens1", str(tmp_path / "c1")).collect()] == [("a", 4, 6)]
    assert T.run_available(T.phase_totals(df), "phases1", str(tmp_path / "c2")).first().calls == 2
    assert T.run_available(T.session_stats(df), "session1", str(tmp_path / "c3")).first().failed == 2
    assert T.run_available(T.windowed_tokens(df), "windows1", str(tmp_path / "c4"), "append").count() == 0  # still within the watermark


def test_adaptive_stream_equals_the_batch(spark, tmp_path):
    rows = [("s", float(i * 3), i, i % 3 == 0, True) for i in range(60)]
    df = _stream(spark, tmp_path, rows, "session string, at double, seq long, ok boolean, retryable boolean")
    got = T.run_available(T.adaptive_limits(df, 6), "adaptive1", str(tmp_path / "c"), "update").collect()
    a = Adaptive(6)
    for _, at, _, ok, r in rows:
        a.success() if ok else a.failure(at, r)
    assert max(got, key=lambda r: r.calls).current_limit == a.current


def test_dashboard(spark, tmp_path):
    schema = "ts timestamp, session string, seconds double, ok boolean"
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a", 2.0, True), ("2024-01-01 00:01:00", "a", 4.0, False), ("2024-01-01 00:01:00", "b", 1.0, True)], schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    shown = []
    totals = spark.createDataFrame([("a", 4)], "session string, total long")
    query = T.dashboard(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), totals, lambda df, n: shown.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.session: r for r in shown}
    assert (got["a"].done, got["a"].failed, got["a"].percent, got["a"].remaining, got["a"].eta_seconds, got["a"].per_minute) == (2, 1, 50, 2, 6.0, 20.0)
    assert got["b"].percent == 100 and got["b"].remaining == 0
