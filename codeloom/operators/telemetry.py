"""Telemetry of a run: running totals, rolling means, phase timings, caches, retries, the adaptive limit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import fixed as X


def running_sum(df: DataFrame, key: str, bucket: Column, order: list[str], value: str, into: str) -> DataFrame:
    """Running sum per key. Keys are cut into buckets that ascend with the order, such as days: a window adds up within a
    bucket, and the buckets' totals, of which there are few, within a key; a hot key is no single task."""
    rows = df.withColumn("_b", bucket)
    totals = rows.groupBy(key, "_b").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumnsRenamed({key: "_tk", "_b": "_tb"})
    same = F.col(key).eqNullSafe(F.col("_tk")) & F.col("_b").eqNullSafe(F.col("_tb"))
    return rows.withColumn("_s", F.sum(value).over(within)).join(totals, same).withColumn(into, F.col("_s") + F.col("_o")).drop("_b", "_s", "_o", "_tk", "_tb")


#: Successive rows of one key that a task handles when it looks back.
STRETCH = 100_000


def rolling_mean(df: DataFrame, key: str, bucket: Column, order: list[str], value: str, rows: int = X.ROLLING_WINDOW) -> DataFrame:
    """Mean of the last ``rows`` values above 0. Rows are numbered by ``running_sum``; a key is cut into stretches, each with the rows
    before it that its first ones look back to, so a hot key is no single task."""
    placed = running_sum(df.where(F.col(value) > 0).withColumn("_one", F.lit(1)), key, bucket, order, "_one", "_n").drop("_one")
    place = F.col("_n") - 1
    own = F.floor(place / STRETCH)
    both = F.when(place % STRETCH > STRETCH - rows, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_k", F.explode(both))
    w = Window.partitionBy(key, "_k").orderBy("_n").rowsBetween(1 - rows, 0)
    return spread.withColumn("rolling", F.avg(value).over(w)).where(F.col("_k") == own).drop("_n", "_k")


def longest_runs(df: DataFrame, key: str, bucket: Column, order: list[str], outcome: str) -> DataFrame:
    """(key, outcome, longest): the longest run of rows with the same outcome: gaps and islands, by numbers within the key and within
    the key and outcome."""
    rows = running_sum(df.withColumn("_one", F.lit(1)), key, bucket, order, "_one", "_n").withColumn("_ko", F.struct(key, outcome))
    rows = running_sum(rows, "_ko", bucket, order, "_one", "_m").withColumn("_island", F.col("_n") - F.col("_m"))
    return rows.groupBy(key, outcome, "_island").agg(F.count("*").alias("n")).groupBy(key, outcome).agg(F.max("n").alias("longest"))


def session_totals(calls: DataFrame) -> DataFrame:
    """One row of all calls (prompt, completion, seconds, retries): their number, retries, tokens in three sums, and time."""
    return calls.agg(*_call_sums(), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("elapsed"))


def program_totals(calls: DataFrame, key: str) -> DataFrame:
    """The same sums of tokens per program, without retries and time, which only a session counts."""
    return calls.groupBy(key).agg(*_call_sums())


def _call_sums() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [F.count("*").alias("calls"), total("prompt").alias("prompt_tokens"), total("completion").alias("completion_tokens"), total(F.col("prompt") + F.col("completion")).alias("total_tokens")]


def last_messages(log: DataFrame, key: str, order: list[str], message: str, n: int = 5, width: int = 120) -> DataFrame:
    """(key, place, message): the last ``n`` messages of each key in their order, cut to ``width`` characters. Each salted part keeps
    its own last ones before they are ranked together, so a key with very many messages is no single sort."""
    last = [F.desc(c) for c in order]
    salted = log.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(32)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_s").orderBy(*last))).where(F.col("_r") <= n)
    ranked = few.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*last))).where(F.col("_r") <= n)
    return ranked.select(key, (n - F.col("_r") + 1).alias("place"), F.substring(message, 1, width).alias("message"))


def progress(done: Column, total: Column, seconds: Column, mean: Column) -> dict[str, Column]:
    """Percent rounded down, what remains, seconds to go by the mean time, and throughput per minute."""
    left = F.greatest(total - done, F.lit(0))
    minutes = F.greatest(F.when(seconds > 0, seconds / 60.0).otherwise(0.001), F.lit(0.001))
    return {"percent": F.floor(done * 100 / F.greatest(total, F.lit(1))), "remaining": left, "eta_seconds": F.when(done > 0, left * mean).otherwise(0.0), "per_minute": done / minutes}


def phases(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(phase, seconds, calls, mean) of timing columns; only values above 0 are calls. One pass, one aggregate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("phase"), F.col(c).cast("double").alias("v")) for name, c in columns.items()]))
    long = df.select(pairs.alias("p")).select("p.*").where("v > 0 and not isnan(v)")
    return long.groupBy("phase").agg(F.sum("v").alias("seconds"), F.count("*").alias("calls"), F.avg("v").alias("mean"))


def phase_shares(timed: DataFrame, wall: float | Column) -> DataFrame:
    """Adds ``percent`` of the wall time, and a row "other" for what no phase accounts for, never below 0."""
    wall = F.lit(wall) if not isinstance(wall, Column) else wall
    rest = timed.agg(F.greatest(wall - F.coalesce(F.sum("seconds"), F.lit(0.0)), F.lit(0.0)).alias("seconds"))
    rest = rest.select(F.lit("other").alias("phase"), "seconds", F.lit(0).cast("bigint").alias("calls"), F.lit(0.0).alias("mean"))
    return timed.unionByName(rest).withColumn("percent", F.col("seconds") / F.greatest(wall, F.lit(0.001)) * 100)


def cache_outcomes(keys: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(hits, misses, hit_rate) if every distinct key is computed once: the count of rows and of keys says it."""
    sizes = keys.groupBy(*by).agg(F.count("*").alias("n"))
    one = sizes.agg((F.sum("n") - F.count("*")).alias("hits"), F.count("*").alias("misses"))
    return one.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0))


def is_retryable(message: Column, kind: Column) -> Column:
    """Whether an error is transient, by parts of its message or of its class."""
    low, name = F.lower(message), F.lower(kind)
    by_text = F.exists(F.array(*[F.lit(t) for t in X.RETRYABLE_TEXTS]), lambda t: F.contains(low, t))
    by_kind = F.exists(F.array(*[F.lit(t) for t in X.RETRYABLE_CLASS_PARTS]), lambda t: F.contains(name, t))
    return F.coalesce(by_text, F.lit(False)) | F.coalesce(by_kind, F.lit(False))


def backoff_seconds(attempt: Column) -> Column:
    return F.pow(F.lit(2.0), attempt)


@dataclass
class Adaptive:
    """The controller's state for one session. Permits count as free when a reduction is due."""

    most: int
    least: int = X.ADAPTIVE_MIN
    current: int = 0
    failures: int = 0
    successes: int = 0
    last: float | None = None
    reductions: int = 0
    raises: int = 0

    def __post_init__(self):
        self.current = self.current or self.most

    def success(self) -> None:
        self.failures = 0
        self.successes += 1
        if self.successes >= X.ADAPTIVE_SUCCESSES_TO_RAISE and self.current < self.most:
            self.current += 1
            self.raises += 1
            self.successes = 0

    def failure(self, at: float, retryable: bool) -> None:
        if not retryable:
            return
        self.successes = 0
        self.failures += 1
        if self.failures >= X.ADAPTIVE_FAILURES_TO_REDUCE and self.current > self.least and (self.last is None or at - self.last > X.ADAPTIVE_COOLDOWN_SECONDS):
            self.current -= 1
            self.reductions += 1
            self.last = at
            self.failures = 0


def adaptive_limits(calls: DataFrame, most: int) -> DataFrame:
    """(session, calls, current_limit, total_reductions, total_restorations) at the end of each session.

    ``calls`` has session, at (seconds), seq, ok, retryable. The controller is a sequential machine, so a session is followed
    in order; rows stream through a sorted partition and only one session's few numbers are held at a time. A session is the calls
    of one run of a program, which its rate limits bound; one task follows it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state, n, out = None, None, 0, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), type=pa.string()), *[pa.array(list(c), type=pa.int64()) for c in columns[1:]]], names=["session", "calls", "current_limit", "total_reductions", "total_restorations"])

        for batch in batches:
            for s, at, ok, retryable in zip(*(batch.column(c).to_pylist() for c in ("session", "at", "ok", "retryable"))):
                if state is None or s != session:
                    if state is not None:
                        out.append((session, n, state.current, state.reductions, state.raises))
                    session, state, n = s, Adaptive(most), 0
                n += 1
                if ok:
                    state.success()
                else:
                    state.failure(at, retryable)
            if len(out) > 10_000:
                yield flush()
        if state is not None:
            out.append((session, n, state.current, state.reductions, state.raises))
        yield flush()

    ordered = calls.select(F.col("session").cast("string").alias("session"), F.col("at").cast("double").alias("at"), "seq", "ok", "retryable").repartition("session").sortWithinPartitions("session", "at", "seq")
    return ordered.mapInArrow(run, "session string, calls long, current_limit long, total_reductions long, total_restorations long")
