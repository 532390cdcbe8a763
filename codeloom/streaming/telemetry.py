"""The same telemetry over streams of calls: (ts, session, tokens, seconds, ok, retryable, phase)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.operators.telemetry import Adaptive, progress


def token_totals(calls: DataFrame) -> DataFrame:
    """Totals per session; for the update or complete mode."""
    return calls.groupBy("session").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def windowed_tokens(calls: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Totals per tumbling window, final once the watermark has passed it. This is an extension of ours."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), "calls", "tokens")


def phase_totals(calls: DataFrame) -> DataFrame:
    return calls.where("seconds > 0").groupBy("phase").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("calls"))


def session_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy().agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum("tokens").alias("tokens"))


def skip_counts(failures: DataFrame, threshold: int = 2) -> DataFrame:
    """Programs that failed at least ``threshold`` times, whatever happened in between."""
    return failures.groupBy("program").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("reason", "ts").alias("reason")).where(F.col("count") >= threshold)


def adaptive_limits(calls: DataFrame, most: int, idle_seconds: int | None = None) -> DataFrame:
    """(session, calls, current_limit, total_reductions, total_restorations), updated with every batch. A session's state is
    a few numbers; a batch's calls are followed in the order of their time. A query that runs on should drop sessions that have been
    idle for so many seconds; one that ends with what is there needs no such time, and would go on waiting for it."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if idle_seconds is not None:
            state.setTimeoutDuration(idle_seconds * 1000)
        n, current, failures, successes, last, reductions, raises = state.get if state.exists else (0, most, 0, 0, -1.0, 0, 0)
        a = Adaptive(most, current=current, failures=failures, successes=successes, last=None if last < 0 else last, reductions=reductions, raises=raises)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        for at, ok, retryable in zip(rows["at"], rows["ok"], rows["retryable"]):
            n += 1
            if ok:
                a.success()
            else:
                a.failure(at, retryable)
        state.update((n, a.current, a.failures, a.successes, -1.0 if a.last is None else a.last, a.reductions, a.raises))
        yield pd.DataFrame({"session": [key[0]], "calls": [n], "current_limit": [a.current], "total_reductions": [a.reductions], "total_restorations": [a.raises]})

    out = "session string, calls long, current_limit long, total_reductions long, total_restorations long"
    state = "n long, current long, failures long, successes long, last double, reductions long, raises long"
    return calls.groupBy("session").applyInPandasWithState(follow, out, state, "update", GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout)


def dashboard(calls: DataFrame, totals: DataFrame, write: Callable[[DataFrame, int], None]):
    """A writer (``.start()``) that gives ``write`` the progress of every session that a batch has changed: calls done and failed, mean
    seconds, percent, what remains, seconds to go and calls per minute. ``totals`` (session, total) is what there is to do."""
    state = calls.groupBy("session").agg(F.count("*").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.avg("seconds").alias("mean"), F.sum("seconds").alias("spent"), F.max("ts").alias("last_seen"))

    def show(batch: DataFrame, number: int) -> None:
        rows = batch.join(totals, "session", "left").withColumn("total", F.coalesce("total", "done"))
        made = progress(F.col("done"), F.col("total"), F.coalesce("spent", F.lit(0.0)), F.coalesce("mean", F.lit(0.0)))
        write(rows.select("session", "done", "failed", "total", "mean", "last_seen", *[c.alias(n) for n, c in made.items()]), number)

    return state.writeStream.outputMode("update").foreachBatch(show)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Everything that is there into a table in memory, resumable from the checkpoint."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
