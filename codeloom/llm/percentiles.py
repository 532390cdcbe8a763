"""Exact percentiles per group over any number of values (problem 1): one distributed sort.

All values of all metrics are sorted once by (metric, group, value) over range partitions. Rows with the same value are split
by a hash of their row, so that neither a group nor a single value with a third of all rows is one task. A group that begins and
ends inside a partition is finished there: the values at the wanted positions are picked and interpolated. Only
the first and the last group of a partition can go on in another one. Their rows are passed on with their place in the partition;
the counts of these at most two groups per partition give the offset and the total of every group that crosses a border, and
with them the rows at the wanted positions. The error is zero.

Python holds at most ``HELD`` rows of a group; a longer one is passed on like those that cross a border.

To combine days or runs, ``value_counts`` gives a mergeable form, the distinct values with their counts; tables of it
are united and summed (``merge``), and ``percentiles`` takes its counts as weights. The result is the same as
from the raw rows.

Defined results: a value that is null, NaN, infinite or negative is no measurement; zero is one. A row that was delivered
several times with every column equal counts once (``deduplicate``). A null group is a group of its own. A group
without measurements gives no row. Ties need no rule, as equal values are interchangeable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.lineage import partitions_for, stored
from codeloom.llm.common import spread

PERCENTS = (5.0, 25.0, 50.0, 75.0, 95.0, 99.0)
#: Rows of one group that are held until it is known where the group ends.
HELD = 1_000_000
#: Ranges into which the rows of one value can be split.
TIES = 1 << 15


def deduplicate(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` of the rows, rows that are equal in every column of ``df`` once, and ``tie``, part of the row's hash. Two 64-bit
    hashes stand for the columns that are not kept, so that the shuffle carries no wide rows."""
    df = spread(df)
    every = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) for c in df.columns]
    hashed = df.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(*every).alias("_h1"), F.xxhash64(F.lit(7), *reversed(every)).alias("_h2"))
    return hashed.groupBy("_h1", "_h2").agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in keep]).withColumn("tie", F.pmod("_h1", F.lit(TIES)).cast("int")).drop("_h1", "_h2")


def measurements(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """(metric, g, value, weight, tie): the values that are measurements; ``tie`` is that of ``deduplicate``, if there is one."""
    tie = F.col("tie") if dict(df.dtypes).get("tie") == "int" else F.lit(0)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics]))
    long = df.select(F.col(f"`{group}`").cast("string").alias("g"), tie.alias("tie"), pairs.alias("p")).select("p.metric", "g", "p.value", "tie")
    return long.where("value >= 0 and value < double('infinity') and not isnan(value)").select("metric", "g", "value", F.lit(1).cast("long").alias("weight"), "tie")


def value_counts(long: DataFrame) -> DataFrame:
    """The mergeable form: each distinct value of a (metric, g) with its number."""
    return long.groupBy("metric", "g", "value").agg(F.sum("weight").alias("weight"))


def merge(*parts: DataFrame) -> DataFrame:
    """Value counts of several days, runs or partitions put together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return value_counts(out)


def _runs(batches: Iterator[pa.RecordBatch]):
    """(metric, g, values, weights) of successive runs of a sorted partition; a run that crosses batches comes in pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        m, g = batch.column("metric").dictionary_encode(), batch.column("g").dictionary_encode()
        mi = m.indices.to_numpy(zero_copy_only=False)
        gi = g.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], (mi[1:] != mi[:-1]) | (gi[1:] != gi[:-1]))))
        ends = np.append(starts[1:], batch.num_rows)
        values, weights = batch.column("value").to_numpy(), batch.column("weight").to_numpy()
        metrics, groups = m.dictionary.to_pylist(), g.dictionary.to_pylist()
        for a, b in zip(starts.tolist(), ends.tolist()):
            yield (metrics[mi[a]], None if gi[a] < 0 else groups[gi[a]]), values[a:b], weights[a:b]


_PICKED = "metric string, g string, n long, percent double, part double, pid int, value double, before long, weight long"


class _Picker:
    """The rows that one sorted partition gives: (metric, g, n, percent, part) of groups that end inside, and
    (metric, g, pid, value, before, weight) of groups that may go on elsewhere; ``before`` counts what precedes in the partition."""

    def __init__(self, percents: tuple[float, ...]):
        self.share = np.array(percents) / 100.0
        self.percents = np.array(percents)

    def finish(self, values: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum(weights)
        total = int(ends[-1])
        place = self.share * (total - 1)
        low = np.floor(place).astype(np.int64)
        at = np.searchsorted(ends, np.stack((low, np.minimum(low + 1, total - 1))), side="right")
        part = place - low
        return [np.full(len(place), total), self.percents, values[at[0]] * (1.0 - part) + values[at[1]] * part]

    def done(self, keys: list, rows: list) -> pa.RecordBatch:
        each = len(self.percents)
        n, percent, part = (np.concatenate(c) for c in zip(*rows))
        owner = pa.array(np.repeat(np.arange(len(keys)), each))
        names = [pa.array([k[i] for k in keys], type=pa.string()).take(owner) for i in (0, 1)]
        none = [pa.nulls(len(n), t) for t in (pa.int32(), pa.float64(), pa.int64(), pa.int64())]
        return self.batch([*names, pa.array(n.astype(np.int64)), pa.array(percent), pa.array(part), *none])

    def open(self, key: tuple, pid: int, values: np.ndarray, weights: np.ndarray, before: int) -> pa.RecordBatch:
        n = len(values)
        names = [pa.array([k] * n, type=pa.string()) for k in key]
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.float64(), pa.float64())]
        return self.batch([*names, *none, pa.array(np.full(n, pid, dtype=np.int32)), pa.array(values), pa.array(before + np.cumsum(weights) - weights), pa.array(weights)])

    @staticmethod
    def batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, names=["metric", "g", "n", "percent", "part", "pid", "value", "before", "weight"])

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        key, held, rows, before, passing = None, [], 0, 0, True  # the first group may have begun elsewhere
        keys, made = [], []
        for at, values, weights in _runs(batches):
            if at != key:
                if key is not None and not passing:
                    keys.append(key)
                    made.append(self.finish(*(np.concatenate(c) for c in zip(*held))))
                    if len(keys) >= 5000:
                        yield self.done(keys, made)
                        keys, made = [], []
                passing = key is None
                key, held, rows, before = at, [], 0, 0
            held.append((values, weights))
            rows += len(values)
            if passing or rows > HELD:
                passing = True
                for v, w in held:
                    yield self.open(key, pid, v, w, before)
                    before += int(w.sum())
                held = []
        for v, w in held:
            yield self.open(key, pid, v, w, before)
            before += int(w.sum())
        if keys:
            yield self.done(keys, made)


def percentiles(long: DataFrame, percents: tuple[float, ...] = PERCENTS, partitions: int | None = None) -> DataFrame:
    """(metric, g, n, percent, value) of (metric, g, value, weight), linear between neighbouring order statistics."""
    tie = F.col("tie") if "tie" in long.columns else F.lit(0)
    ordered = long.select("metric", "g", "value", "weight", tie.alias("tie"))
    ordered = ordered.repartitionByRange(partitions or partitions_for(long), "metric", "g", "value", "tie").sortWithinPartitions("metric", "g", "value").drop("tie")
    # Stored, as both what is done and what is open are read from one state of the partitions.
    picked = stored(ordered.mapInArrow(_Picker(tuple(percents)).run, _PICKED))
    rest = picked.where("pid is not null")
    # At most two groups per partition, and those longer than HELD.
    sizes = rest.groupBy("metric", "g", "pid").agg(F.sum("weight").alias("size"))
    earlier = Window.partitionBy("metric", "g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("metric", "g")
    offsets = sizes.select("metric", F.col("g").alias("g0"), "pid", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"), F.sum("size").over(every).alias("total"))
    placed = rest.drop("n", "percent", "part").join(offsets.withColumnsRenamed({"metric": "m0", "pid": "p0"}), (F.col("metric") == F.col("m0")) & F.col("g").eqNullSafe(F.col("g0")) & (F.col("pid") == F.col("p0")))
    start = F.col("offset") + F.col("before")
    place = [F.lit(p / 100.0) * (F.col("total") - 1) for p in percents]
    picks = []
    for p, x in zip(percents, place):
        low = F.floor(x)
        high = F.least(low + 1, F.col("total") - 1)
        inside = lambda r: (r >= start) & (r < start + F.col("weight"))
        weight = F.when(inside(low), 1.0 - (x - low)).otherwise(0.0) + F.when(inside(high), x - low).otherwise(0.0)
        picks.append(F.when(inside(low) | inside(high), F.struct(F.lit(float(p)).alias("percent"), (F.col("value") * weight).alias("part"))))
    met = placed.select("metric", "g", F.col("total").alias("n"), F.explode(F.array_compact(F.array(*picks))).alias("p")).select("metric", "g", "n", "p.percent", "p.part")
    met = met.groupBy("metric", "g", "n", "percent").agg(F.sum("part").alias("value"))
    return picked.where("pid is null").select("metric", "g", "n", "percent", F.col("part").alias("value")).unionByName(met)


def program_percentiles(df: DataFrame, group: str, metrics: list[str], percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    """(group, metric, n, p5, p25, ...): one row per group and metric."""
    rows = deduplicate(df, [group, *metrics])
    tall = percentiles(measurements(rows, group, metrics), percents)
    named = [F.max(F.when(F.col("percent") == F.lit(p), F.col("value"))).alias("p" + f"{p:g}".replace(".", "_")) for p in percents]
    return tall.groupBy("metric", "g", "n").agg(*named).withColumnRenamed("g", group)
