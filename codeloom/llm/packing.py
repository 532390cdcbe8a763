"""Filling containers of fixed capacity with texts (problem 8): mixture-controlled packing.

Each source has a queue of items, in the order of a hash of their keys. Deficit round-robin serves the queues window by
window: in every window a source earns credit for its share of the window's tokens, serves items while its credit
lasts and carries the rest over. Served that way, an item with running total C in its queue falls into the first
window w with w * credit >= C. The running total is a prefix sum that runs over salted parts of each
queue, so a source with a third of all items is no single task, and deficits carry over windows and partitions alike.
The shares are target proportions if such are given, else the natural ones. No text is repeated or dropped: when a source runs
out, later windows hold the others only, each still at its own credit, and so fewer tokens.

The items of a window are packed by best fit, largest first. A window holds the tokens of ``containers`` containers; windows
are packed independently, so that each keeps its mixture, and of each only the last container or two stay badly filled.

Only an item longer than a container is cut: whole containers first, and the rest is packed like an item.

Defined results: a null or empty text has no tokens, is never dropped and lies in a container with 0 tokens;
null sources form one queue; a repeated key gives rows for each of its texts; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.lineage import stored
from codeloom.llm.common import spread

#: Fixed value: the published pattern that splits text before the merges of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"


def load_encoder(path: str):
    """Encoder of a byte-level vocabulary file with one base64 token and its rank per line."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(hashlib.md5(path.encode()).hexdigest(), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, type=pa.int64())], names=["k", "source", "n"])

    return run


def token_counts(df: DataFrame, key: str, text: str, source: str, vocabulary: str) -> DataFrame:
    """(k, source, n) for every row with a key. The vocabulary, a file of the driver, is sent to the executors."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"), F.col(f"`{text}`").cast("string").alias("t")).where("k is not null")
    return spread(rows).mapInArrow(counter(os.path.basename(vocabulary)), "k long, source string, n long")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item, largest items first, each into the fullest container that has room."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rooms: list[int] = []  # distinct free sizes, sorted
    by_room: dict[int, list[int]] = {}
    out, used = [0] * len(sizes), 0
    for i in order:
        at = bisect_left(rooms, sizes[i])
        if at < len(rooms):
            room = rooms[at]
            box = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        else:
            room, box = capacity, used
            used += 1
        out[i] = box
        room -= sizes[i]
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(box)
    return out


def assign_windows(items: DataFrame, window_tokens: int, part_rows: int = 100_000, targets: dict[str, float] | None = None) -> DataFrame:
    """Adds ``w``, the window in which deficit round-robin serves the item (k, source, n). ``targets`` has the wanted weight of
    sources among the tokens of a window; a source that is not named weighs as much as its share of all tokens."""
    if targets and min(targets.values()) <= 0:
        raise ValueError("a target proportion is above 0")
    totals = items.groupBy("source").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    every = totals.agg(F.sum("tokens").alias("all"))
    totals = totals.crossJoin(F.broadcast(every)).select("source", F.ceil(F.col("rows") / part_rows).cast("int").alias("salts"), (F.col("tokens") / F.greatest("all", F.lit(1))).alias("weight"))
    if targets:
        wanted = items.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, wanted double")
        totals = totals.join(wanted, "source", "left").withColumn("weight", F.when(F.col("weight") > 0, F.coalesce("wanted", "weight")).otherwise(0.0)).drop("wanted")
        totals = totals.crossJoin(F.broadcast(totals.agg(F.sum("weight").alias("weights")))).withColumn("weight", F.col("weight") / F.greatest("weights", F.lit(1e-300))).drop("weights")
    totals = totals.withColumn("credit", F.col("weight") * window_tokens).drop("weight")
    salted = items.join(totals, "source").withColumn("salt", F.pmod(F.xxhash64("k", F.lit(3)), F.col("salts")))
    within = Window.partitionBy("source", "salt").orderBy(F.xxhash64("k"), "k", "n")
    running = salted.withColumn("c", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = salted.groupBy("source", "salt").agg(F.sum("n").alias("part"))
    before = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "salt", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("before"))
    placed = running.join(parts, ["source", "salt"]).withColumn("total", F.col("c") + F.col("before"))
    # A source without tokens earns nothing; its items are spread over windows by their salt.
    w = F.when(F.col("credit") > 0, F.ceil(F.col("total") / F.col("credit") - 1e-9)).otherwise(F.col("salt") + 1)
    return placed.select("k", "source", "n", F.greatest(w, F.lit(1)).cast("long").alias("w"))


def _packer(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "start", "n"], kind="stable")
        return pdf.assign(box=pd.Series(best_fit(pdf["n"].tolist(), capacity), index=pdf.index, dtype="int64"))

    return run


def pack(counted: DataFrame, capacity: int = 2048, containers: int = 512, targets: dict[str, float] | None = None) -> DataFrame:
    """(window, container, k, source, start, n) of (k, source, n): tokens start .. start + n of item k lie in container. Whole containers
    of long items belong to the window that serves the item."""
    # Counted once: the totals, the running sums and the pieces all need it, and texts are not needed again.
    served = stored(assign_windows(stored(counted), containers * capacity, targets=targets))
    whole = F.floor(F.col("n") / capacity)
    cut = served.withColumn("whole", F.when(F.col("n") > capacity, whole).otherwise(0).cast("int"))
    heads = cut.where("whole > 0").select("k", "source", "w", F.posexplode(F.array_repeat(F.lit(0), F.col("whole"))).alias("i", "z"))
    heads = heads.select(F.col("w").alias("window"), F.concat_ws("-", F.lit("long"), "k", "i").alias("container"), "k", "source", (F.col("i").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n"))
    rest = cut.select("k", "source", "w", (F.col("whole").cast("long") * capacity).alias("start"), (F.col("n") - F.col("whole") * capacity).cast("long").alias("n"), "whole").where("n > 0 or whole = 0").drop("whole")
    packed = rest.groupBy("w").applyInPandas(_packer(capacity), "k long, source string, w long, start long, n long, box long")
    packed = packed.select(F.col("w").alias("window"), F.concat_ws("-", F.lit("w"), "w", "box").alias("container"), "k", "source", "start", "n")
    return heads.unionByName(packed)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(window, containers, tokens, fill) of each window."""
    rows = packed.groupBy("window").agg(F.count_distinct("container").alias("containers"), F.sum("n").alias("tokens"))
    return rows.withColumn("fill", F.col("tokens") / (F.col("containers") * F.lit(capacity)))


def mixture(packed: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(source, target, windows, least, mean, most): the wanted share of each source, and the shares that it reached in the windows before
    the first source runs out; without targets the natural share is wanted."""
    by = packed.groupBy("window", "source").agg(F.sum("n").alias("n"))
    totals = by.groupBy("source").agg(F.sum("n").alias("all"), F.max("window").alias("last")).where(F.col("all") > 0)
    weight = F.col("all").cast("double")
    if targets:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col("source")], F.col("all") / F.sum("all").over(Window.partitionBy(F.lit(0))))
    totals = totals.withColumn("weight", weight)
    whole = totals.agg(F.sum("weight").alias("weights"), F.min("last").alias("first_end"))
    sizes = by.groupBy("window").agg(F.sum("n").alias("tokens"))
    full = sizes.crossJoin(F.broadcast(whole)).where("window < first_end").select("window", "tokens")
    shares = by.join(full, "window").groupBy("source").agg(F.count("*").alias("windows"), *[f(F.col("n") / F.col("tokens")).alias(c) for c, f in (("least", F.min), ("mean", F.avg), ("most", F.max))])
    return totals.crossJoin(F.broadcast(whole)).select("source", (F.col("weight") / F.col("weights")).alias("target")).join(shares, "source", "left").na.fill(0, ["windows"])
