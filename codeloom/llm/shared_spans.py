"""Long spans that stand verbatim in several records (problem 5): compact windows of Cartesian trees, joined on intervals.

The tokens are the hashed q-grams at each character, so that a span of ``length`` characters is a run of ``t = length - q + 1``
tokens. The Cartesian tree over a record's tokens (its root is the least token, the first of equal ones) gives compact windows
``(left, at, right)``: every run of tokens between ``left`` and ``right`` that holds ``at`` has the token at ``at`` as its minimum,
its signature. Only windows at least ``t`` wide are visited; each run of ``t`` tokens lies in exactly one of them.

Two records share a span if and only if two of their windows have the same signature and, laid on each other at ``at``, agree on
``t`` tokens. Hence windows are joined on the signature and on their intervals (the overlap of the aligned windows is at least ``t``
wide), and what is left is verified on the characters. For exact spans one hash function is complete: both records have the same
minimum. More would only serve passages that differ.

What grows with the number of records that share something is not compared pair by pair:

* A window's *context* is what its spans can reach, at most ``2 (t - 1) + q`` characters. Windows with the same signature and
  context (two 64-bit hashes) are one class; inside a class every span is shared, whatever its number of members.
* Classes of one signature are compared with each other only if there are at most ``few``. Beyond that, each class emits the
  hash of each of its at most ``t`` spans, and equal hashes are grouped. Both ways are exact; the second is linear in the number of classes.

``stretches`` and ``shared_spans`` need classes only and no pairs of records. ``sharing_pairs`` and ``partner_stretches`` return pairs by
their definition, so their size is that of their result.

Defined results: null key or text: left out; a text shorter than ``length`` shares nothing; a repeated key is one record per
different text, and what two of these share is not shared with another record; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.lineage import stored
from codeloom.llm import shingles
from codeloom.llm.common import keyed_texts, spread, text_groups

#: Levels of the Cartesian tree that are followed for all records at once; ties make deeper trees, which are followed one by one.
LEVELS = 64


def compact_windows(tokens: np.ndarray, offsets: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record, left, at, right) of all compact windows at least ``t`` wide, ``right`` included, places counted in the record.

    A place is packed below the leading bits of its token, so that one minimum gives both and the first of equal tokens wins. All
    windows of a level are cut at once."""
    sizes = np.diff(offsets)
    bits = np.uint64(max(1, int(sizes.max(initial=1)).bit_length()))
    mask = np.uint64((1 << int(bits)) - 1)
    inside = np.arange(len(tokens)) - np.repeat(offsets[:-1], sizes)
    key = np.append((tokens >> bits << bits) | inside.astype(np.uint64), np.uint64(shingles.MASK64))
    record = np.flatnonzero(sizes >= t)
    lo, hi = offsets[:-1][record], offsets[1:][record]
    out: list[tuple] = []
    level = 0
    while len(lo) and level < LEVELS:
        least = np.minimum.reduceat(key, np.column_stack((lo, hi)).ravel())[::2]
        base = offsets[:-1][record]
        at = base + (least & mask).astype(np.int64)
        out.append((record, lo - base, at - base, hi - base - 1))
        lo, hi = np.column_stack((lo, at + 1)).ravel(), np.column_stack((at, hi)).ravel()
        record = np.repeat(record, 2)
        wide = hi - lo >= t
        record, lo, hi = record[wide], lo[wide], hi[wide]
        level += 1
    out += [_chain(key, mask, t, *node, offsets[node[0]]) for node in zip(record.tolist(), lo.tolist(), hi.tolist())]
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*out))


def _chain(key: np.ndarray, mask: np.uint64, t: int, record: int, lo: int, hi: int, base: int) -> tuple:
    """The windows below one node, all places of its minimum in one step: linear for texts that repeat themselves."""
    out: list[tuple[int, int, int]] = []
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < t:
            continue
        heads = key[lo:hi] & ~mask
        places = lo + np.flatnonzero(heads == heads.min())
        starts = np.concatenate(([lo], places[:-1] + 1))
        kept = hi - starts >= t
        out += [(a, b, hi - 1) for a, b in zip(starts[kept].tolist(), places[kept].tolist())]
        ends = np.append(places, hi)
        starts = np.concatenate(([lo], places + 1))
        gaps = ends - starts >= t
        todo += list(zip(starts[gaps].tolist(), ends[gaps].tolist()))
    rows = np.array(out, dtype=np.int64).reshape(-1, 3) - base
    return np.full(len(rows), record, dtype=np.int64), rows[:, 0], rows[:, 1], rows[:, 2]


def gram_size(length: int) -> int:
    """q for a length: large enough that few records share a gram by chance, small enough that there are few windows."""
    return max(1, length * 3 // 7)


_WINDOWS = "k string, d long, sig long, cls long, at int, a int, b int"


def _signed(length: int, q: int):
    """The compact windows of each record: signature, class, place and how far its context reaches to both sides of the place."""
    t = length - q + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys, ids), texts in _identified(batches):
            flat, offsets = shingles.code_points(texts)
            roll = shingles.Rolling(flat)
            tokens, places = shingles.grams(flat, offsets, q, roll)
            record, left, at, right = compact_windows(tokens, places, t)
            order = np.lexsort((at, record))
            record, left, at, right = record[order], left[order], at[order], right[order]
            a, b = np.minimum(at - left, t - 1), np.minimum(right - at, t - 1)
            flat_at = offsets[record] + at
            with np.errstate(over="ignore"):
                cls = shingles.mix(roll.ranges(flat_at - a, flat_at + b + q) + a.astype(np.uint64) * shingles.MIX_B)
            owner = pa.array(record)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, type=pa.string()).take(owner), pa.array(ids, type=pa.int64()).take(owner), pa.array(tokens[places[record] + at].view(np.int64)), pa.array(cls.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (at, a, b)]],
                names=["k", "d", "sig", "cls", "at", "a", "b"],
            )

    return run


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``text_groups`` of (k, d, t) rows."""

    def paired() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["k", "d"]), batch.column(2)], names=["kd", "t"])

    for pairs, texts in text_groups(paired()):
        yield ([p["k"] for p in pairs], [p["d"] for p in pairs]), texts


_CONTEXTS = "sig long, cls long, a int, b int, least long, most long, many boolean, x string"


def _contexts(q: int):
    """The characters of the contexts that have to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lists = batch.column(1)
            owner = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            rows = lists.flatten()
            at, a, b = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("at", "a", "b"))
            x = [texts[i][s:e] for i, s, e in zip(owner.tolist(), (at - a).tolist(), (at + b + q).tolist())]
            names = ["sig", "cls", "a", "b", "least", "most", "many"]
            yield pa.RecordBatch.from_arrays([*[rows.field(c) for c in names], pa.array(x, type=pa.string())], names=[*names, "x"])

    return run


def common_prefix(x: str, y: str) -> int:
    """Length of the common prefix, by bisection on string comparisons."""
    lo, hi = 0, min(len(x), len(y))
    if x[:hi] == y[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _compared(t: int, q: int):
    """How far two aligned contexts agree to the left and to the right of their place, for those that agree on a whole span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lefts, rights = [], [], []
            for i, (ax, x, ay, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "x", "a2", "x2")))):
                right = common_prefix(x[ax:], y[ay:]) - q
                if right < 0:
                    continue  # equal signatures of different grams
                left = common_prefix(x[:ax][::-1], y[:ay][::-1])
                if left + right >= t - 1:
                    kept.append(i)
                    lefts.append(left)
                    rights.append(right)
            rows = batch.select(["sig", "cls", "cls2"]).take(pa.array(kept, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([-x for x in lefts], type=pa.int32()), pa.array([x - t + 1 for x in rights], type=pa.int32())], names=["sig", "cls", "cls2", "lo", "hi"])

    return run


def _spelled(length: int, t: int):
    """The hash of every span of a context, by the place of its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a, b = batch.column("x").to_pylist(), batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for lo in range(0, len(texts), 2000):
                part = texts[lo : lo + 2000]
                flat, offsets = shingles.code_points(part)
                hashes, places = shingles.grams(flat, offsets, length)
                owner = np.repeat(np.arange(len(part)), np.diff(places))
                place = np.arange(len(hashes)) - places[owner] - a[lo : lo + len(part)][owner]
                rows = batch.select(["sig", "cls", "least", "most"]).slice(lo, len(part)).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(place.astype(np.int32)), pa.array(hashes.view(np.int64))], names=["sig", "cls", "least", "most", "o", "h"])

    return run


class Shared:
    """What the records of a table share.

    ``members`` (k, d, sig, cls, first, last): the windows of class ``cls`` that record ``d`` of key ``k`` has, at places from ``first`` to
    ``last`` whose spans touch. ``links`` (sig, cls, cls2, lo, hi): spans that start from ``lo`` to ``hi`` characters after the place stand in
    windows of both classes; for a class and itself, if it has several keys. Spans that only one key has are left out.
    """

    def __init__(self, df: DataFrame, key: str, text: str, length: int, q: int | None, few: int):
        q = q or gram_size(length)
        t = length - q + 1
        docs = spread(keyed_texts(df, key, text)).select("k", F.xxhash64("k", "t").alias("d"), "t")
        windows = stored(docs.mapInArrow(_signed(length, q), _WINDOWS)).withColumn("o", F.xxhash64("k"))
        met = windows.groupBy("sig").agg(F.min("o").alias("least"), F.max("o").alias("most")).where("least < most").select("sig")
        met = stored(windows.join(met, "sig", "left_semi"))
        classes = met.groupBy("sig", "cls", "a", "b").agg(F.min("o").alias("least"), F.max("o").alias("most"), F.min(F.struct("d", "at", "k")).alias("r"))
        classes = stored(classes)
        sizes = classes.groupBy("sig").agg(F.count("*").alias("m"), F.min("least").alias("l"), F.max("most").alias("g")).where("m > 1 and l < g")
        wanted = classes.join(sizes, "sig").select("r.k", "r.d", F.struct("sig", "cls", F.col("r.at").alias("at"), "a", "b", "least", "most", (F.col("m") > few).alias("many")).alias("w"))
        wanted = wanted.groupBy("k", "d").agg(F.collect_list("w").alias("w"))  # bounded by the record's own length
        contexts = stored(docs.join(wanted, ["k", "d"]).select("t", "w").mapInArrow(_contexts(q), _CONTEXTS))

        x = contexts.where("not many")
        y = x.select("sig", *[F.col(c).alias(c + "2") for c in ("cls", "a", "b", "least", "most", "x")])
        keys = (F.least("least", "least2") < F.greatest("most", "most2")) & (F.col("cls") < F.col("cls2"))
        overlap = F.least("a", "a2") + F.least("b", "b2") >= t - 1
        compared = x.join(y, "sig").where(keys & overlap).select("sig", "cls", "cls2", "a", "x", "a2", "x2").mapInArrow(_compared(t, q), "sig long, cls long, cls2 long, lo int, hi int")
        own = classes.where("least < most").select("sig", "cls", F.col("cls").alias("cls2"), (-F.col("a")).alias("lo"), (F.col("b") - (t - 1)).alias("hi"))
        self.near = stored(own.unionByName(compared))
        spelled = contexts.where("many").mapInArrow(_spelled(length, t), "sig long, cls long, least long, most long, o int, h long")
        groups = spelled.groupBy("sig", "h").agg(F.count("*").alias("n"), F.min("least").alias("l"), F.max("most").alias("g")).where("n > 1 and l < g").select("sig", "h")
        self.spelled = stored(spelled.join(groups, ["sig", "h"]).select("sig", "cls", "least", "most", "o", "h"))

        # Places of one class in one record whose spans touch are one row, so that a text that repeats itself has few.
        by = Window.partitionBy("k", "d", "sig", "cls").orderBy("at")
        fresh = met.select("k", "d", "sig", "cls", "at", F.coalesce(F.col("at") - F.lag("at").over(by) > length, F.lit(True)).cast("int").alias("new"))
        numbered = fresh.withColumn("i", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        self.members = numbered.groupBy("k", "d", "sig", "cls", "i").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("i")
        self.docs, self.length = docs, length

    def covered(self) -> DataFrame:
        """(sig, cls, lo, hi): the spans of each class that another key has, too."""
        near = self.near.select("sig", "cls", "lo", "hi").union(self.near.where("cls <> cls2").select("sig", "cls2", "lo", "hi"))
        return near.union(_ranges(self.spelled.select("sig", "cls", "o"))).distinct()

    def links(self) -> DataFrame:
        """(sig, cls, cls2, lo, hi), also of the signatures with many classes."""
        x = self.spelled
        y = x.select("sig", "h", *[F.col(c).alias(c + "2") for c in ("cls", "least", "most")])
        far = x.join(y, ["sig", "h"]).where((F.col("cls") < F.col("cls2")) & (F.least("least", "least2") < F.greatest("most", "most2"))).select("sig", "cls", "cls2", "o")
        return self.near.unionByName(_ranges(far))


def _ranges(df: DataFrame) -> DataFrame:
    """Successive numbers ``o`` of each group of the other columns as ranges ``lo`` to ``hi``."""
    by = [c for c in df.columns if c != "o"]
    run = F.col("o") - F.row_number().over(Window.partitionBy(*by).orderBy("o"))
    return df.distinct().withColumn("_run", run).groupBy(*by, "_run").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).drop("_run")


def _merged(stretches: DataFrame, by: list[str]) -> DataFrame:
    """The stretches ``start`` to ``end`` of each group that overlap or touch put together."""
    w = Window.partitionBy(*by).orderBy("start")
    rows = stretches.groupBy(*by, "start").agg(F.max("end").alias("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    numbered = fresh.withColumn("i", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("i")


def _places(lo: str, hi: str, length: int) -> list:
    return [(F.col("first") + F.col(lo)).cast("long").alias("start"), (F.col("last") + F.col(hi) + length).cast("long").alias("end")]


def sharing_pairs(df: DataFrame, key: str, text: str, length: int = 300, q: int | None = None, few: int = 32) -> DataFrame:
    """(a, b): pairs a < b with at least ``length`` successive characters in common."""
    shared = Shared(df, key, text, length, q, few)
    links = shared.links().select("sig", "cls", "cls2").distinct()
    x = shared.members.select("sig", "cls", "k").distinct()
    y = x.select("sig", F.col("cls").alias("cls2"), F.col("k").alias("k2"))
    # Within a class each pair is met in both orders; of these one is enough.
    met = links.join(x, ["sig", "cls"]).join(y, ["sig", "cls2"]).where("k <> k2 and (cls <> cls2 or k < k2)")
    return met.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).distinct()


def partner_stretches(df: DataFrame, key: str, text: str, length: int = 300, q: int | None = None, few: int = 32) -> DataFrame:
    """(k, partner, start, end): the merged stretches of each record that also stand in the partner; each pair in both orders."""
    shared = Shared(df, key, text, length, q, few)
    links = shared.links()
    both = links.union(links.where("cls <> cls2").select("sig", "cls2", "cls", "lo", "hi"))
    partners = shared.members.select("sig", F.col("cls").alias("cls2"), F.col("k").alias("partner")).distinct()
    met = both.join(shared.members, ["sig", "cls"]).join(partners, ["sig", "cls2"]).where("k <> partner")
    return _merged(met.select("k", "d", "partner", *_places("lo", "hi", length)), ["k", "d", "partner"]).drop("d")


def _stretches(shared: Shared) -> DataFrame:
    met = shared.covered().join(shared.members, ["sig", "cls"])
    return _merged(met.select("k", "d", *_places("lo", "hi", shared.length)), ["k", "d"])


def stretches(df: DataFrame, key: str, text: str, length: int = 300, q: int | None = None, few: int = 32) -> DataFrame:
    """(k, start, end): the merged stretches of each record that also stand in another one."""
    return _stretches(Shared(df, key, text, length, q, few)).drop("d")


def shared_spans(df: DataFrame, key: str, text: str, length: int = 300, q: int | None = None, few: int = 32) -> DataFrame:
    """(k, n_chars, n_spans, shared_chars, shared_share): how much of each record also stands in another one. Records that share
    nothing have zeros; a repeated key has one row per different text."""
    shared = Shared(df, key, text, length, q, few)
    merged = _stretches(shared).groupBy("k", "d").agg(F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    sizes = shared.docs.select("k", "d", F.length("t").cast("long").alias("n_chars")).groupBy("k", "d").agg(F.max("n_chars").alias("n_chars"))
    out = sizes.join(merged, ["k", "d"], "left").drop("d").na.fill(0, ["n_spans", "shared_chars"])
    return out.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
