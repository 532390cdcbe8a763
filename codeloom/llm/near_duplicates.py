"""Records that share most of their content (problem 4): MinHash banding, then exact verification.

``bands x rows`` MinHash values of the set of n-grams are computed per record in one vectorised pass over the
text. The number of bands follows from the wanted recall at the threshold. Records are shuffled on their band
hashes; two records that meet in a band, and whose set sizes allow the threshold at all, form a candidate. A band that very many
records share is cut into blocks of about ``BLOCK`` records, of which each two meet on their own, so that no band is one task; such
bands are looked for in a sample, which decides the layout alone and nothing in the result. Each candidate is verified on the full n-gram sets, so that banding decides only what is looked at.

Records with the same n-gram set are collapsed before banding: a hot group of copies enters the buckets as one
record, and is put back into the result afterwards.

Defined results: records with null key or text are left out; a record with fewer tokens than ``n`` has no n-gram and
is similar to nothing; a repeated key counts once (its smallest text by hash order is irrelevant: keys are meant
to be unique, and each differing text of a key is compared); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.lineage import stored
from codeloom.llm import shingles
from codeloom.llm.common import checkpointed, keyed_texts, spread, text_groups

#: Records of a band that are compared with each other, or with those of another block, by one task.
BLOCK = 1000
#: One of so many records is looked at for bands that have to be cut, and how often a band has to be seen.
SAMPLED, SEEN = 64, 32
#: Cut bands, of two numbers each, that are broadcast; were there more, they would be joined.
MOST_BROADCAST = 500_000


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` values so that a pair at the threshold meets in one with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(1, 1 << 32, count, dtype=np.uint32), draw.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhashes(sets: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values per set, as rows. The sets must not be empty."""
    xors, factors = seeds(count)
    low = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(offsets) - 1, count), dtype=np.uint32)
    scratch = np.empty_like(low)
    starts = offsets[:-1]
    for i in range(count):
        np.bitwise_xor(low, xors[i], out=scratch)
        np.multiply(scratch, factors[i], out=scratch)
        out[:, i] = np.minimum.reduceat(scratch, starts)
    return out


def band_hashes(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band, salted with its number."""
    h = np.zeros((len(mins), bands), dtype=np.uint64)
    parts = mins.reshape(len(mins), bands, rows).astype(np.uint64)
    for r in range(rows):
        h = shingles.mix(h * shingles.BASE + parts[:, :, r] + np.uint64(r + 1))
    return shingles.mix(h + np.arange(bands, dtype=np.uint64) * shingles.MIX_A)


def signer(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches, 400_000):
            hashes, offsets = shingles.shingle_sets(texts, n)
            some = np.flatnonzero(np.diff(offsets) > 0)
            if not len(some):
                continue
            sizes = np.diff(offsets)[some]
            ends = np.zeros(len(some) + 1, dtype=np.int64)
            np.cumsum(sizes, out=ends[1:])
            # Empty sets hold no values, so leaving them out does not move the others.
            with np.errstate(over="ignore"):
                bits = band_hashes(minhashes(hashes, ends, bands * rows), bands, rows)
                total = np.add.reduceat(hashes, ends[:-1])
                crossed = np.bitwise_xor.reduceat(shingles.mix(hashes.copy()), ends[:-1])
            flat = pa.array(bits.astype(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, bands), type=pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in some], type=pa.string()), pa.array(sizes), pa.array(total.astype(np.int64)), pa.array(crossed.astype(np.int64)), lists],
                names=["k", "size", "f1", "f2", "bands"],
            )

    return run


def verifier(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kept, similar = [], []
            for lo in range(0, len(a), 128):
                span = range(lo, min(lo + 128, len(a)))
                texts = list(dict.fromkeys(t for i in span for t in (left[i], right[i])))
                at = {t: i for i, t in enumerate(texts)}
                hashes, offsets = shingles.shingle_sets(texts, n)
                for i in span:
                    x, y = at[left[i]], at[right[i]]
                    s, t = hashes[offsets[x] : offsets[x + 1]], hashes[offsets[y] : offsets[y + 1]]
                    common = len(s) if x == y else len(np.intersect1d(s, t, assume_unique=True))
                    either = len(s) + len(t) - common
                    if either and common / either >= threshold:
                        kept.append(i)
                        similar.append(common / either)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in kept], type=pa.string()), pa.array([b[i] for i in kept], type=pa.string()), pa.array(similar, type=pa.float64())],
                names=["a", "b", "similarity"],
            )

    return run


def common_bands(signed: DataFrame) -> DataFrame:
    """(band, blocks): the bands that have to be cut, by their number in a sample of the records (k, bands)."""
    drawn = signed.where(F.pmod(F.xxhash64("k"), F.lit(SAMPLED)) == 0).select(F.explode("bands").alias("band"))
    return drawn.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN).select("band", F.ceil(F.col("n") * SAMPLED / BLOCK).cast("int").alias("blocks")).where("blocks > 1")


def blocked(keyed: DataFrame, common: DataFrame) -> DataFrame:
    """(rep, size, band, block, lo, hi) of (rep, size, band): each record once for every block of its band that its own block has to
    meet; a band that is not common is one block."""
    count = common.count()
    rows = keyed.join(F.broadcast(common) if count <= MOST_BROADCAST else common, "band", "left") if count else keyed.withColumn("blocks", F.lit(1))
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    if count:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    else:
        rows = rows.withColumn("other", F.lit(0))
    rows = rows.select("rep", "size", "band", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    # A block is bounded, so the exchange that both sides of the join use need not be split any more.
    return rows.repartition("band", "lo", "hi")


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, n: int = 5, rows: int = 5, recall: float = 0.9995) -> tuple[DataFrame, DataFrame]:
    """Two frames: ``links`` (a, b, similarity) between records with different n-gram sets, a < b, of which each
    side stands for its whole class of equal sets; and ``classes`` (k, rep), every record that has n-grams
    with the smallest key among the records of the same set."""
    docs = keyed_texts(df, key, text)
    bands = bands_for(threshold, rows, recall)
    signed = stored(spread(docs).mapInArrow(signer(n, bands, rows), "k string, size long, f1 long, f2 long, bands array<long>"))
    reps = signed.groupBy("f1", "f2", "size").agg(F.min_by(F.struct("k", "bands"), "k").alias("r"))
    reps = reps.select("f1", "f2", "size", F.col("r.k").alias("rep"), F.col("r.bands").alias("bands"))
    classes = signed.select("k", "f1", "f2", "size").join(signed.groupBy("f1", "f2", "size").agg(F.min("k").alias("rep")), ["f1", "f2", "size"]).select("k", "rep").distinct()
    met = blocked(reps.select("rep", "size", F.explode("bands").alias("band")), common_bands(signed))
    x, y = met.alias("x"), met.alias("y")
    fits = (F.col("x.size") >= threshold * F.col("y.size")) & (F.col("y.size") >= threshold * F.col("x.size"))
    meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    once = (F.col("x.lo") == F.col("x.hi")) | (F.col("x.block") != F.col("y.block"))
    pairs = checkpointed(x.join(y, meet & once & (F.col("x.rep") < F.col("y.rep")) & fits).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()
    texts = docs.join(wanted, "k", "left_semi")
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    links = both.select("a", "b", "ta", "tb").mapInArrow(verifier(n, threshold), "a string, b string, similarity double")
    return links, classes


def near_duplicate_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, **how) -> DataFrame:
    """All pairs (a, b, similarity) of records, a < b, classes of equal n-gram sets written out."""
    links, classes = similar_pairs(df, key, text, threshold, **how)
    classes = checkpointed(classes)
    links = checkpointed(links)
    many = classes.groupBy("rep").count().where("count > 1").select("rep")
    members = classes.join(many, "rep", "left_semi")
    inside = members.alias("x").join(members.alias("y"), F.col("x.rep") == F.col("y.rep")).where("x.k < y.k").select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.lit(1.0).alias("similarity"))
    ends = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).distinct()
    near = classes.join(ends, "rep", "left_semi")
    across = links.join(near.select(F.col("rep").alias("a"), F.col("k").alias("ka")), "a").join(near.select(F.col("rep").alias("b"), F.col("k").alias("kb")), "b")
    return across.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity").where("a <> b").unionByName(inside).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, group): the smallest key that each node of ``nodes`` (k) reaches over ``edges`` (a, b).

    Alternates large-star and small-star steps, which end after O(log^2) rounds; each is a join-free
    aggregation by node, and every round is checkpointed. The star of a hot node is never gathered: only its
    minimum is needed, and that is aggregated before the shuffle.
    """
    edges = checkpointed(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        after = checkpointed(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        edges = after
        if same:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.select("k").distinct().join(roots.withColumnRenamed("u", "k"), "k", "left").select("k", F.coalesce("root", "k").alias("group"))


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = 0.8, **how) -> DataFrame:
    """One row per record that has n-grams: (k, class_rep, group, links). ``group`` is the smallest key connected
    with it by links of at least ``threshold``; ``links`` counts its class's links to other classes."""
    links, classes = similar_pairs(df, key, text, threshold, **how)
    links, classes = checkpointed(links), checkpointed(classes)
    groups = components(classes.select(F.col("rep").alias("k")), links)
    ends = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    out = classes.join(groups.withColumnRenamed("k", "rep"), "rep").join(ends, "rep", "left")
    return out.select("k", F.col("rep").alias("class_rep"), "group", F.coalesce("links", F.lit(0)).alias("links"))
