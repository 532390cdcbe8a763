"""Problems 1, 2, 4, 5, 8, 9 against brute force and on corner cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import format_copies, leaks, near_duplicates, packing, percentiles, shared_spans, shingles

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")


def programs(spark, rows):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "ProgramID string, Content string")
    for c in ("k", "t", "n", "a", "b", "value", "rep", "text"):
        df = df.withColumn(c, F.lit(c))
    return df


# --- shingles


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab_1 \n+é中　", max_size=30), max_size=6))
def test_shingle_sets(texts):
    hashes, offsets = shingles.shingle_sets(texts, 3)
    for i, t in enumerate(texts):
        w = TOKEN.findall(t)
        assert offsets[i + 1] - offsets[i] == len({tuple(w[j : j + 3]) for j in range(len(w) - 2)})
        assert len(hashes) == offsets[-1]


def test_equal_spans_hash_equally():
    flat, offsets = shingles.code_points(["xxhello world", "hello world yy"])
    h, o = shingles.grams(flat, offsets, 11)
    assert len(set(h[: o[1]]) & set(h[o[1] :])) == 1


# --- P1


def results(spark, rows):
    return spark.createDataFrame(rows, "Program string, TranslationTime double, other int, metric string, g string")


def test_percentiles_match_numpy(spark):
    draw = random.Random(4)
    rows = []
    for i in range(3000):
        p = "hot" if draw.random() < 0.5 else f"p{draw.randrange(40)}"
        v = draw.choice([None, float("nan"), -1.0, float("inf"), 0.0, 7.5]) if draw.random() < 0.2 else round(draw.lognormvariate(0, 2), 3)
        rows.append((p, v, i, "x", "y"))
    rows += rows[:100]  # delivered twice
    rows += [(None, 1.0, 1, "x", "y"), (None, 3.0, 2, "x", "y"), ("empty", None, 1, "x", "y")]
    got = percentiles.program_percentiles(results(spark, rows), "Program", ["TranslationTime"], (0.0, 10.0, 50.0, 99.5, 100.0)).collect()
    want = defaultdict(list)
    for p, v, *_ in set((p, None if v is None or v != v else v, i) for p, v, i, *_ in rows):
        if v is not None and 0 <= v < float("inf"):
            want[p].append(v)
    assert {r.Program for r in got} == set(want) and "empty" not in want
    for r in got:
        assert r.n == len(want[r.Program])
        assert np.allclose([r.p0, r.p10, r.p50, r.p99_5, r.p100], np.percentile(want[r.Program], [0, 10, 50, 99.5, 100]))


def test_parts_combine_exactly(spark):
    draw = random.Random(5)
    rows = [("a" if draw.random() < 0.9 else "b", round(draw.random(), 2), i, "", "") for i in range(800)]
    df = results(spark, rows)
    whole = percentiles.measurements(df, "Program", ["TranslationTime"])
    parts = [percentiles.value_counts(percentiles.measurements(df.where(F.col("other") % 3 == i), "Program", ["TranslationTime"])) for i in range(3)]
    key = lambda df: sorted((r.g, r.percent, round(r.value, 9), r.n) for r in df.collect())
    assert key(percentiles.percentiles(whole, partitions=7)) == key(percentiles.percentiles(percentiles.merge(*parts), partitions=3))


def test_one_value_of_very_many_rows_is_split(spark, monkeypatch):
    """Two thirds of the rows have one value of one group; no partition holds them all, and long groups are passed on."""
    monkeypatch.setattr(percentiles, "HELD", 50)
    rows = [("hot", 1.0 if i % 3 else float(i), i, "x", "y") for i in range(6000)] + [("cold", float(i), i, "x", "y") for i in range(40)]
    long = percentiles.measurements(percentiles.deduplicate(results(spark, rows), ["Program", "TranslationTime"]), "Program", ["TranslationTime"])
    ranged = long.repartitionByRange(8, "metric", "g", "value", "tie")
    assert max(r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()) < 2000
    got = {(r.g, r.percent): (r.n, r.value) for r in percentiles.percentiles(long, (10.0, 50.0, 90.0), 8).collect()}
    for g, n in (("hot", 6000), ("cold", 40)):
        values = [v for p, v, *_ in rows if p == g]
        for p in (10.0, 50.0, 90.0):
            assert got[g, p] == (n, pytest.approx(np.percentile(values, p)))


def test_percentiles_of_nothing(spark):
    assert percentiles.program_percentiles(results(spark, []), "Program", ["TranslationTime"]).count() == 0


# --- P2

HEAD = "// Author: ann\n// Verdict: OK\n"
BODY = "#include <map>\n#include <set>\nint main() { return f_oo(1); }\n"


def test_format_copies(spark):
    rows = [
        ("p3", HEAD + "\n" + BODY),
        ("p1", "/*\n * Verdict: OK\n * author:Ann\n */\r\n#include<set>\r\n#  include <map>\r\nINT main()\r\n{\r\n return foo( 1 );}"),
        ("p2", HEAD + "\n" + BODY.replace("1", "2")),
        ("p4", BODY),
        ("p5", HEAD.replace("OK", "OK\n// Verdict: OK") + "\n" + BODY),
        ("p6", ""),
        ("p7", " \n;;"),
        ("p8", None),
        (None, BODY),
        ("p9", "/* never closed"),
    ]
    got = {(r.first_id, r.copy_id) for r in format_copies.found(programs(spark, rows), "ProgramID", "Content").collect()}
    assert got == {("p1", "p3"), ("p6", "p7")}
    counts = {r.first_id: r.copies for r in format_copies.collapsed(programs(spark, rows), "ProgramID", "Content").collect()}
    assert counts == {"p1": 2, "p2": 1, "p4": 1, "p5": 1, "p6": 2, "p9": 1}
    assert format_copies.found(programs(spark, []), "ProgramID", "Content").count() == 0


def test_hot_group_is_split(spark, monkeypatch):
    monkeypatch.setattr(format_copies, "MEMBERS_PER_SALT", 10)
    rows = [(f"p{i:04d}", "int x;" + " " * (i % 5)) for i in range(95)] + [("q", "int y;")]
    got = format_copies.collapsed(programs(spark, rows), "ProgramID", "Content").collect()
    assert {(r.first_id, r.copies) for r in got} == {("p0000", 95), ("q", 1)}


# --- P4 and P5


def corpus(n=120, seed=2):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[draw.choice(words) for _ in range(draw.randrange(60, 160))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(draw.choice(base))
        for _ in range(draw.randrange(6)):
            w[draw.randrange(len(w))] = draw.choice(words)
        if draw.random() < 0.3:
            cut = draw.randrange(len(w))
            w = w[cut:] + w[:cut]
        rows.append((f"p{i:03d}", " ".join(w)))
    return rows


def jaccard(rows, n, threshold):
    sets = {}
    for k, t in rows:
        w = TOKEN.findall(t or "")
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    ks = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_near_duplicates(spark, threshold):
    rows = [*corpus(), ("x1", "a b"), ("x2", "a b"), ("x3", ""), ("x4", None), ("y1", "a b c d e f"), ("y2", "a  b\nc d e f")]
    got = {(r.a, r.b) for r in near_duplicates.near_duplicate_pairs(programs(spark, rows), "ProgramID", "Content", threshold, recall=0.9999).collect()}
    assert got == jaccard(rows, 5, threshold)
    assert near_duplicates.near_duplicate_pairs(programs(spark, []), "ProgramID", "Content").count() == 0


def test_a_band_of_many_is_cut_into_blocks(spark, monkeypatch):
    for name, least in (("BLOCK", 7), ("SAMPLED", 1), ("SEEN", 2)):
        monkeypatch.setattr(near_duplicates, name, least)
    draw = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = [(f"p{i:02d}", " ".join(w if draw.random() > 0.01 else f"x{draw.randrange(9)}" for w in base)) for i in range(40)] + [("c" + k, t) for k, t in corpus(20, 5)]
    got = {(r.a, r.b) for r in near_duplicates.near_duplicate_pairs(programs(spark, rows), "ProgramID", "Content", 0.8, recall=0.9999).collect()}
    assert got == jaccard(rows, 5, 0.8)
    keyed = spark.createDataFrame([(f"r{i:03d}", 5, 1) for i in range(100)] + [("r000", 5, 2)], "rep string, size long, band long")
    common = near_duplicates.common_bands(keyed.groupBy(F.col("rep").alias("k")).agg(F.collect_list("band").alias("bands")))
    assert [r.band for r in common.collect()] == [1]
    met = near_duplicates.blocked(keyed, common)
    assert [tuple(r) for r in met.where("band = 2").select("block", "lo", "hi").collect()] == [(0, 0, 0)]
    met = met.where("band = 1")
    sizes = [r["count"] for r in met.groupBy("band", "lo", "hi").count().collect()]
    assert len(sizes) > 60 and max(sizes) < 60
    x, y = met.alias("x"), met.alias("y")
    pairs = x.join(y, ["band", "lo", "hi"]).where("x.rep < y.rep and (lo = hi or x.block <> y.block)").groupBy("x.rep", "y.rep").count().collect()
    assert len(pairs) == 100 * 99 // 2 and all(r["count"] == 1 for r in pairs)


def test_groups_are_components(spark):
    rows = corpus(60, 7)
    pairs = jaccard(rows, 5, 0.8)
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    got = {r.k: r.group for r in near_duplicates.near_duplicate_groups(programs(spark, rows), "ProgramID", "Content", 0.8, recall=0.9999).collect()}
    assert got == {k: root(k) for k, _ in rows}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(71)] + [("z",)], "k string")
    assert {r.group for r in near_duplicates.components(nodes, edges).collect()} == {"n000", "z"}


def test_band_count_reaches_the_recall():
    b = near_duplicates.bands_for(0.7, 5, 0.999)
    assert 1 - (1 - 0.7**5) ** b >= 0.999 > 1 - (1 - 0.7**5) ** (b - 1)


def spans_corpus(n=40, seed=3):
    draw = random.Random(seed)
    blocks = ["".join(draw.choice("abcde \né") for _ in range(draw.randrange(20, 70))) for _ in range(12)]
    return [(f"p{i:02d}", "".join(draw.choice(blocks) if draw.random() < 0.6 else "".join(draw.choice("xyz") for _ in range(30)) for _ in range(4))) for i in range(n)]


@pytest.mark.parametrize("few", [32, 2])
def test_sharing_pairs(spark, few):
    rows = [*spans_corpus(), ("q1", "=" * 200), ("q2", "=" * 90), ("q3", ""), ("q4", None), ("q5", "-+" * 60), ("q6", "x" + "-+" * 30)]
    df = programs(spark, rows)
    got = {(r.a, r.b) for r in shared_spans.sharing_pairs(df, "ProgramID", "Content", 40, few=few).collect()}
    texts = [(k, t) for k, t in rows if t]
    want = {(a, b) for i, (a, s) in enumerate(texts) for b, t in texts[i + 1 :] if any(s[j : j + 40] in t for j in range(len(s) - 39))}
    assert got == want
    met = {(r.k, r.partner) for r in shared_spans.partner_stretches(df, "ProgramID", "Content", 40, few=few).collect()}
    assert met == want | {(b, a) for a, b in want}
    assert shared_spans.sharing_pairs(programs(spark, []), "ProgramID", "Content", 40).count() == 0


def test_long_runs_of_one_sign_and_a_common_head(spark):
    draw = random.Random(5)
    head = "".join(draw.choice("abcdef ") for _ in range(70))
    rows = [("r1", "=" * 60_000), ("r2", "=" * 60_000 + "x"), *[(f"h{i:03d}", head + "".join(draw.choice("xyz") for _ in range(200))) for i in range(150)]]
    out = {r.k: r for r in shared_spans.shared_spans(programs(spark, rows), "ProgramID", "Content", 60).collect()}
    assert out["r1"].shared_chars == out["r2"].shared_chars == 60_000
    assert all(out[k].shared_chars >= 70 for k, _ in rows)
    texts = [t for k, t in rows if k[0] == "h"]
    for k, t in rows[2:12]:
        at = max(n for n in range(70, 90) if sum(u.startswith(t[:n]) for u in texts) > 1)
        assert (out[k].n_spans, out[k].shared_chars) == (1, at)


def test_repeated_keys_share_nothing_with_themselves(spark):
    text = "The quick brown fox jumps over the dog. 123"
    rows = [("p", text), ("p", text + "!"), ("p", text), ("q", "z" + text[3:])]
    df = programs(spark, rows)
    assert {(r.a, r.b) for r in shared_spans.sharing_pairs(df, "ProgramID", "Content", 20).collect()} == {("p", "q")}
    got = sorted((r.k, r.n_chars, r.shared_chars) for r in shared_spans.shared_spans(df, "ProgramID", "Content", 20).collect())
    assert got == [("p", 43, 40), ("p", 44, 40), ("q", 41, 40)]
    assert shared_spans.stretches(programs(spark, rows[:3]), "ProgramID", "Content", 20).count() == 0


def test_shared_share(spark):
    rows = spans_corpus(25, 6)
    texts = dict(rows)
    got = {r.k: r for r in shared_spans.shared_spans(programs(spark, [*rows, ("e", "")]), "ProgramID", "Content", 40).collect()}
    for k, t in rows:
        marked = [False] * len(t)
        others = [u for j, u in texts.items() if j != k]
        for i in range(len(t) - 39):
            if any(t[i : i + 40] in u for u in others):
                marked[i : i + 40] = [True] * 40
        assert got[k].shared_chars == sum(marked) and got[k].n_chars == len(t)
    assert got["e"].shared_share == 0.0


def test_stretches_and_spans(spark):
    rows = spans_corpus(25, 6)
    texts = dict(rows)
    df = programs(spark, [*rows, ("e", "")])
    got = defaultdict(list)
    for r in shared_spans.stretches(df, "ProgramID", "Content", 40).collect():
        got[r.k].append((r.start, r.end))
    for k, t in rows:
        others = [u for j, u in texts.items() if j != k]
        want: list[list[int]] = []
        for i in range(len(t) - 39):
            if any(t[i : i + 40] in u for u in others):
                if want and i <= want[-1][1]:
                    want[-1][1] = i + 40
                else:
                    want.append([i, i + 40])
        assert sorted(got[k]) == [tuple(x) for x in want]
    pairs = defaultdict(list)
    for r in shared_spans.partner_stretches(df, "ProgramID", "Content", 40).collect():
        pairs[r.k, r.partner].append((r.start, r.end))
    for (k, j), found in pairs.items():
        s, u = texts[k], texts[j]
        want = []
        for i in range(len(s) - 39):
            if s[i : i + 40] in u:
                if want and i <= want[-1][1]:
                    want[-1][1] = i + 40
                else:
                    want.append([i, i + 40])
        assert sorted(found) == [tuple(x) for x in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=4), st.integers(1, 12), st.sampled_from([0, 2, 64]))
def test_compact_windows_hold_each_run_once(records, t, levels):
    before, shared_spans.LEVELS = shared_spans.LEVELS, levels
    try:
        flat = np.array([v << 32 for r in records for v in r], dtype=np.uint64)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in records])))
        runs = Counter()
        for i, left, at, right in zip(*(x.tolist() for x in shared_spans.compact_windows(flat, offsets, t))):
            assert right - left + 1 >= t and left <= at <= right < len(records[i])
            for start in range(max(left, at - t + 1), min(at, right - t + 1) + 1):
                run = records[i][start : start + t]
                assert at - start == run.index(min(run))
                runs[i, start] += 1
        assert runs == Counter((i, s) for i, r in enumerate(records) for s in range(len(r) - t + 1))
    finally:
        shared_spans.LEVELS = before


# --- P8


def test_best_fit_never_overfills():
    draw = random.Random(1)
    sizes = [draw.randrange(0, 101) for _ in range(500)]
    boxes = packing.best_fit(sizes, 100)
    fill = Counter()
    for s, b in zip(sizes, boxes):
        fill[b] += s
    assert max(fill.values()) <= 100 and len(fill) <= 1.02 * sum(sizes) / 100 + 1


def test_packing_keeps_everything(spark):
    draw = random.Random(2)
    rows = [(i, "hot" if draw.random() < 0.5 else f"s{draw.randrange(5)}", draw.choice([0, 3, 64, 65, 300]) if draw.random() < 0.2 else draw.randrange(1, 64)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, source string, n long")
    packed = packing.pack(df, 64)
    got = packed.collect()
    pieces = defaultdict(list)
    fill = Counter()
    for r in got:
        pieces[r.k].append((r.start, r.n))
        fill[r.container] += r.n
    assert max(fill.values()) <= 64
    for k, _, n in rows:
        at = 0
        for start, size in sorted(pieces[k]):
            assert start == at
            at += size
        assert at == n and (n <= 64) == (len(pieces[k]) == 1)
    total = sum(n for *_, n in rows)
    assert total / (64 * len([f for f in fill.values() if f])) > 0.95
    windows = packing.fill(packed, 64).collect()
    assert sum(w.tokens for w in windows) == total and sum(w.containers for w in windows) == len(fill) and all(w.fill > 0.95 for w in windows if w.tokens >= 500 * 64)
    assert packing.pack(df.limit(0), 64).count() == 0


def test_windows_keep_the_mixture(spark):
    rows = [(i, "a" if i % 4 else "b", 10) for i in range(4000)]
    w = packing.assign_windows(spark.createDataFrame(rows, "k long, source string, n long"), 1000, part_rows=300).collect()
    by = defaultdict(Counter)
    for r in w:
        by[r.w][r.source] += r.n
    assert all(abs(c["a"] - 750) <= 10 and abs(c["b"] - 250) <= 10 for c in by.values())


def test_mixture_reaches_its_targets(spark):
    rows = [(i, "abc"[i % 3], 7 + i % 5) for i in range(9000)]
    targets = {"a": 2.0, "b": 1.0, "c": 1.0}
    packed = packing.pack(spark.createDataFrame(rows, "k long, source string, n long"), 64, containers=20, targets=targets)
    got = {r.source: r for r in packing.mixture(packed, targets).collect()}
    for source, share in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
        r = got[source]
        assert abs(r.target - share) < 1e-9 and r.windows > 20 and abs(r.mean - share) < 0.01
        assert r.least > share - 0.02
    natural = {r.source: r.target for r in packing.mixture(packing.pack(spark.createDataFrame(rows, "k long, source string, n long"), 64, 20)).collect()}
    assert abs(sum(natural.values()) - 1) < 1e-9


# --- P9


def test_windows_follow_targets(spark):
    rows = [(i, "a" if i % 4 else "b", 10) for i in range(4000)] + [(9000, "empty", 0)]
    df = spark.createDataFrame(rows, "k long, source string, n long")
    w = packing.assign_windows(df, 1000, part_rows=300, targets={"a": 0.5, "b": 0.5, "absent": 3.0}).collect()
    by = defaultdict(Counter)
    for r in w:
        by[r.w][r.source] += r.n
    assert sorted(r.k for r in w) == sorted(k for k, _, _ in rows)
    # b has 10,000 tokens and runs out after 20 windows of 500; a goes on alone.
    assert all(abs(by[i]["a"] - 500) <= 10 and abs(by[i]["b"] - 500) <= 10 for i in range(1, 20))
    assert all(by[i]["b"] == 0 and abs(by[i]["a"] - 500) <= 10 for i in range(22, 60))
    pieces = packing.pack(df, 100, containers=10, targets={"b": 2.0}).collect()
    assert sum(r.n for r in pieces) == 40_000
    with pytest.raises(ValueError):
        packing.assign_windows(df, 1000, targets={"a": 0})


def test_leaks_match_brute_force(spark):
    draw = random.Random(6)
    words = [f"W{i}" for i in range(40)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([5, 19, 20, 30, 45])))) for i in range(20)] + [(98, None), (99, "")]
    docs = []
    for d in range(200):
        noise = lambda: [draw.choice(words) for _ in range(draw.randrange(15))]
        taken = (items[draw.randrange(20)][1] or "").lower().split()
        cut = draw.randrange(max(1, len(taken) - 5))
        part = taken[cut : cut + draw.randrange(10, 45)]
        glue = draw.choice([" ", "\n> ", ", ", "_"])
        docs.append((d, " ".join(noise()) + glue + glue.join(part) + glue + " ".join(noise())))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    word = re.compile(r"[^\W_]+")
    want = set()
    for i, t in items:
        w = word.findall((t or "").lower())
        runs = {tuple(w[j : j + 20]) for j in range(len(w) - 19)}
        for d, text in docs:
            v = word.findall((text or "").lower())
            if any(tuple(v[j : j + 20]) in runs for j in range(len(v) - 19)):
                want.add((d, i))
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash"))
    items_df = spark.createDataFrame(items, "item_id long, text string")
    run = lambda **how: leaks.leaks(docs_df, items_df, "doc_id", "text", "item_id", ["text"], 20, **how).collect()
    assert want and {(r.k, r.item) for r in run()} == want
    assert {(r.k, r.item) for r in run(block_chars=100)} == want
    texts = dict(docs)
    item = dict(items)
    for r in run(spans=True):
        passage = " ".join(word.findall(texts[r.k][r.start : r.end].lower()))
        assert passage in " ".join(word.findall(item[r.item].lower())) and len(passage.split()) == r.words >= 20
    assert leaks.leaks(docs_df, items_df.limit(0), "doc_id", "text", "item_id", ["text"]).count() == 0
    assert leaks.leaks(docs_df.limit(0), items_df, "doc_id", "text", "item_id", ["text"]).count() == 0


def test_more_words_than_code_points():
    words = [f"w{i}" for i in range(1_200_000)]  # a code point each would not do
    matcher = leaks.Matcher([(7, " ".join(words)), (8, " ".join(words[:30])), (9, " ".join(words[:19]))], 20)
    text = "x " + " ".join(words[1_199_970:1_199_995]) + ", " + "; ".join(words[5:25])
    assert [(i, n) for i, _, _, n in matcher.spans(text)] == [(7, 25), (7, 20), (8, 20)]
    assert not matcher.spans(" ".join(words[100:119]) + " x " + words[119])
