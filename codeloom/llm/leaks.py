"""Evaluation texts inside a corpus (problem 9): one Aho-Corasick automaton, one pass over each text.

A word is a run of letters or digits, letter case ignored; it is a number to the automaton, and a text is a sequence of numbers. A
passage is ``words`` successive words of an evaluation text (or, if wanted, of an answer). Each passage holds one of the *anchors* of its
text, the runs of ``words // 2`` words at every ``words - words // 2 + 1``-th place, so the automaton has the anchors only, and about
as many nodes as the evaluation texts have words. It scans a text once; a hit is extended to both sides, word by
word, and counts if ``words`` of them agree. Nothing is missed and nothing is wrong. Passages are mapped back to offsets of the
original text.

The evaluation texts are broadcast. Their size is checked: beyond ``block_chars`` they are split by hash into blocks of about that size,
each scanned with its own automaton, which a Python worker builds once. The driver holds one block at a time.

Defined results: null ids or texts are left out; evaluation texts with fewer than ``words`` words have no passage; an
item that repeats a passage, or a text that holds it twice, gives one row per (document, item); a passage that
several items have is reported for all of them.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import keyed_texts, spread, text_groups

WORD = re.compile(r"[^\W_]+")
UNKNOWN = 0


def fold(text: str) -> str:
    """Lower case of the same length, so that offsets stay; the few letters that would grow stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Matcher:
    """The automaton over the anchors of some evaluation texts."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        import ahocorasick

        self.words, self.size = words, max(1, words // 2)
        self.codes: dict[str, int] = {}
        self.items: list[tuple[int, array]] = []
        anchors: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            coded = array("I", [self.codes.setdefault(w, len(self.codes) + 1) for w in WORD.findall(fold(text))])
            if len(coded) < words:
                continue
            for at in range(0, len(coded) - self.size + 1, words - self.size + 1):
                anchors[tuple(coded[at : at + self.size])].append((len(self.items), at))
            self.items.append((item, coded))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for anchor, places in anchors.items():
            self.automaton.add_word(anchor, places)
        if anchors:
            self.automaton.make_automaton()
        self.empty = not anchors

    def passages(self, text: str, all_of_them: bool = True) -> Iterator[tuple[int, int, int]]:
        """(item, first, last): maximal runs of at least ``words`` words of the text that an item has, in words of the text. Of each
        item the first one is enough unless ``all_of_them``."""
        if self.empty:
            return
        code = self.codes.get
        coded = tuple([code(w, UNKNOWN) for w in WORD.findall(fold(text))])
        done: dict[tuple[int, int], int] = {}
        seen: set[int] = set()
        for end, places in self.automaton.iter(coded):
            for i, at in places:
                item, words = self.items[i]
                shift = end - self.size + 1 - at
                if item in seen or done.get((i, shift), -1) >= end:
                    continue
                first, last = end - self.size + 1, end
                while first > 0 and first > shift and coded[first - 1] == words[first - 1 - shift]:
                    first -= 1
                while last + 1 < len(coded) and last + 1 - shift < len(words) and coded[last + 1] == words[last + 1 - shift]:
                    last += 1
                done[i, shift] = last
                if last - first + 1 >= self.words:
                    yield item, first, last
                    if not all_of_them:
                        seen.add(item)

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, words) of each passage, in characters of the text; passages inside of
        another one of the same item are left out."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, first, last in self.passages(text):
            found[item].append((first, last))
        if not found:
            return []
        at = [m.span() for m in WORD.finditer(fold(text))]
        out = []
        for item, runs in found.items():
            reach = -1
            for first, last in sorted(runs, key=lambda r: (r[0], -r[1])):
                if last > reach:
                    reach = last
                    out.append((item, at[first][0], at[last][1], last - first + 1))
        return sorted(out)


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The evaluation texts in blocks by hash, none much larger than ``block_chars`` unless it is a single text."""
    whole = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first().n
    n = max(1, -(-whole // block_chars))
    while True:
        placed = items.withColumn("block", F.pmod(F.xxhash64("k", "t"), F.lit(n)))
        sizes = placed.groupBy("block").agg(F.sum(F.length("t")).alias("n"), F.count_distinct("k", "t").alias("texts"))
        if n == 1 or sizes.where((F.col("n") > 2 * block_chars) & (F.col("texts") > 1)).isEmpty():
            break
        n *= 2
    for block in range(n):
        rows = placed.where(F.col("block") == block).select("k", "t").collect()
        if rows:
            yield [(r.k, r.t) for r in rows]


#: The automaton of the block that this Python worker scanned last.
_BUILT: dict[str, Matcher] = {}


def _scan(docs: DataFrame, items: list[tuple[int, str]], words: int, spans: bool, batch_chars: int) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Matcher(shared.value, words)
        matcher = _BUILT[name]
        for keys, texts in text_groups(batches, batch_chars):
            rows = [(k, *r) for k, t in zip(keys, texts) for r in (matcher.spans(t) if spans else [(i,) for i, _, _ in matcher.passages(t, False)])]
            columns = [pa.array(list(c), type=pa.int64()) for c in zip(*rows)] or [pa.array([], type=pa.int64())] * (5 if spans else 2)
            yield pa.RecordBatch.from_arrays(columns, names=["k", "item", "start", "end", "words"][: 5 if spans else 2])

    return docs.mapInArrow(run, "k long, item long" + ", start long, end long, words long" * spans)


def leaks(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_texts: list[str], words: int = 20, spans: bool = False, block_chars: int = 8_000_000) -> DataFrame:
    """(k, item) for each document that holds ``words`` successive words of an item; with ``spans``, each passage
    with its start and end in the document's characters and its number of words."""
    corpus = spread(keyed_texts(docs, doc_key, doc_text, "long"))
    texts = None
    for column in item_texts:
        one = keyed_texts(items, item_key, column, "long")
        texts = one if texts is None else texts.union(one)
    out = None
    for block in _blocks(texts, block_chars):
        found = _scan(corpus, block, words, spans, 2_000_000)
        out = found if out is None else out.union(found)
    return (_scan(corpus, [], words, spans, 2_000_000) if out is None else out).distinct()
