"""Natural language inside source files (problem 7): composed lexer maps and a multinomial logistic regression.

Comments and string literals are found by ``cpp_lexer.scan``: every file is cut into chunks, each chunk's map from lexer
states to lexer states is computed on its own, a prefix scan over the maps tells each chunk the state it starts in, and what crosses
the border of chunks is put together again. Files longer than ``chunk_chars`` are first spread over tasks with the same maps,
in pieces that cut no comment, literal, or run of them, so that the result is that of the whole file, whatever ``chunk_chars`` is.

Sentences of the spans are labelled by a multinomial logistic regression on hashed character n-grams of words. It is
trained here, at most on ``max_train`` labelled documents and as many programs, drawn by a hash of their keys. The
documents' language column describes most of their text. A language without labelled documents that has a script
of its own (Japanese) is learnt from sentences of the programs that hold its letters. Words repeat, so each distinct
word's part of the scores is computed once per task.

Defined results: null key or text: left out; a file without sentences gives no row; a repeated key is one file whose parts
are added up; without any training rows there are no labels and no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import cpp_lexer as X
from codeloom.llm.common import checkpointed, keyed_texts, spread, text_groups

BUCKETS = 1 << 15
MAX_GRAM = 4
CJK = r"々-〇ぁ-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ"
_CJK = re.compile(f"[{CJK}]")
_KANA = re.compile(r"[ぁ-ヿ]")
#: Parts with a meaning for the model: single ideographs and kana, or runs of other letters.
_WORD = re.compile(f"[{CJK}]|[^\\W\\d_{CJK}]+")
_COUNTED = re.compile(r"\S*[^\W_]\S*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])[」）]*|\n+")
_CODE = re.compile(r"[;{}]\s*$|^\s*#\s*(?:include|define|if|endif|pragma)|[-+*/|&^<>=!]=|\+\+|--\w|\w--|<<|>>|->|::|\w\[|[A-Za-z0-9_]\(\w*\)?[\w,*& ]*\)?\s*[;{]|^\s*return\b.*;|\s=\s")
_TAG_LINE = re.compile(r"^\s*[@\\](?:author|authors|date|version|file|since|copyright|license|see|sa|ref|todo|bug)\b.*$", re.I)
_TAG = re.compile(r"(?<![\w.])[@\\](?:t?param(?:\s*\[[^\]]*\])?\s+\w+|[A-Za-z]+)")
_FIELD = re.compile(r"^\s*[\w][\w -]{0,20}:\s*(.*)$")
_FORMAT = re.compile(r"%[-+ #0-9.*]*(?:hh|ll|[hlLzjtq])?[diouxXcsfFgGeEaApn%]")
#: Words from which a sentence is counted; characters in Chinese and Japanese.
LEAST_WORDS, LEAST_CHARS = 3, 5


def word_features(word: str) -> list[int]:
    """Buckets of the character n-grams of a word with its borders; of an ideograph or kana, itself and its script."""
    if _CJK.match(word):
        return [zlib.crc32(word.encode()) % BUCKETS, zlib.crc32(b"kana" if _KANA.match(word) else b"han") % BUCKETS]
    padded = "<" + word.lower() + ">"
    return [zlib.crc32(padded[i : i + n].encode()) % BUCKETS for n in range(1, MAX_GRAM + 1) for i in range(len(padded) - n + 1)]


class Model:
    """Multinomial logistic regression over the mean of hashed n-gram indicators."""

    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray):
        self.labels, self.weights, self.bias = labels, weights, bias
        self.cache: dict[str, tuple[np.ndarray, int]] = {}

    def _word(self, word: str) -> tuple[np.ndarray, int]:
        got = self.cache.get(word)
        if got is None:
            f = word_features(word)
            got = self.weights[f].sum(axis=0), len(f)
            if len(self.cache) < 500_000:
                self.cache[word] = got
        return got

    def label(self, sentence: str) -> str | None:
        parts = [self._word(w) for w in _WORD.findall(sentence)]
        if not parts or not self.labels:
            return None
        scores = sum(p[0] for p in parts) / sum(p[1] for p in parts) + self.bias
        return self.labels[int(np.argmax(scores))]

    @classmethod
    def train(cls, rows: list[tuple[str, str]], epochs: int = 5, rate: float = 4.0, batch: int = 256) -> "Model":
        """From (sentence, label) rows, by AdaGrad on shuffled mini-batches; classes weigh alike."""
        labels = sorted({y for _, y in rows})
        weights, bias = np.zeros((BUCKETS, len(labels)), dtype=np.float32), np.zeros(len(labels), dtype=np.float32)
        if len(labels) < 2:
            return cls(labels, weights, bias)
        memo: dict[str, list[int]] = {}
        xs = []
        for s, _ in rows:
            f: list[int] = []
            for w in _WORD.findall(s):
                if w not in memo:
                    memo[w] = word_features(w)
                f += memo[w]
            xs.append(np.array(f or [0], dtype=np.int64))
        at = {y: i for i, y in enumerate(labels)}
        ys = np.array([at[y] for _, y in rows])
        per_class = len(rows) / (len(labels) * np.bincount(ys, minlength=len(labels)))
        squares = np.full_like(weights, 1e-4)
        draw = np.random.default_rng(11)
        for _ in range(epochs):
            order = draw.permutation(len(rows))
            for lo in range(0, len(order), batch):
                ids = order[lo : lo + batch]
                sizes = np.array([len(xs[i]) for i in ids])
                flat = np.concatenate([xs[i] for i in ids])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                z = np.add.reduceat(weights[flat], starts, axis=0) / sizes[:, None] + bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                p = z / z.sum(axis=1, keepdims=True)
                p[np.arange(len(ids)), ys[ids]] -= 1
                p *= per_class[ys[ids]][:, None] / len(ids)
                by_bucket = np.argsort(flat, kind="stable")
                touched, first = np.unique(flat[by_bucket], return_index=True)
                grad = np.add.reduceat(np.repeat((p / sizes[:, None]).astype(np.float32), sizes, axis=0)[by_bucket], first, axis=0)
                squares[touched] += grad * grad
                weights[touched] -= rate * 0.1 * grad / np.sqrt(squares[touched])
                bias -= 0.05 * rate * p.sum(axis=0).astype(np.float32)
        return cls(labels, weights, bias)


def prose_lines(lines: Iterable[str]) -> str:
    """Lines of comments with tags, header fields and code taken out; what is left is joined to paragraphs."""
    out: list[str] = []
    for line in lines:
        if not line or _CODE.search(line) or _TAG_LINE.match(line):
            out.append("\n")
            continue
        if tags := _TAG.search(line):
            out.append("\n")
            line = _TAG.sub("\n", line)
        field = _FIELD.match(line)
        if field and not _CJK.search(field[1]) and len(field[1].split()) < 4:
            out.append("\n")
            continue
        out.append(line)
        out.append(" ")
    return "".join(out)


def sentences(text: str) -> Iterator[tuple[str, int]]:
    """Sentences with their number of words, or of characters in scripts without blanks."""
    for s in _SENTENCE.split(text):
        if not s or _CODE.search(s):
            continue
        wide = len(_CJK.findall(s))
        words = len(_COUNTED.findall(s))
        if wide >= LEAST_CHARS and wide >= words:
            yield s, wide
        elif wide < LEAST_CHARS and words >= LEAST_WORDS and len(_WORD.findall(s)) >= LEAST_WORDS:
            yield s, words


def groups(text: str, spans: Iterable[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Comments and literals that belong together: line comments on successive lines, and literals that are written next to
    each other. Any other stands alone."""
    held: list[tuple[str, int, int]] = []
    for span in spans:
        if held and not _joined(text, held[-1], span):
            yield held
            held = []
        held.append(span)
    if held:
        yield held


def _joined(text: str, last: tuple[str, int, int], span: tuple[str, int, int]) -> bool:
    a, b = (X.STRING if kind == "R" else kind for kind in (last[0], span[0]))
    gap = text[last[2] : span[1]]
    return a == b and a in (X.LINE, X.STRING) and not gap.strip() and (a == X.STRING or gap.count("\n") == 1)


def placed_paragraphs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, prose) of the comments and literals of a text that starts in code."""
    for held in groups(text, X.scan(text)):
        if held[0][0] == X.CHAR:
            continue
        if held[0][0] in (X.STRING, "R"):
            literal = _FORMAT.sub(" ", "".join(X.printed(_literal_kind(text, a, b), text[a:b]) for _, a, b in held))
            prose = prose_lines(literal.replace("\r", "\n").split("\n"))
        else:
            prose = prose_lines(line for _, a, b in held for line in X.comment_lines(text[a:b]))
        yield held[0][1], held[-1][2], prose


def paragraphs(text: str) -> Iterator[str]:
    return (p for _, _, p in placed_paragraphs(text))


def _literal_kind(text: str, start: int, end: int) -> str:
    return "R" if text[start - 1 : start] == "R" and text[end - 2 : end - 1] == ")" else X.STRING


def labelled(model: Model, text: str) -> Iterator[tuple[int, int, str, int, str]]:
    """(start, end, lang, n, sentence): the labelled sentences, each with the place of the comment or literal, or of the run of
    them, that holds it."""
    for start, end, p in placed_paragraphs(text):
        for s, n in sentences(p):
            if label := model.label(s):
                yield start, end, label, n, s.strip()


def count_words(model: Model, text: str) -> Counter:
    out: Counter = Counter()
    for _, _, lang, n, _ in labelled(model, text):
        out[lang] += n
    return out


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, chars = Counter(), Counter()
                for _, _, lang, n, s in labelled(model, t):
                    words[lang] += n
                    chars[lang] += len(s)
                rows += [(k, lang, n, chars[lang]) for lang, n in words.items()]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(columns, [pa.string(), pa.string(), pa.int64(), pa.int64()])], names=["k", "lang", "n", "chars"])

    return run


def _teller(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            rows = [(k, at + start, at + end, lang, n, s) for k, t, at in zip(*(c.to_pylist() for c in batch.columns)) for start, end, lang, n, s in labelled(model, t)]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()])], names=["k", "start", "end", "lang", "n", "sentence"])

    return run


def training_rows(labelled: list[tuple[str, str]], programs: list[str]) -> list[tuple[str, str]]:
    """Sentences with labels, from labelled texts and, for Japanese, from programs by their letters."""
    rows = [(s, lang) for text, lang in labelled for s, _ in sentences(prose_lines(text.split("\n")))]
    if all(lang != "ja" for _, lang in labelled):
        rows += [(s, "ja") for t in programs for p in paragraphs(t) for s, _ in sentences(p) if len(_KANA.findall(s)) >= 3]
    return rows


def fit(programs: DataFrame, key: str, text: str, documents: DataFrame, doc_key: str, doc_text: str, doc_lang: str, max_train: int = 500) -> Model:
    """The model, from at most ``max_train`` labelled documents and ``max_train`` programs with kana."""
    docs = documents.where(F.col(f"`{doc_lang}`").isNotNull() & F.col(f"`{doc_text}`").isNotNull()).withColumnRenamed(doc_lang, "_lang")
    drawn = _drawn(docs, doc_key, doc_text, "_lang", max_train)
    kana = _drawn(programs.where(F.col(f"`{text}`").rlike(r"[ぁ-ヿ]|\\\\u30[4-9a-f]")).withColumn("_lang", F.lit("ja")), key, text, "_lang", max_train)
    return Model.train(training_rows([(t, lang) for t, lang in drawn], [t for t, _ in kana]))


def _drawn(df: DataFrame, key: str, text: str, label: str, n: int) -> list[tuple[str, str]]:
    """(text, label) of the ``n`` rows with the least hashes of their keys. Keys are drawn first, so that partitions send no
    texts but those drawn."""
    rows = df.select(F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"), F.col(f"`{text}`").alias("t"), F.col(label).alias("l"))
    least = [r.h for r in rows.select("h").orderBy("h").limit(n).collect()]
    return [(r.t, r.l) for r in rows.where(F.col("h") <= max(least)).limit(n).collect()] if least else []


def borders(text: str, state: str) -> tuple[int, int]:
    """(h, t): text[:h] may belong to what the chunk before ends with, text[t:] to what the next one starts with, and text[h:t]
    stands alone, from code to code. (-1, -1) if the chunk may be the middle of something longer."""
    n = len(text)
    spans, after = X.lex(text, state)
    runs = list(groups(text, spans))
    if not runs:
        return (-1, -1) if not spans and not text.strip() else (0, n)
    (kind, start, _), end = runs[0][0], runs[0][-1][2]
    left = state != X.CODE or (kind not in (X.BLOCK, X.CHAR) and not text[:start].strip())
    last, begin = runs[-1][-1], runs[-1][0][1]
    right = after != X.CODE or (last[0] not in (X.BLOCK, X.CHAR) and not text[last[2] :].strip())
    if left and right and len(runs) == 1:
        return -1, -1
    # A raw string is none without its prefix.
    return end if left else 0, begin - (runs[-1][0][0] == "R") if right else n


def closed_pieces(docs: DataFrame, chunk_chars: int) -> DataFrame:
    """(k, t, at): long files in pieces that start and end in code and cut no comment, literal, or run of them; ``at`` is the
    piece's place in the file. What crosses the borders of chunks is put together again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches):
            rows = []
            for k, t in zip(keys, texts):
                file, at, delimiters = uuid.uuid4().hex, 0, sorted(set(X.RAW_DELIMITERS.findall(t)))  # keys may repeat
                for i, c in enumerate(X.chunks(t, chunk_chars)):
                    rows.append((k, file, i, at, c, delimiters))
                    at += len(c)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(list(zip(*rows)) or [[]] * 6, [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string())])], names=["k", "file", "i", "at", "t", "d"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [list(X.transitions(t, d).items()) for t, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, type=pa.map_(pa.string(), pa.string()))], names=["file", "i", "m"])

    def scan(pdf):
        pdf = pdf.sort_values("i")
        pdf["state"] = X.entry_states([dict(m) for m in pdf["m"]])
        return pdf[["file", "i", "state"]]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, file, i, at, t, state in zip(*(c.to_pylist() for c in batch.columns)):
                h, e = borders(t, state)
                if h < 0:
                    rows.append((k, file, i, at, "through", t))
                else:
                    rows += [(k, file, i, at, "head", t[:h]), (k, file, i, at + h, "inner", t[h:e]), (k, file, i, at + e, "tail", t[e:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(list(zip(*rows)) or [[]] * 6, [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()])], names=["k", "file", "i", "at", "role", "t"])

    def join(pdf):
        rows, held, begin = [], [], 0
        for k, role, at, t in pdf.sort_values(["i", "at", "role"])[["k", "role", "at", "t"]].itertuples(index=False):
            begin = begin if held else at
            held.append(t)
            if role == "head":
                rows.append((k, "".join(held), begin))
                held = []
        if held:
            rows.append((k, "".join(held), begin))
        return pd.DataFrame([r for r in rows if r[1]], columns=["k", "t", "at"])

    pieces = checkpointed(docs.mapInArrow(cut, "k string, file string, i int, at long, t string, d array<string>"))
    states = pieces.select("file", "i", "t", "d").mapInArrow(maps, "file string, i int, m map<string,string>").groupBy("file").applyInPandas(scan, "file string, i int, state string")
    parts = checkpointed(pieces.join(states, ["file", "i"]).select("k", "file", "i", "at", "t", "state").mapInArrow(part, "k string, file string, i int, at long, role string, t string"))
    seams = parts.where("role <> 'inner'").groupBy("file").applyInPandas(join, "k string, t string, at long")
    return parts.where("role = 'inner' and t <> ''").select("k", "t", "at").unionByName(seams)


def _read(programs: DataFrame, key: str, text: str, model: Model, chunk_chars: int, reader, schema: str) -> DataFrame:
    """What ``reader`` makes of (k, t, at), over short files and the pieces of long ones."""
    shared = programs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.bias))
    docs = spread(keyed_texts(programs, key, text))
    short = docs.where(F.length("t") <= chunk_chars).withColumn("at", F.lit(0).cast("long")).mapInArrow(reader(shared), schema)
    long = docs.where(F.length("t") > chunk_chars)
    return short if long.isEmpty() else short.unionByName(closed_pieces(long, chunk_chars).mapInArrow(reader(shared), schema))


def language_sizes(programs: DataFrame, key: str, text: str, model: Model, chunk_chars: int = 1_000_000) -> DataFrame:
    """(k, lang, n, chars): words of sentences (zh, ja: characters) in each language, and all characters of the sentences."""
    rows = _read(programs, key, text, model, chunk_chars, _counter, "k string, lang string, n long, chars long")
    return rows.groupBy("k", "lang").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


def language_words(programs: DataFrame, key: str, text: str, model: Model, chunk_chars: int = 1_000_000) -> DataFrame:
    """(k, lang, n): words of sentences (zh, ja: characters) in each language."""
    return language_sizes(programs, key, text, model, chunk_chars).select("k", "lang", "n")


def prose(programs: DataFrame, key: str, text: str, model: Model, chunk_chars: int = 1_000_000) -> DataFrame:
    """(k, start, end, lang, n, sentence): one row per sentence as it is printed, without markers; text[start:end] is the comment
    or literal, or the run of them, that holds it."""
    return _read(programs, key, text, model, chunk_chars, _teller, "k string, start long, end long, lang string, n long, sentence string")


def shares(programs: DataFrame, key: str, text: str, model: Model, least: int = 0, **how) -> DataFrame:
    """(k, lang, n, share, chars, file_share): ``share`` of the file's prose that is in the language, by words; ``file_share``
    of the file's characters that the language's sentences are."""
    sizes = language_sizes(programs, key, text, model, **how)
    totals = sizes.groupBy("k").agg(F.sum("n").alias("total"))
    files = keyed_texts(programs, key, text).groupBy("k").agg(F.sum(F.length("t")).alias("size"))
    return sizes.join(totals, "k").join(files, "k").where(F.col("n") >= least).select("k", "lang", "n", (F.col("n") / F.col("total")).alias("share"), "chars", (F.col("chars") / F.col("size")).alias("file_share"))
