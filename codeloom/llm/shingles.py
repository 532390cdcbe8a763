"""Vectorised tokens, q-grams and n-gram sets of many texts at once.

All functions take a list of texts, work on one flat array of code points and return flat arrays with
offsets, so that the cost is a handful of numpy passes per batch and none per token.
"""

from __future__ import annotations

import sys

import numpy as np

MASK64 = (1 << 64) - 1
#: Odd multipliers of the polynomial and of the final mixing.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
_WORD = np.zeros(0x110000, dtype=bool)
_WORD[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = True
_UTF32 = "utf-32-le" if sys.byteorder == "little" else "utf-32-be"


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: close inputs give unrelated outputs."""
    h = h ^ (h >> np.uint64(30))
    h *= MIX_A
    h ^= h >> np.uint64(27)
    h *= MIX_B
    h ^= h >> np.uint64(31)
    return h


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and the offsets (one more than there are texts)."""
    flat = np.frombuffer("".join(texts).encode(_UTF32, "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return flat, offsets


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def inverse(base: int) -> int:
    return pow(int(base), -1, 1 << 64)


class Rolling:
    """Hashes of arbitrary ranges of a flat array: sum of value x base^position, made free of the position.

    The wrapped 64-bit polynomial is only a first stage; ``ranges`` mixes it, and whoever needs certainty
    compares the texts afterwards.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        if n:
            np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * powers(n), out=self.prefix[1:])
        self.shift = powers(n + 1, np.uint64(inverse(int(BASE))))

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.shift[start])


def grams(flat: np.ndarray, offsets: np.ndarray, q: int, roll: Rolling | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the q successive values at each position that has them within its text; and their offsets. ``roll`` is that of
    ``flat``, if there is one already."""
    counts = np.maximum(np.diff(offsets) - q + 1, 0)
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    start = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    return (roll or Rolling(flat)).ranges(start, start + q), out


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens: runs of ASCII letters, digits and underscores, or any other one character that is
    no white space. Returns them flat, with the offset of each text."""
    flat, offsets = code_points(texts)
    word, n = _WORD[flat], len(flat)
    first = ~_SPACE[flat]
    joined = word[1:] & word[:-1]
    breaks = offsets[1:-1]
    breaks = breaks[(breaks > 0) & (breaks < n)]
    joined[breaks - 1] = False
    first[1:] &= ~joined
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    last = np.ones(n, dtype=bool)
    last[:-1] = ~joined
    ends = np.flatnonzero(last & ~_SPACE[flat])
    return Rolling(flat).ranges(start, ends + 1), np.searchsorted(start, offsets)


def sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        h = np.sort(hashes[a:b])
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h)
    sizes = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum([len(h) for h in out], out=sizes[1:])
    return (np.concatenate(out) if out else hashes[:0]), sizes


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of hashed n-grams of tokens of each text."""
    return sets(*grams(*tokens(texts), n))
