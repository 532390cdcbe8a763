"""Personal data in free text (problem 10): bootstrapped contextual extraction.

Seed entities induce patterns, Spark scores the graph of patterns and instances until nothing new is learnt, and accepted patterns
discover what no form or list tells. What a seed is, depends on the type:

* Mail addresses and phone numbers have forms of their own.
* Names: candidates are pairs of words that are written like a full name (any order or case). Seeds stand next to a mail
  address that is made from them. Patterns are the words to the left and to the right; they are accepted if
  enough different names, and most of those they hold, have only known parts; a part becomes known if most
  of its mentions stand in accepted patterns. Patterns and parts then discover mentions anywhere, also in lower case.
* Street addresses: candidates are house numbers next to capitalised words. Seeds have one of some common words for kinds of
  streets. Patterns are the words to the left; the head of a candidate ("Bypass", "Carrer", "-gracht") becomes known if most of its
  mentions stand in accepted patterns, and known heads discover addresses anywhere.
* Identity numbers: candidates have a form that other numbers have, too. Seeds have a conclusive one. Patterns are the words to the
  right; labels, the words to the left, become known if they introduce seeds, or candidates in accepted patterns.

Patterns, parts, heads and labels are joined as tables, and broadcast only where their number is small. What the second pass
over the texts needs to know of the parts is a Bloom filter, built by the executors and never larger than ``MOST_BITS``; what passes it
is joined exactly.

Defined results: null key or text: left out; a text without personal data gives no row and is kept as it is by
``redacted``; spans do not overlap (forms, then numbers, addresses, names); the same item twice in one text is
one row of ``found``; a repeated key is treated as one text after the other.
"""

from __future__ import annotations

import re
from functools import cache
from hashlib import blake2b
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.lineage import stored
from codeloom.llm.common import checkpointed, keyed_texts, spread, text_groups

TYPES = ("email", "address", "id_number", "phone", "person")


def _ranges(test) -> str:
    """Character class of the code points below U+0530 that pass the test."""
    out, start = [], None
    for c in range(0x41, 0x531):
        if c < 0x530 and test(chr(c)):
            start = c if start is None else start
        elif start is not None:
            out.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


UP = _ranges(str.isupper)
LOW = _ranges(str.islower)
_S = r"(?:[ \t]+|[ \t]*\r?\n[ \t]*(?:(?:>|//|\*|#)[ \t]*)?)"  # a blank, or a line break within an item
_NAME_WORD = f"[{UP}][{LOW}]+(?:[-'’][{UP}]?[{LOW}]+)*"

_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|[ \t]*[\[({][ \t]*(?:dot|DOT|Dot)[ \t]*[\])}][ \t]*|[ \t]+(?:DOT|dot)[ \t]+)"
#: Mail addresses are looked for at what stands for their "@", to the left and to the right.
AT_SIGN = re.compile(r"@|[\[({][ \t]*(?:at|AT|At|@)[ \t]*[\])}]| AT | at (?=[ \t]*[A-Za-z0-9.-]+[ \t]+dot[ \t])")
AT_BRACKET = re.compile(r"[\[({][ \t]*(?:at|AT|At)[ \t]*[\])}]")
_LOCAL_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.+%-"
_DOT_WORD = re.compile(r"[ \t]dot[ \t]")
HOST = re.compile(rf"[ \t]*{_HOST}(?:{_DOT}{_HOST})+(?![\w@-])")
#: What makes an address part of a remote: the git user, a path after a colon, or a scheme before it.
_REMOTE_AFTER = re.compile(r":[\w~][\w./~-]*/|:[\w.-]+\.git|/[\w.-]")

#: Common words for kinds of streets. Addresses with them are the seeds of all others.
STREET_AFTER = "Street St Road Rd Lane Ln Avenue Ave Boulevard Blvd Drive Dr Court Ct Square Sq Place Pl Way Terrace Close Crescent Parkway Highway Row".split()
STREET_BEFORE = "Calle Avenida Rua Plaza Paseo Camino Travessa Avda Av Carrera Praça Largo Estrada Alameda Carretera Via Viale Piazza Corso".split()
STREET_RUE = "rue avenue boulevard place quai chemin allée impasse cours route Rue Avenue Boulevard Place Quai Chemin Allée Impasse".split()
STREET_END = "straße strasse str\\. weg platz gasse allee ring damm ufer pfad steig straat gatan vej".split()
_HOUSE = r"\d{1,5}(?:[a-zA-Z](?!\w))?(?:/\d{1,4})?"
_STREET_NAME = f"(?:(?:de|del|da|do|dos|das|la|las|los|el|of|the|des|du|le|les){_S})*(?:[dl]['’])?[{UP}][\\w'’-]*(?:{_S}(?:(?:de|del|da|do|la|du|des|of|e|y){_S})*[{UP}][\\w'’-]*){{0,3}}"
#: A street name that nothing follows: a second word belongs to it only at the end of a phrase.
#: Then each form of a street address, and the strings of which a text with that form has one.
_LAST_NAME = f"(?:(?:de|del|da|do|la|du|des|le|les){_S})*(?:[dl]['’])?[{UP}][\\w'’-]*(?:(?:[ \\t]+(?:de|du|des|la|le|les))*[ \\t]+[{UP}][\\w'’-]*(?=,|;|\\.?[ \\t]*\\r?(?:\\n|\\Z)|\\.[ \\t]))?"
ADDRESSES = [
    ([f" {w}" for w in STREET_AFTER], rf"(?<![\w/.:-]){_HOUSE}{_S}(?:[{UP}][\w'’-]*{_S}){{1,3}}(?:{'|'.join(STREET_AFTER)})(?!\w)"),
    ([f"{w} " for w in STREET_RUE] + [f"{w}\n" for w in STREET_RUE], rf"(?<![\w/.:-]){_HOUSE},?{_S}(?:bis{_S})?(?:{'|'.join(STREET_RUE)}){_S}{_LAST_NAME}"),
    (STREET_BEFORE, rf"(?<!\w)(?:{'|'.join(STREET_BEFORE)})\.?{_S}{_STREET_NAME},?{_S}(?:n[.º°]?{_S}?)?{_HOUSE}(?![\w.]\d)"),
    ([f"{w} ".replace("\\", "") for w in STREET_END] + [f"{w}\n".replace("\\", "") for w in STREET_END], rf"(?<!\w)[{UP}][\w-]*(?:{'|'.join(STREET_END)}){_S}{_HOUSE}(?!\w)"),
    (["Straße", "Strasse", "Weg", "Platz", "Gasse", "Allee", "Ring"], rf"(?<!\w)[{UP}][\w-]*{_S}(?:Straße|Strasse|Weg|Platz|Gasse|Allee|Ring){_S}{_HOUSE}(?!\w)"),
    (["ul.", "al.", "os.", "pl."], rf"(?<!\w)(?:ul|al|os|pl)\.{_S}?{_STREET_NAME}{_S}{_HOUSE}"),
    (["ул.", "пр.", "пер.", "просп.", "наб.", "пл.", "бул.", "ш."], rf"(?<!\w)(?:ул|пр|пер|просп|наб|пл|бул|ш)\.{_S}?{_STREET_NAME},?{_S}(?:д\.{_S}?)?{_HOUSE}(?:,?{_S}(?:корп|стр)\.{_S}?\d+)?"),
    (["улица", "проспект", "переулок", "набережная"], rf"(?<!\w)(?:улица|проспект|переулок|набережная){_S}{_STREET_NAME},?{_S}(?:д\.{_S}?|дом{_S})?{_HOUSE}"),
]
ADDRESSES = [(words, re.compile("(?:" + "|".join(map(re.escape, words)) + ")" + r"(?!\w)" * words[0].startswith(" ")), re.compile(form)) for words, form in ADDRESSES]


@cache
def _street_words():
    """One automaton over the words of all address forms; its values are the numbers of the forms."""
    import ahocorasick

    forms: dict[str, set[int]] = {}
    for i, (words, _, _) in enumerate(ADDRESSES):
        for w in words:
            forms.setdefault(w, set()).add(i)
    automaton = ahocorasick.Automaton()
    for w, of in forms.items():
        automaton.add_word(w, tuple(of))
    automaton.make_automaton()
    return automaton


#: A house number; and capitalised words right after or right before it.
HOUSE_NUMBER = re.compile(r"\d(?<![\w/.:,+–-]\d)" + _HOUSE.replace("{1,5}", "{0,4}", 1) + r"(?![\w–-])(?![.,:/]\w)")
_CAPITALISED = f"[{UP}][\\w'’-]*"
WORDS_AFTER = re.compile(f",?{_S}(?P<kind>[{LOW}]+{_S})?{_CAPITALISED}(?:{_S}{_CAPITALISED}){{0,3}}")
WORDS_BEFORE = re.compile(f"(?<![\\w'’-]){_CAPITALISED}(?:{_S}(?:(?:de|del|da|do|dos|das|la|las|los|el|of|the|des|du|le|les|van|von|der|den|y|e){_S})*{_CAPITALISED}){{0,3}},?{_S}(?:n[.º°]{_S}?)?\\Z")
#: What stands between the number and the words.
_NEXT_TO = frozenset(" \t\r\n,.º°")
_CAPITAL_WORD = re.compile(f"(?<![\\w'’-]){_CAPITALISED}")
#: Letters at the end of a compound that tell what kind of street it is.
HEAD_LETTERS = 6

_NUM_LEFT, _NUM_RIGHT = r"(?<![\w+/.-])(?<!\w[–-])", r"(?![\w])(?![-/.]\w)"
_G = r"[ .\-/]?"
#: Identity numbers whose form says what they are, and those that need a label.
ID_STRONG = re.compile(_NUM_LEFT + r"(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{8}-[A-Z]|[XYZ]-?\d{7}-[A-Z]|[A-Z]{2}\d{7}|[A-Z]\d{2}/\d{6}/\d{2})" + _NUM_RIGHT)
ID_WEAK = re.compile(_NUM_LEFT + r"(?:\d{2} \d{3} \d{3} \d{3}|\d{11}|\d{9}|\d{8}[A-Z]|[A-Z]\d{8}|[A-Z]{1,3}[ -]?\d{6,9}[A-Z]?|\d{3}\.\d{3}\.\d{3}-\d{2}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{3}[ -]\d{3}[ -]\d{3}|\d{2}[ -]\d{7}|\d{13}|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?|\d{4} \d{6}|\d{17}[\dX])" + _NUM_RIGHT)
PHONE = re.compile(
    r"(?<![\w/.:-])(?:"
    r"(?:\+|00)[1-9]\d{0,2}(?:[ .\-]?\(0?\d{1,5}\))?(?:[ .\-/]?\d{1,9}){2,6}"
    r"|\(\d{2,5}\)[ .\-]?\d{2,4}(?:[ .\-]\d{2,5}){1,3}"
    r"|\d{3}[.\-]\d{3}[.\-]\d{4}"
    r"|\d{3} \d{3} \d{4}"
    r"|0\d{2,4}[ \-/]\d{3,4}[ \-]?\d{3,4}(?:[ \-]\d{2,4})?"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0[1-9]\d{9}"
    r")(?![\w])(?![-/.]\d)"
)
PHONE_DIGITS = (8, 15)
#: Runs of digits and their separators, and the digits that the shortest number has.
NUMBERISH = re.compile(r"\d[\d .\-/()A-Z]{6,}")
LEAST_DIGITS = 6

_INITIAL = f"(?:{_S}[{UP}]\\.)?"
_UPPER_WORD = f"[{UP}]{{2,}}(?:[-'’][{UP}]{{2,}})*"
_WORDS = f"[{UP}{LOW}]+(?:[-'’][{UP}{LOW}]+)*"
NAME = re.compile(
    rf"(?<![\w–@.+/-])(?:(?P<sur>{_UPPER_WORD}|{_NAME_WORD}),{_S}(?P<giv>{_NAME_WORD}){_INITIAL}|(?P<a>{_NAME_WORD}){_INITIAL}{_S}(?P<b>{_NAME_WORD}|{_UPPER_WORD})|(?P<c>{_UPPER_WORD})(?:{_S}[{UP}]\.)?{_S}(?P<d>{_UPPER_WORD}))(?![\w–@(-])(?!\.\w)"
)
_TOKEN = re.compile(r"\w+|[^\w\s]|\n")
_PART = re.compile(f"[{UP}{LOW}]+")
#: Bits of the filter for each part, and its bounds; beyond them it lets more pass, which costs time and changes nothing.
BITS_PER_PART, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
PROBES = 4
CHUNK = 1 << 16
#: Rows of patterns, parts, heads or labels, some tens of bytes each, up to which they are broadcast.
MOST_BROADCAST = 300_000


def parts_of(name: str) -> list[str]:
    """The words of a name, without initials, in lower case; the halves of a double name count by themselves."""
    return [w.lower() for w in _PART.findall(name) if len(w) > 1]


def contexts(text: str, start: int, end: int) -> tuple[str, str]:
    """Up to three tokens to the left and to the right; a line break is a token, numbers are alike."""
    left = [x.lower() if not x.isdigit() else "9" for x in _TOKEN.findall(text, max(0, start - 60), start)][-3:]
    right = [x.lower() if not x.isdigit() else "9" for x in _TOKEN.findall(text, end, min(len(text), end + 60))][:3]
    if start == 0 or not text[:start].strip():
        left = ["\n"]
    if end >= len(text) or not text[end:].strip():
        right = ["\n"]
    # A context does not reach beyond its line.
    if "\n" in left:
        left = left[len(left) - 1 - left[::-1].index("\n") :]
    if "\n" in right:
        right = right[: right.index("\n") + 1]
    return " ".join(left), " ".join(right)


def _local_part(text: str, least: int, end: int) -> tuple[int, int] | None:
    """Where the local part of a mail address that ends before ``end`` stands, blanks between them left out."""
    before = text[least:end].rstrip(" \t")
    run = len(before) - len(before.rstrip(_LOCAL_SIGNS))
    local = before[len(before) - run :]
    if not local or not local[0].isalnum() or not (local[-1].isalnum() or local[-1] == "_"):
        return None
    return least + len(before) - run, least + len(before)


def _after_scheme(text: str, least: int, start: int) -> bool:
    """Whether what stands before is the scheme of a URL, maybe with a user's name."""
    while start > least and (text[start - 1].isalnum() or text[start - 1] in "_.:-"):
        start -= 1
    return text.endswith("://", least, start + 1) or text.endswith("//", least, start) and text[start - 3 : start - 2] == ":"


def emails(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    # The pattern has to look at every blank; most texts have none of what it can find.
    if "@" not in text and " AT " not in text and not (" at " in text and _DOT_WORD.search(text)) and not AT_BRACKET.search(text):
        return out
    last = 0
    for at in AT_SIGN.finditer(text):
        least, last = last, at.start()
        local = _local_part(text, max(0, least), at.start())
        host = HOST.match(text, at.end())
        if not local or not host:
            continue
        if _REMOTE_AFTER.match(text, host.end()) or _after_scheme(text, least, local[0]) or text[local[0] : local[1]] == "git":
            continue
        if not out or local[0] >= out[-1][1]:
            out.append((local[0], host.end()))
    return out


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    return all(end <= a or start >= b for a, b in taken)


def fixed_forms(text: str) -> list[tuple[str, int, int, bool]]:
    """(type, start, end, conclusive) of what is found by its form, without overlaps."""
    out: list[tuple[str, int, int, bool]] = []
    taken: list[tuple[int, int]] = []

    def put(kind: str, start: int, end: int, sure: bool = True) -> None:
        if _free(taken, start, end):
            taken.append((start, end))
            out.append((kind, start, end, sure))

    for a, b in emails(text):
        put("email", a, b)
    for i in sorted({i for _, of in _street_words().iter(text) for i in of}):
        _, word, form = ADDRESSES[i]
        if any(not (w[0].endswith(".") and text[w.start() - 1 : w.start()].isalpha()) for w in word.finditer(text)):
            for m in form.finditer(text):
                put("address", *m.span())
    for run in NUMBERISH.finditer(text):
        if sum(map(str.isdigit, run[0])) < LEAST_DIGITS:
            continue
        for m in _numbers(ID_STRONG, text, run):
            put("id_number", *m.span())
        for m in _numbers(PHONE, text, run):
            if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m[0]) <= PHONE_DIGITS[1]:
                put("phone", *m.span())
        for m in _numbers(ID_WEAK, text, run):
            put("id_number", *m.span(), False)
    return out


def _numbers(form: re.Pattern, text: str, run: re.Match) -> Iterator[re.Match]:
    """Matches of ``form`` that begin up to some characters before the run; where they end is up to the form."""
    at, end = max(0, run.start() - 6), run.end() + 12
    while at < run.end() and (m := form.search(text, at, end)) and m.start() < run.end():
        if m.end() + 3 < end or (m := form.match(text, m.start())):
            yield m
            at = m.end()
        else:
            return


_BEFORE_MAIL = re.compile(r"^[ \t]*\r?\n?[ \t]*[,;:]?[ \t]*\r?\n?[ \t]*[<(\[]?[ \t]*$")


def names(text: str, taken: list[tuple[str, int, int, bool]]) -> list[tuple[int, int, bool]]:
    """(start, end, seed) of candidates for names that are written with capitals."""
    spans = [(a, b) for _, a, b, _ in taken]
    mails = sorted((a, b) for kind, a, b, _ in taken if kind == "email")
    out = []
    at = 0
    while m := NAME.search(text, at):
        start, end = m.span()
        at = end
        if m["sur"] and not m["sur"].isupper():
            # "Surname, Given" with small letters: only where nothing else makes sense; the words are looked at one by one.
            at = m.end("sur")
            continue
        if not _free(spans, start, end):
            at = m.start() + 1 if not m["a"] else m.end("a")
            continue
        seed = False
        for a, b in mails:
            if 0 <= a - end <= 6 and _BEFORE_MAIL.match(text[end:a]):
                local = re.split(r"@|\(at|\[at| at ", text[a:b].lower())[0]
                parts = parts_of(text[start:end])
                seed = any(len(p) > 2 and p in local for p in parts)
        out.append((start, end, seed))
        # Three capitalised words in a row: the last two may be the name.
        if m["a"]:
            at = m.end("a")
    return out


def address_candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, head) of house numbers with capitalised words next to them. Where several words before a number could begin the
    street's name, each is a candidate."""
    last = 0
    for m in HOUSE_NUMBER.finditer(text):
        least, last = last, m.end()
        if text[last : last + 1] in _NEXT_TO and (after := WORDS_AFTER.match(text, last)):
            if _free(taken, m.start(), after.end()):
                head = after["kind"] or text[after.start() : after.end()].rsplit(None, 1)[-1]
                yield m.start(), after.end(), head.strip().lower()
        if text[m.start() - 1 : m.start()] not in _NEXT_TO:
            continue
        words = text[least : m.start()].rstrip(" \t\r\n,nº°.").rsplit(None, 1)
        if not words or not words[-1].lstrip("(\"'«“")[:1].isupper():
            continue
        from_ = max(least, text.rfind("\n\n", least, m.start()))
        line = text[from_ : m.start()]
        if run := WORDS_BEFORE.search(line):
            words = list(_CAPITAL_WORD.finditer(line, run.start()))
            for w in words:
                if _free(taken, from_ + w.start(), m.end()):
                    alone = len(words) == 1 or w is words[-1]
                    yield from_ + w.start(), m.end(), ("-" + w[0].lower()[-HEAD_LETTERS:] if alone and len(w[0]) > HEAD_LETTERS else w[0].lower())


def bloom(keys: list[str], n_bits: int = LEAST_BITS) -> np.ndarray:
    bits = np.zeros(n_bits // 8, dtype=np.uint8)
    for k in keys:
        for p in positions(k, n_bits):
            bits[p >> 3] |= 1 << (p & 7)
    return bits


def positions(key: str, n_bits: int) -> list[int]:
    """Places of a key, from two independent hashes."""
    h = int.from_bytes(blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "little")
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % n_bits for i in range(PROBES)]


def in_bloom(bits: np.ndarray, key: str) -> bool:
    return all(bits[p >> 3] >> (p & 7) & 1 for p in positions(key, len(bits) * 8))


def built_bloom(keys: DataFrame, count: int) -> np.ndarray:
    """The filter over a table of one column, in chunks by the executors; the driver gets at most ``MOST_BITS``."""
    n_bits = min(max(LEAST_BITS, 1 << (count * BITS_PER_PART).bit_length()), MOST_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for p in positions(k, n_bits):
                    at = p >> 3
                    if at // CHUNK not in chunks:
                        chunks[at // CHUNK] = np.zeros(CHUNK, dtype=np.uint8)
                    chunks[at // CHUNK][at % CHUNK] |= 1 << (p & 7)
        for i, c in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], type=pa.int32()), pa.array([c.tobytes()], type=pa.binary())], names=["chunk", "bits"])

    def unite(pdf):
        out = np.zeros(CHUNK, dtype=np.uint8)
        for b in pdf["bits"]:
            out |= np.frombuffer(b, dtype=np.uint8)
        return pdf[["chunk"]].head(1).assign(bits=out.tobytes())

    bits = np.zeros(max(n_bits // 8, CHUNK), dtype=np.uint8)
    for r in keys.mapInArrow(fill, "chunk int, bits binary").groupBy("chunk").applyInPandas(unite, "chunk int, bits binary").toLocalIterator():
        bits[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.bits, dtype=np.uint8)
    return bits[: n_bits // 8]


_MENTION = "k long, type string, start long, end long, item string, sure boolean, left string, right string, parts array<string>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())]
    columns = list(zip(*rows)) or [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types)], names=["k", "type", "start", "end", "item", "sure", "left", "right", "parts"])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in text_groups(batches):
        rows = []
        for k, t in zip(keys, texts):
            forms = fixed_forms(t)
            for kind, a, b, sure in forms:
                rows.append((k, kind, a, b, t[a:b], sure, *contexts(t, a, b), []))
            for a, b, seed in names(t, forms):
                rows.append((k, "person", a, b, t[a:b], seed, *contexts(t, a, b), sorted(set(parts_of(t[a:b])))))
            spans = [(a, b) for _, a, b, _ in forms]
            for a, b, head in address_candidates(t, spans):
                rows.append((k, "address", a, b, t[a:b], False, *contexts(t, a, b), [head]))
        yield _batch(rows)


_PAIR = rf"(?P<a>{_WORDS}),?(?:{_S}[{UP}{LOW}]\.)?{_S}(?P<b>{_WORDS})(?![\w–@-])(?!\.\w)"


def _second_pass(shared):
    """Pairs of words, in any case, of which at least one may be known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        word, pair = re.compile(rf"(?<![\w–@.+/-]){_WORDS}"), re.compile(_PAIR)
        between = re.compile(rf",?(?:{_S}[{UP}{LOW}]\.)?{_S}")
        plain = re.compile(_WORDS).findall

        unknown: set[str] = set()

        def known(w: str) -> bool:
            if w in unknown:
                return False
            if len(w) > 1 and all(in_bloom(bits, p) for p in parts_of(w)):
                return True
            if len(unknown) > 1_000_000:
                unknown.clear()
            unknown.add(w)
            return False

        for keys, texts in text_groups(batches):
            rows = []
            for k, t in zip(keys, texts):
                if not any([known(w) for w in set(plain(t)) - unknown]):
                    continue
                spans = [(a, b) for _, a, b, sure in fixed_forms(t) if sure]
                done = set()
                earlier: list[re.Match] = []
                for m in word.finditer(t):
                    last, earlier = earlier, [m, *earlier[:1]]
                    if not known(m[0]):
                        continue
                    # The word before, or the one before an initial.
                    starts = [m.start(), *[w.start() for w in last if between.fullmatch(t, w.end(), m.start())]]
                    for at in starts:
                        p = pair.match(t, at)
                        if p and p.end() >= m.end() and p.span() not in done and _free(spans, *p.span()):
                            done.add(p.span())
                            rows.append((k, "person", *p.span(), p[0], False, *contexts(t, *p.span()), sorted(set(parts_of(p[0])))))
            yield _batch(rows)

    return run


def small(df: DataFrame) -> DataFrame:
    """``df``, broadcast in joins if it has few rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def learn(mentions: DataFrame, support: int = 3, precision: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(parts, patterns): the known name parts and the accepted contexts ``(side, context)`` of names.

    One row per distinct name and context enters; the graph is rescored from the parts known then until none is new.
    """
    people = mentions.where("type = 'person' and size(parts) >= 2")
    people = checkpointed(people.groupBy("parts", "left", "right").agg(F.max("sure").alias("seed")))
    known = checkpointed(people.where("seed").select(F.explode("parts").alias("part")).distinct())
    sides = lambda df: df.select("*", F.explode(F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("context")), F.struct(F.lit("R").alias("side"), F.col("right").alias("context")))).alias("c")).select("*", "c.side", "c.context").drop("c")
    count = known.count()
    while True:
        marks = people.select("parts", "left", "right", F.explode("parts").alias("part")).join(small(known.withColumn("hit", F.lit(1))), "part", "left")
        scored = marks.groupBy("parts", "left", "right").agg((F.count("hit") == F.count("*")).alias("positive"))
        graph = sides(scored)
        patterns = checkpointed(graph.groupBy("side", "context").agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("int")).alias("hits")).where((F.col("hits") >= support) & (F.col("hits") >= precision * F.col("n"))).select("side", "context"))
        placed = graph.join(small(patterns.withColumn("ok", F.lit(1))), ["side", "context"], "left")
        votes = placed.groupBy("parts", "left", "right").agg(F.max("positive").alias("positive"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"))
        votes = votes.select(F.explode("parts").alias("part"), ((F.col("ok") > 0) | F.col("positive")).cast("int").alias("yes"))
        fresh = votes.groupBy("part").agg(F.avg("yes").alias("share"), F.sum("yes").alias("yes")).where("share >= 0.6 and yes >= 2").select("part")
        known = checkpointed(known.union(fresh).distinct())
        before, count = count, known.count()
        if count == before:
            return known, patterns


def _words(c: str, n: int) -> Column:
    """The last ``n`` words of a context, or the first ``-n``, line breaks left out."""
    words = F.filter(F.split(c, " "), lambda x: x != "\n")
    some = F.slice(words, 1, -n) if n < 0 else F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n)
    return F.array_join(some, " ")


def learn_addresses(mentions: DataFrame, support: int = 3, precision: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(contexts, heads): the words to the left that introduce street addresses, and the heads of streets, learnt from addresses of a
    known form; rescored until no head is new."""
    rows = mentions.where("type = 'address'").select("item", "left", F.get("parts", F.lit(0)).alias("head"), "sure").groupBy("item", "left", "head").agg(F.max("sure").alias("sure"))
    rows = rows.withColumn("tails", F.filter(F.array_distinct(F.array(_words("left", 3), _words("left", 2))), lambda c: F.contains(c, F.lit(" "))))
    rows = checkpointed(rows)
    heads = rows.where("false").select("head")
    count = 0
    while True:
        marked = rows.join(small(heads.withColumn("hit", F.lit(1))), "head", "left") if count else rows.withColumn("hit", F.lit(None).cast("int"))
        tails = marked.select("item", (F.col("sure") | F.col("hit").isNotNull()).alias("yes"), F.explode("tails").alias("context"))
        scored = tails.groupBy("context").agg(F.count_distinct("item").alias("n"), F.count_distinct(F.when(F.col("yes"), F.col("item"))).alias("hits"))
        contexts = checkpointed(scored.where((F.col("hits") >= support) & (F.col("hits") >= precision * F.col("n"))).select("context"))
        placed = rows.where("head is not null").select("item", "left", "head", F.explode_outer("tails").alias("context")).join(small(contexts.withColumn("ok", F.lit(1))), "context", "left")
        votes = placed.groupBy("item", "left", "head").agg(F.max("ok").alias("ok")).groupBy("head").agg(F.count("*").alias("n"), F.count("ok").alias("yes"), F.count_distinct(F.when(F.col("ok") == 1, F.col("item"))).alias("items"))
        heads = checkpointed(votes.where("items >= 2 and yes >= 0.6 * n").select("head"))
        before, count = count, heads.count()
        if count <= before:
            return contexts, heads


def learn_labels(mentions: DataFrame, support: int = 3) -> tuple[DataFrame, DataFrame]:
    """(labels, contexts): words to the left and to the right of identity numbers, learnt from those with a conclusive form, and from
    others that stand in what is known; rescored until no label is new. Phone numbers in a context speak against it."""
    ids = mentions.where("type in ('id_number', 'phone')")
    rows = ids.select("item", F.when(F.col("type") == "phone", "no").when(F.col("sure"), "yes").otherwise("open").alias("is"), _words("left", 2).alias("label"), _words("right", -2).alias("context"))
    rows = checkpointed(rows.distinct())
    labels = rows.where("false").select("label")
    count = 0
    while True:
        marked = rows.join(small(labels.withColumn("hit", F.lit(1))), "label", "left") if count else rows.withColumn("hit", F.lit(None).cast("int"))
        yes = (F.col("is") == "yes") | (F.col("is") == "open") & F.col("hit").isNotNull()
        hits, misses = (F.count_distinct(F.when(c, F.col("item"))) for c in (yes, F.col("is") == "no"))
        contexts = checkpointed(marked.where("context <> ''").groupBy("context").agg(hits.alias("hits"), misses.alias("misses")).where((F.col("hits") >= support) & (F.col("hits") >= 4 * F.col("misses"))).select("context"))
        placed = rows.where("label <> ''").join(small(contexts.withColumn("ok", F.lit(1))), "context", "left")
        good = (F.col("is") == "yes") | (F.col("is") == "open") & F.col("ok").isNotNull()
        counts = placed.groupBy("label").agg(F.count_distinct(F.when(F.col("is") == "yes", F.col("item"))).alias("seeds"), F.count_distinct(F.when(good, F.col("item"))).alias("yes"), F.count_distinct(F.when(F.col("is") == "no", F.col("item"))).alias("no"), F.count_distinct("item").alias("n"))
        sure = (F.col("seeds") >= support) & (F.col("seeds") >= 4 * F.col("no"))
        labels = checkpointed(counts.where(sure | (F.col("yes") >= 2) & (F.col("yes") >= 0.7 * F.col("n"))).select("label"))
        before, count = count, labels.count()
        if count <= before:
            return labels, contexts


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, type, start, end, item): every item found, without overlaps."""
    docs = spread(keyed_texts(df, key, text, "long"))
    first = stored(docs.mapInArrow(_first_pass, _MENTION))
    known, patterns = learn(first)
    shared = df.sparkSession.sparkContext.broadcast(built_bloom(known, known.count()).tobytes())
    second = stored(docs.mapInArrow(_second_pass(shared), _MENTION))
    # Discovered by their parts: every part is known exactly, not only by the filter.
    parts = second.select("k", "start", "end", "item", "left", "right", F.explode("parts").alias("part")).join(small(known.withColumn("hit", F.lit(1))), "part", "left")
    parts = parts.groupBy("k", "start", "end", "item", "left", "right").agg(F.count("hit").alias("hits"), F.count("*").alias("n")).where("n >= 2 and hits >= 1")
    by_parts = parts.where("hits = n").select("k", F.lit("person").alias("type"), "start", "end", "item")
    # Discovered by their contexts: accepted on both sides, or on one that is long.
    people = first.where("type = 'person' and size(parts) >= 2")
    left = small(patterns.where("side = 'L'").select(F.col("context").alias("left"), F.lit(1).alias("okl")))
    right = small(patterns.where("side = 'R'").select(F.col("context").alias("right"), F.lit(1).alias("okr")))
    placed = people.join(left, "left", "left").join(right, "right", "left")
    strong = ((F.col("okl") == 1) & (F.col("okr") == 1)) | ((F.col("okl") == 1) & (F.size(F.split("left", " ")) >= 2)) | ((F.col("okr") == 1) & (F.size(F.split("right", " ")) >= 3))
    by_context = placed.where(strong | F.col("sure")).select("k", "type", "start", "end", "item")
    # With one known part, in any case, both contexts must be accepted.
    half = parts.where("hits < n").join(left, "left").join(right, "right").select("k", F.lit("person").alias("type"), "start", "end", "item")
    labels, after = learn_labels(first)
    numbers = first.where("type = 'id_number' and not sure").withColumn("label", _words("left", 2)).withColumn("context", _words("right", -2))
    numbers = numbers.join(small(labels.withColumn("okl", F.lit(1))), "label", "left").join(small(after.withColumn("okr", F.lit(1))), "context", "left")
    weak = numbers.where("okl = 1 or okr = 1").select("k", "type", "start", "end", "item")
    introduced, heads = learn_addresses(first)
    streets = first.where("type = 'address' and not sure").withColumn("head", F.get("parts", F.lit(0)))
    for i, n in enumerate((2, 3)):
        streets = streets.withColumn("context", _words("left", n)).join(small(introduced.withColumn(f"ok{i}", F.lit(1))), "context", "left").drop("context")
    streets = streets.join(small(heads.withColumn("okh", F.lit(1))), "head", "left").where("ok0 = 1 or ok1 = 1 or okh = 1").select("k", "type", "start", "end", "item")
    sure = first.where("type <> 'person' and sure").select("k", "type", "start", "end", "item")
    people = by_parts.union(by_context).union(half).distinct()
    # Of overlapping candidates for one name the one made of known parts wins, then the first.
    ranked = people.join(by_parts.withColumn("p", F.lit(0)).select("k", "start", "end", "p").distinct(), ["k", "start", "end"], "left").withColumn("p", F.coalesce("p", F.lit(1)))
    spans = sure.withColumn("p", F.lit(-3)).unionByName(weak.withColumn("p", F.lit(-2))).unionByName(streets.withColumn("p", F.lit(-1))).unionByName(ranked)

    def settle(pdf):
        pdf = pdf.sort_values(["p", "start", "end"])
        taken: list[tuple[int, int]] = []
        keep = []
        for a, b in zip(pdf["start"], pdf["end"]):
            ok = _free(taken, a, b)
            keep.append(ok)
            if ok:
                taken.append((a, b))
        return pdf[keep][["k", "type", "start", "end", "item"]]

    previous = Window.partitionBy("k").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    following = Window.partitionBy("k").orderBy("start", "end").rowsBetween(1, 1)
    marked = spans.withColumn("clash", F.coalesce(F.max("end").over(previous) > F.col("start"), F.lit(False)) | F.coalesce(F.min("start").over(following) < F.col("end"), F.lit(False)))
    marked = stored(marked)
    clear = marked.where("not clash").select("k", "type", "start", "end", "item")
    settled = marked.where("clash").groupBy("k").applyInPandas(settle, "k long, type string, start long, end long, item string")
    return clear.unionByName(settled)


def found(df: DataFrame, key: str, text: str) -> DataFrame:
    return detect(df, key, text).select("k", "type", "item").distinct()


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, text, n_items): the texts with each item replaced by its type in brackets."""
    items = detect(df, key, text).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "end", "type"))).alias("items"))
    texts = keyed_texts(df, key, text, "long")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for t, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at, pieces = 0, []
                for i in items or []:
                    pieces += [t[at : i["start"]], f"[{i['type'].upper()}]"]
                    at = i["end"]
                out.append("".join(pieces) + t[at:])
                n.append(len(items or []))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string()), pa.array(n, type=pa.int64())], names=["k", "text", "n_items"])

    return texts.join(items, "k", "left").select("k", "t", "items").mapInArrow(replace, "k long, text string, n_items long")
