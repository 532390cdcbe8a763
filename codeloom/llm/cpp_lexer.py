"""Comments, literals and braces of C++ text, as a function on lexer states that can be composed over chunks.

A state is a string: "" in code, "//" in a line comment, "/*" in a block comment, '"' in a string, "'" in a
character, and 'R' + delimiter in a raw string. ``lex`` starts in any state and tells the one it ends in, so the lexing of
a chunk is a map from states to states; maps compose, composition is associative, and a prefix scan over the
chunks of a file gives each chunk the state it starts in. Chunks end after a line break, where no
token but those above can be cut. ``scan`` reads a whole text that way.

A map costs little more than lexing the chunk once: from whatever state, once the token that was open has ended at a place where
lexing from code stands in code, too, both go on alike.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

CODE, LINE, BLOCK, STRING, CHAR = "", "//", "/*", '"', "'"
STATES = (CODE, LINE, BLOCK, STRING, CHAR)
#: Characters of a chunk of ``scan``, at least.
CHUNK = 1024

_EVENT = re.compile(r"""//|/\*|["'{}]""")
_EVENT_NO_BRACES = re.compile(r"""//|/\*|["']""")
_LINE_END = re.compile(r"[^\n\\]*(?:\\(?:\r?\n|[^\n]|\Z)[^\n\\]*)*", re.S)
_STRING_END = re.compile(r'[^"\\\n]*(?:\\(?:\r?\n|.|\Z)[^"\\\n]*)*', re.S)
_CHAR_END = re.compile(r"[^'\\\n]*(?:\\(?:\r?\n|.|\Z)[^'\\\n]*)*", re.S)
_RAW_OPEN = re.compile(r'([^()\\\s"]{0,16})\(')
_PREFIX = re.compile(r"(?<![A-Za-z0-9_])(?:u8|[uUL])?(R?)\Z")
RAW_DELIMITERS = re.compile(r'R"([^()\\\s"]{0,16})\(')


def _open_continues(text: str, end: int) -> bool:
    """Whether a token that ran to the end of the text was cut after a backslash and line break."""
    return text.endswith(("\\\n", "\\\r\n"), 0, end) and end == len(text)


def _opened(text: str, state: str) -> tuple[str, int, str]:
    """(kind, end, state) of the token that is open where the text begins; the state is that at its end."""
    n = len(text)
    if state == LINE:
        at = _LINE_END.match(text, 0).end()
        return LINE, at, LINE if at == n and _open_continues(text, n) else CODE
    if state == BLOCK:
        end = text.find("*/")
        return (BLOCK, n, BLOCK) if end < 0 else (BLOCK, end + 2, CODE)
    if state in (STRING, CHAR):
        at = (_STRING_END if state == STRING else _CHAR_END).match(text, 0).end()
        if at == n and _open_continues(text, n):
            return state, n, state
        return state, at + 1 if at < n and text[at] == state else at, CODE
    close = ")" + state[1:] + '"'
    end = text.find(close)
    return ("R", n, state) if end < 0 else ("R", end + len(close), CODE)


def lex(text: str, state: str = CODE, braces: bool = False) -> tuple[list[tuple[str, int, int]], str]:
    """(kind, start, end) of the comments and literals, markers included, and the state at the end. With ``braces`` also
    ("{", i, i + 1) and ("}", i, i + 1). A string that is not closed on its line ends there."""
    out: list[tuple[str, int, int]] = []
    n, at = len(text), 0
    search = (_EVENT if braces else _EVENT_NO_BRACES).search
    if state != CODE:
        kind, at, after = _opened(text, state)
        out.append((kind, 0, at))
        if after != CODE:
            return out, after
    while m := search(text, at):
        i = m.start()
        c = m[0]
        if c == "//":
            at = _LINE_END.match(text, i + 2).end()
            out.append((LINE, i, at))
            if at == n and _open_continues(text, n):
                return out, LINE
        elif c == "/*":
            end = text.find("*/", i + 2)
            if end < 0:
                out.append((BLOCK, i, n))
                return out, BLOCK
            at = end + 2
            out.append((BLOCK, i, at))
        elif c == '"':
            raw = text[i - 1 : i] == "R" and (p := _PREFIX.search(text, max(0, i - 4), i)) and p[1] and _RAW_OPEN.match(text, i + 1)
            if raw:
                close = ")" + raw[1] + '"'
                end = text.find(close, raw.end())
                if end < 0:
                    out.append(("R", i, n))
                    return out, "R" + raw[1]
                at = end + len(close)
                out.append(("R", i, at))
                continue
            at = _STRING_END.match(text, i + 1).end()
            if at == n:
                out.append((STRING, i, n))
                return out, STRING if _open_continues(text, n) else CODE
            at += text[at] == '"'
            out.append((STRING, i, at))
        elif c == "'":
            before = text[i - 1 : i]
            if before.isalnum() or before == "_":
                p = _PREFIX.search(text, max(0, i - 3), i)
                if not (p and p[0]):
                    at = i + 1  # a digit separator
                    continue
            at = _CHAR_END.match(text, i + 1).end()
            if at == n:
                out.append((CHAR, i, n))
                return out, CHAR if _open_continues(text, n) else CODE
            at += text[at] == "'"
            out.append((CHAR, i, at))
        else:
            out.append((c, i, i + 1))
            at = i + 1
    return out, CODE


def transitions(text: str, delimiters: Iterable[str] = (), from_code: tuple[list[tuple[str, int, int]], str] | None = None) -> dict[str, str]:
    """The map from the state before a chunk to the state after it; ``from_code`` is ``lex(text)``, if there is one already."""
    spans, end = from_code or lex(text)
    starts = [a for _, a, _ in spans]
    out = {CODE: end}
    for s in (*STATES[1:], *("R" + d for d in delimiters)):
        _, at, after = _opened(text, s)
        if after == CODE and at < len(text):
            i = bisect_left(starts, at) - 1  # the last token that begins before
            after = end if i < 0 or spans[i][2] <= at else lex(text, s)[1]
        out[s] = after
    return out


def scan(text: str, size: int = CHUNK) -> list[tuple[str, int, int]]:
    """``lex(text)[0]`` by composed maps of chunks: each chunk is read on its own, and tokens that cross chunks are put together."""
    pieces = chunks(text, size)
    read = [lex(p) for p in pieces]
    if len(pieces) == 1:
        return read[0][0]
    delimiters = set(RAW_DELIMITERS.findall(text))
    states = entry_states([transitions(p, delimiters, r) for p, r in zip(pieces, read)])
    out: list[tuple[str, int, int]] = []
    at = 0
    for p, state, r in zip(pieces, states, read):
        spans = r[0] if state == CODE else lex(p, state)[0]
        if state != CODE:
            kind, start, _ = out[-1]
            out[-1] = kind, start, at + spans[0][2]
            spans = spans[1:]
        out += [(kind, at + a, at + b) for kind, a, b in spans]
        at += len(p)
    return out


def compose(first: dict[str, str], then: dict[str, str]) -> dict[str, str]:
    return {s: then.get(t, t) for s, t in first.items()}


def entry_states(maps: list[dict[str, str]]) -> list[str]:
    """The state before each chunk, by a prefix scan that doubles its reach in every step."""
    scan = list(maps)
    step = 1
    while step < len(scan):
        scan = [compose(scan[i - step], scan[i]) if i >= step else scan[i] for i in range(len(scan))]
        step *= 2
    return [CODE, *(m[CODE] for m in scan[:-1])] if scan else []


def chunks(text: str, size: int) -> list[str]:
    """The text cut after line breaks, each piece at least ``size`` characters long but the last."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find("\n", at + size - 1) + 1
        if not cut:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) or not out else out


_ESCAPE = re.compile(r"\\(?:u\{?([0-9a-fA-F]{4})\}?|U([0-9a-fA-F]{8})|(\r?\n)|((?:x[0-9a-fA-F]+|[0-7]{1,3})(?:\\(?:x[0-9a-fA-F]+|[0-7]{1,3}))*)|(.))", re.S)
#: The simple escape sequences of C++.
SIMPLE_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def _unescape_one(m: re.Match) -> str:
    if m[1] or m[2]:
        code = int(m[1] or m[2], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
    if m[3]:
        return ""
    if m[4]:
        raw = bytes(int(b[1:], 16) & 255 if b[0] == "x" else int(b, 8) & 255 for b in m[4].split("\\"))
        return raw.decode("utf-8", "replace")
    return SIMPLE_ESCAPES.get(m[5], m[5])


def printed(kind: str, literal: str) -> str:
    """What a string literal, with its quotes, would print. Bytes given by \\x or octal escapes are UTF-8."""
    if kind == "R":
        inner = literal[literal.find("(") + 1 :]
        end = inner.rfind(")")
        return inner[:end] if end >= 0 and inner.endswith('"') else inner
    inner = literal[literal.find('"') + 1 :]
    inner = inner[:-1] if inner.endswith('"') else inner
    return _ESCAPE.sub(_unescape_one, inner) if "\\" in inner else inner


_MARKER = re.compile(r"^[ \t]*(?:/\*+[!<]*|//[/!]*<?|\*+/?)?[ \t]?|[ \t]*\*+/[ \t]*$")


def comment_lines(comment: str) -> list[str]:
    """The lines of a comment without its markers; a backslash at the end of a line comment's line joins lines."""
    out = []
    for line in comment.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        out.append(_MARKER.sub("", line).strip())
    return out
