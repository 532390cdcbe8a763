"""Functions paired with their documentation (problem 3): declaration trees with attached comments.

``parse`` builds the tree of a file's declarations: namespaces, classes and functions with exact source ranges, and the
comment that ends on the line above each. Function bodies are not parsed expression by expression; they are crossed
by their braces, and looked into again only where they define local classes. Where the branches of a conditional of the
preprocessor open and close different braces, only the branch that is compiled is read; else all of them are. ``describes`` decides
whether a comment is a description: tags, parameter names, markers, header fields and commented-out code are taken out first, and what
only repeats the words of the name is none.

Defined results: null key or text: left out; text that is no C++ gives what can be read as definitions, and never an
error; several definitions of one name in a file give one row each in ``documented_functions``; a repeated key is
a file of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm import cpp_lexer as X
from codeloom.llm import cpp_parser
from codeloom.llm.common import keyed_texts, spread, text_groups
from codeloom.llm.language import _CODE, CJK

_TOKEN = re.compile(r"""(?P<pp>^[ \t]*\#(?:[^\n\\/]|\\(?:\r?\n|.)|/(?![/*]))*)|(?P<id>~?[A-Za-z_$\u0080-￿][\w$]*)|(?P<num>\d(?:[\w.]|'\w)*)|(?P<p>::|->|\[\[|[^\s\w])""", re.M)
_LOCAL_CLASS = re.compile(r"\b(?:struct|class|union)\b[^;(){}=]*\{")
#: Words before a parenthesis that make it no parameter list.
NOT_NAMES = frozenset("if for while switch catch return sizeof alignof decltype noexcept throw new delete static_assert alignas typeid co_await co_return co_yield else do case __attribute__ __declspec requires explicit".split())
_ACCESS = re.compile(r"(?:public|private|protected)\s*:")
_CLASS_WORDS = frozenset(("class", "struct", "union"))


@dataclass
class Node:
    kind: str  # file, namespace, class, function
    name: str
    start: int
    end: int = -1
    comment: tuple[int, int] | None = None
    children: list["Node"] = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        yield self
        for c in self.children:
            yield from c.walk()


class _Parser:
    def __init__(self, text: str):
        self.text = text = _one_branch(text)
        spans, _ = X.lex(text, braces=True)
        self.comments: list[tuple[int, int]] = []
        self.last_kind = ""
        self.braces: list[tuple[str, int]] = []
        self.spans = [s for s in spans if s[0] not in ("{", "}")]
        self.starts = [s[1] for s in self.spans]
        for kind, a, b in spans:
            if kind in (X.LINE, X.BLOCK):
                self._comment(kind, a, b)
            elif kind == "{" or kind == "}":
                self.braces.append((kind, a))
        self.closing: dict[int, int] = {}
        stack: list[int] = []
        for kind, a in self.braces:
            if kind == "{":
                stack.append(a)
            elif stack:
                self.closing[stack.pop()] = a
        self.by_end = {b: (a, b) for a, b in self.comments}

    def _comment(self, kind: str, a: int, b: int) -> None:
        """Comments that have their lines to themselves; line comments on successive lines are one."""
        line = self.text.rfind("\n", 0, a) + 1
        if self.text[line:a].strip():
            return
        if kind == X.LINE and self.last_kind == X.LINE:
            start, end = self.comments[-1]
            between = self.text[end:a]
            if not between.strip() and between.count("\n") == 1:
                self.comments[-1] = (start, b)
                return
        self.comments.append((a, b))
        self.last_kind = kind

    def tokens(self, start: int, end: int) -> Iterator[tuple[str, str, int, int]]:
        """(kind, text, start, end) of the tokens outside comments; literals are one token. The consumer may send a
        position to go on from."""
        at, i = start, bisect_left(self.starts, start)
        match = _TOKEN.search
        while at < end:
            stop = min(self.starts[i] if i < len(self.starts) else end, end)
            m = match(self.text, at, stop) if at < stop else None
            if m is None:
                if stop >= end:
                    return
                kind, a, b = self.spans[i]
                i += 1
                at = max(b, at)
                if kind not in (X.LINE, X.BLOCK) and a >= start:
                    sent = yield "lit", "", a, b
                else:
                    continue
            else:
                at = m.end()
                sent = yield m.lastgroup, m[0], m.start(), at
            if sent is not None:
                yield "", "", 0, 0
                at = sent
                i = bisect_left(self.starts, at)

    def scope(self, parent: Node, start: int, end: int) -> None:
        """Children of a file, namespace or class body."""
        head: list[tuple[str, str, int, int]] = []
        depth = 0
        tokens = self.tokens(start, end)
        for tok in tokens:
            kind, t, a, b = tok
            if kind == "pp":
                continue
            if kind == "p":
                if t in "([" or t == "[[":
                    depth += len(t)
                elif t in ")]":
                    depth = max(0, depth - 1)
                elif t == ";" and depth == 0:
                    head = []
                    continue
                elif t == "}":
                    head, depth = [], 0
                    continue
                elif t == ":" and depth == 0 and len(head) == 1 and head[0][1] in ("public", "private", "protected"):
                    head = []
                    continue
                elif t == "{" and depth == 0:
                    close = self.closing.get(a, end)
                    node = self.classify(head, a)
                    if node is None and head and self.is_initializer(head):
                        head.append(("lit", "{}", a, close + 1))
                    else:
                        if node is not None:
                            node.end = min(close + 1, len(self.text))
                            parent.children.append(node)
                            if node.kind in ("namespace", "class"):
                                self.scope(node, b, close)
                            elif _LOCAL_CLASS.search(self.text, b, close):
                                self.inside(node, b, close)
                        head = []
                    tokens.send(close + 1)
                    continue
                elif t == "{":
                    tokens.send(self.closing.get(a, end) + 1)
                    continue
            head.append(tok)

    def inside(self, parent: Node, start: int, end: int) -> None:
        """Local classes of a function body."""
        at = start
        while m := _LOCAL_CLASS.search(self.text, at, end):
            brace = m.end() - 1
            if brace not in self.closing:
                at = m.end()
                continue
            close = self.closing[brace]
            name = re.search(r"(?:struct|class|union)\s+(\w+)", m[0])
            node = Node("class", name[1] if name else "", m.start(), close + 1)
            parent.children.append(node)
            self.scope(node, brace + 1, close)
            at = close

    @staticmethod
    def is_initializer(head: list) -> bool:
        """Whether a brace after ``head`` opens a value: ``x = {``, or ``: member{`` of a constructor."""
        words = [t for _, t, _, _ in head]
        return "=" in words or (":" in words and ")" in words)

    def classify(self, head: list, brace: int) -> Node | None:
        if not head:
            return None
        start = head[0][2]
        i = 0
        words = [t for _, t, _, _ in head]
        while i < len(words) and words[i] == "template" or i < len(words) and words[i] == "[[":
            i = self._skip(words, i + 1, "<", ">") if words[i] == "template" else self._skip(words, i, "[[", "]")
        rest = words[i:]
        if not rest:
            return None
        if "namespace" in rest[:2]:
            return Node("namespace", rest[-1], start)
        if rest[0] == "extern" and head[i + 1 : i + 2] and head[i + 1][0] == "lit" and len(rest) == 2:
            return Node("namespace", "extern", start)
        if "enum" in rest[:2]:
            return None
        call = self._parameters(head, words, i)
        if call is None:
            if any(w in _CLASS_WORDS for w in rest[:4]) and "=" not in rest:
                at = next(j for j, w in enumerate(rest) if w in _CLASS_WORDS)
                names = [w for (k, w, _, _) in head[i + at + 1 :] if k == "id" and w != "final"]
                return Node("class", names[0] if names else "", start, comment=self.above(start))
            return None
        return Node("function", call, start, comment=self.above(start))

    @staticmethod
    def _skip(words: list[str], i: int, opening: str, closing: str) -> int:
        if i >= len(words) or words[i] != opening:
            return i
        depth = 0
        while i < len(words):
            depth += (words[i] == opening) - (words[i] == closing)
            i += 1
            if depth <= 0:
                break
        return i + (closing == "]" and i < len(words) and words[i] == "]")

    def _parameters(self, head: list, words: list[str], i: int) -> str | None:
        """Name of the function whose head this is."""
        depth = angle = 0
        for j in range(i, len(words)):
            w = words[j]
            if w == "operator" and depth == 0:
                k = j + 1
                while k < len(words) and (words[k] != "(" or k == j + 1 and words[k + 1 : k + 3] == [")", "("]):
                    k += 1
                if k + 1 < len(words) and words[k] == "(" and words[k + 1 : k + 3] == [")", "("]:
                    k += 2
                return "operator" + "".join(words[j + 1 : k]) if k < len(words) else None
            if w == "(":
                if depth == 0 and j > i and head[j - 1][0] == "id" and words[j - 1] not in NOT_NAMES:
                    end = self._skip(words, j, "(", ")")
                    tail = words[end:]
                    if "=" in words[i:j]:
                        return None
                    if tail and tail[0] not in ("const", "noexcept", "override", "final", "volatile", "&", "-", "->", ":", "try", "throw", "[[", "__attribute__", "requires", "mutable"):
                        if head[end][0] == "id" and tail[0].isupper():
                            return words[j - 1]  # a macro after the parameters
                        if tail[0] == "(":  # a macro call before, or a function returning a function pointer
                            continue
                        if head[end][0] == "id":  # a macro call before the head
                            continue
                        return None
                    return words[j - 1]
                depth += 1
            elif w == ")":
                depth -= 1
        return None

    def above(self, start: int) -> tuple[int, int] | None:
        """The comment that ends on the line above."""
        line = self.text.rfind("\n", 0, start) + 1
        if (first := self.text[line:start].strip()) and not _ACCESS.fullmatch(first):
            return None  # another declaration begins the line
        before = line - 1
        if before < 0:
            return None
        end = len(self.text[: before].rstrip(" \t\r"))
        previous = self.text.rfind("\n", 0, before) + 1
        if end <= previous:
            return None
        return self.by_end.get(end) or self.by_end.get(before) or next((c for c in (self.by_end.get(e) for e in range(end, before + 1)) if c), None)


def _one_branch(text: str) -> str:
    """The text, of the same length, with blanks for branches that are not compiled, where branches differ in their braces."""
    if "#" not in text or not re.search(r"^[ \t]*#[ \t]*(?:else|elif|endif)\b", text, re.M):
        return text
    spans, _ = X.lex(text, braces=True)
    braces = [(a, 1 if kind == "{" else -1) for kind, a, _ in spans if kind in ("{", "}")]
    tokens = [(a, b) for kind, a, b in spans if kind not in ("{", "}")]
    starts = [a for a, _ in tokens]

    def inside(place: int) -> bool:
        i = bisect_left(starts, place + 1) - 1
        return i >= 0 and place < tokens[i][1]

    gone: list[tuple[int, int]] = []
    for branches, taken in cpp_parser.conditionals(text, inside):
        if any(sum(d for at, d in braces if a <= at < b) for a, b in branches):
            dropped = [r for i, r in enumerate(branches) if i != taken]
            gone += dropped
            braces = [(at, d) for at, d in braces if not any(a <= at < b for a, b in dropped)]
    for a, b in gone:
        text = text[:a] + re.sub(r"[^\n]", " ", text[a:b]) + text[b:]
    return text


def parse(text: str) -> Node:
    root = Node("file", "", 0, len(text))
    _Parser(text).scope(root, 0, len(text))
    return root


_HEADER_TAG = re.compile(r"^\s*[@\\](?:author|authors|date|version|file|since|copyright|license|see|sa|ref)\b.*$", re.I)
_PARAM = re.compile(r"(?<![\w.])[@\\](?:t?param(?:\s*\[[^\]]*\])?\s+[\w.]+|(?:throws|exception|retval|p|a|c|ref)\s+[\w.:]+|[A-Za-z]+\{?)")
_PROSE_WORD = re.compile(f"[^\\W\\d_{CJK}]+(?:['’-][^\\W\\d_{CJK}]+)*")
_WIDE = re.compile(f"[{CJK}]")
LEAST_WORDS, LEAST_WIDE = 6, 10


def description(comment: str, name: str = "") -> str:
    """The prose of a comment on one line."""
    lines = []
    for line in X.comment_lines(comment):
        if not line or _HEADER_TAG.match(line) or _CODE.search(line):
            continue
        lines.append(_PARAM.sub(" ", line).strip())
    text = " ".join(x for x in lines if x)
    return "" if name and _repeats(text, name) else text


#: Words that add nothing to a name.
_FILLERS = frozenset("a an the this that function method of to for and is it".split())
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\da-zA-Z_]+")


def _repeats(text: str, name: str) -> bool:
    """Whether a text has no words but those of a name, in whatever form, and fillers."""
    words = {w.lower() for w in _PROSE_WORD.findall(text)}
    parts = {p.lower() for p in _NAME_PARTS.findall(name)} | {name.lower()}
    stem = lambda w: w[:-1] if w.endswith("s") and len(w) > 3 else w
    return bool(words) and not _WIDE.search(text) and {stem(w) for w in words - _FILLERS} <= {stem(p) for p in parts}


def describes(text: str) -> bool:
    return len(_PROSE_WORD.findall(text)) >= LEAST_WORDS or len(_WIDE.findall(text)) >= LEAST_WIDE


def documented(text: str) -> list[tuple[str, str, int, int]]:
    """(name, description, start, end) of the described functions; start is that of the comment."""
    out = []
    for node in parse(text).walk():
        if node.kind == "function" and node.comment:
            prose = description(text[slice(*node.comment)], node.name)
            if describes(prose):
                out.append((node.name, prose, node.comment[0], node.end))
    return out


def documented_functions(df: DataFrame, key: str, text: str, code: bool = True) -> DataFrame:
    """(k, name, description, code): ``code`` is the exact source, from the comment to the closing brace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches):
            rows = [(k, name, prose, *([t[a:b]] if code else [])) for k, t in zip(keys, texts) for name, prose, a, b in documented(t)]
            columns = list(zip(*rows)) or [[]] * (3 + code)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.string()) for c in columns], names=["k", "name", "description", "code"][: 3 + code])

    return spread(keyed_texts(df, key, text)).mapInArrow(run, "k string, name string, description string" + ", code string" * code)
