"""A C++17 parser that only decides whether text can be parsed: recursive descent over declarations and statements,
precedence climbing over expressions, panic-mode recovery.

Names are not resolved. Where C++ needs to know whether a name is a type, both readings are tried and either will
do. Text that the preprocessor removes is not looked at; macros of the file itself are expanded.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<ws>[ \t\r\f\v]+|\\\r?\n)
|(?P<nl>\n)
|(?P<com>//[^\n\\]*(?:\\(?:\r?\n|[^\n])[^\n\\]*)*\\?|/\*.*?\*/)
|(?P<raw>(?:u8|[uUL])?R"(?P<d>[^()\\\s"]{0,16})\(.*?\)(?P=d)"(?:_\w+)?)
|(?P<str>(?:u8|[uUL])?"[^"\\\n]*(?:\\(?:\r?\n|.)[^"\\\n]*)*"(?:_?[A-Za-z]\w*)?)
|(?P<chr>(?:u8|[uUL])?'[^'\\\n]+(?:\\.[^'\\\n]*)*'|(?:u8|[uUL])?'(?:\\.[^'\\\n]*)+')
|(?P<id>[A-Za-z_$ª-˿Ͱ-῿Ⰰ-⿯〡-퟿豈-﷏ﷰ-﻾Ａ-ￜ][\w$]*)
|(?P<num>\.?\d(?:[eEpP][+-]|'?[\w.])*)
|(?P<p><<=|>>=|\.\.\.|->\*|::|\.\*|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|\#\#|[-+*/%&|^~!<>=?:;,.(){}\[\]\#])
|(?P<bad>.)""",
    re.S | re.X,
)

#: The same tokens for the main loop, with the blanks before them, the frequent ones first.
_NEXT = re.compile(
    r"""(?:[ \t\r\f\v]+|\\\r?\n)*(?:
(?P<id>(?!(?:u8|[uUL])?R?["'])[A-Za-z_$ª-˿Ͱ-῿Ⰰ-⿯〡-퟿豈-﷏ﷰ-﻾Ａ-ￜ][\w$]*)
|(?P<p>[;,(){}\[\]]|<<=|>>=|\.\.\.|->\*|::|\.\*|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*%&|^]=|/(?![/*])=?|\#\#|[-+*%&|^~!<>=?:\#]|\.(?!\d))
|(?P<nl>\n)
|(?P<num>\.?\d(?:[eEpP][+-]|'?[\w.])*)
|(?P<str>(?:u8|[uUL])?"[^"\\\n]*(?:\\(?:\r?\n|.)[^"\\\n]*)*"(?:_?[A-Za-z]\w*)?)
|(?P<com>//[^\n\\]*(?:\\(?:\r?\n|[^\n])[^\n\\]*)*\\?|/\*.*?\*/)
|(?P<chr>(?:u8|[uUL])?'[^'\\\n]+(?:\\.[^'\\\n]*)*'|(?:u8|[uUL])?'(?:\\.[^'\\\n]*)+')
|(?P<raw>(?:u8|[uUL])?R"(?P<d>[^()\\\s"]{0,16})\(.*?\)(?P=d)"(?:_\w+)?)
|(?P<word>[A-Za-z_]\w*)
|(?P<end>\Z)
|(?P<bad>.))""",
    re.S | re.X,
)

#: The words of the language.
KEYWORDS = frozenset(
    "alignas alignof and and_eq asm auto bitand bitor bool break case catch char char16_t char32_t class compl const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq".split()
)
BUILTIN = frozenset("bool char char16_t char32_t double float int long short signed unsigned void wchar_t auto __int128 __int128_t __float128".split())
SPECIFIERS = frozenset("static inline constexpr const volatile virtual explicit friend extern mutable thread_local register __inline __inline__ __forceinline __restrict __extension__".split())
STATEMENT_ONLY = frozenset("break case catch continue default do else for goto if return switch try while".split())
WORD_OPERATORS = {"and": "&&", "or": "||", "not": "!", "xor": "^", "bitand": "&", "bitor": "|", "compl": "~", "not_eq": "!=", "and_eq": "&=", "or_eq": "|=", "xor_eq": "^="}
#: Precedence of the binary operators.
PRECEDENCE = {op: level for level, ops in enumerate((("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"), (".*", "->*")), 1) for op in ops}
ASSIGNMENTS = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
#: What follows the first name of an expression, and never that of a declaration.
ONLY_EXPRESSIONS = ASSIGNMENTS | frozenset(". -> ++ -- [ << >> + - / % == != <= >= || ? ;".split())
CASTS = frozenset("static_cast dynamic_cast reinterpret_cast const_cast".split())
_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F']*(?:\.[0-9a-fA-F']*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*)?\.?\d*[\d']*(?:[eE][+-]?\d[\d']*)?)(?:_\w+|[uUlLfFzZ]{0,4}|[iIjJ]|i64|ui64|s|ms|us|ns|h|min|sv)?\Z")


class Failure(Exception):
    pass


#: The macros that a C++17 compiler (here g++ on 64-bit Linux) has before the first line.
_NUMBERS = {
    "__cplusplus": "201703L", "__STDC__": "1", "__STDC_HOSTED__": "1", "__LINE__": "1", "__COUNTER__": "0", "__INCLUDE_LEVEL__": "0", "__GNUC__": "13", "__GNUC_MINOR__": "2", "__GNUC_PATCHLEVEL__": "0", "__GNUG__": "13", "__GXX_RTTI": "1", "__EXCEPTIONS": "1", "__STRICT_ANSI__": "1", "_GNU_SOURCE": "1",
    "__linux__": "1", "__linux": "1", "__gnu_linux__": "1", "__unix__": "1", "__unix": "1", "__ELF__": "1", "__x86_64__": "1", "__x86_64": "1", "__amd64__": "1", "__amd64": "1", "__LP64__": "1", "_LP64": "1", "__SSE__": "1", "__SSE2__": "1", "__CHAR_BIT__": "8", "__INT_MAX__": "0x7fffffff", "__LONG_MAX__": "0x7fffffffffffffffL",
    "__SIZEOF_SHORT__": "2", "__SIZEOF_INT__": "4", "__SIZEOF_LONG__": "8", "__SIZEOF_LONG_LONG__": "8", "__SIZEOF_POINTER__": "8", "__SIZEOF_INT128__": "16", "__ORDER_LITTLE_ENDIAN__": "1234", "__ORDER_BIG_ENDIAN__": "4321", "__BYTE_ORDER__": "1234",
    "__cpp_constexpr": "201603L", "__cpp_if_constexpr": "201606L", "__cpp_structured_bindings": "201606L", "__cpp_fold_expressions": "201603L", "__cpp_inline_variables": "201606L", "__cpp_deduction_guides": "201703L", "__cpp_lambdas": "200907L", "__cpp_generic_lambdas": "201304L", "__cpp_variadic_templates": "200704L", "__cpp_range_based_for": "201603L", "__cpp_static_assert": "201411L", "__cpp_decltype": "200707L", "__cpp_rvalue_references": "200610L", "__cpp_exceptions": "199711L", "__cpp_rtti": "199711L", "__cpp_aligned_new": "201606L", "__cpp_noexcept_function_type": "201510L",
}
PREDEFINED = {k: (None, [("num", v)]) for k, v in _NUMBERS.items()} | {k: (None, [("str", '""')]) for k in ("__FILE__", "__BASE_FILE__", "__DATE__", "__TIME__", "__TIMESTAMP__", "__VERSION__")} | {"__has_include": (None, [])}


class Lexed:
    """Tokens of one file after the preprocessor: kinds, texts and lines, closed by an end token."""

    def __init__(self, text: str):
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.lines: list[int] = []
        self.errors: list[tuple[int, str]] = []
        self._run(text)
        self.kinds.append("end")
        self.texts.append("")
        self.lines.append(self.lines[-1] if self.lines else 1)

    def _error(self, line: int, what: str) -> None:
        self.errors.append((line, what))

    def _run(self, text: str) -> None:
        text = text.lstrip("﻿")
        line = 1
        start_of_line = True
        macros: dict[str, tuple[list[str] | None, list[tuple[str, str]]]] = dict(PREDEFINED)
        stack: list[list] = []  # [active before, some branch taken, active now, saw else]
        active = True
        kinds, texts, lines = self.kinds, self.texts, self.lines
        at, match = 0, _NEXT.match
        spliced = "\\\n" in text or "\\\r\n" in text
        while True:
            m = match(text, at)
            kind, index = m.lastgroup, m.lastindex
            value, begin, at = m[index], at, m.end()
            if spliced:
                line += text.count("\n", begin, m.start(index))
            if kind == "p" and value != "#":
                start_of_line = False
                if active:
                    kinds.append(kind)
                    texts.append(value)
                    lines.append(line)
                continue
            if kind == "nl":
                line += 1
                start_of_line = True
                continue
            if kind == "end":
                break
            if value == "#" and start_of_line:
                body, at, more = self._directive(text, at)
                active = self._preprocess(body, line, macros, stack, active)
                line += more
                continue
            if kind == "com":
                line += value.count("\n")
                continue
            start_of_line = False
            if not active:
                # Groups that are skipped are still cut into tokens, but anything goes in them.
                if kind in ("raw", "str"):
                    line += value.count("\n")
                continue
            if kind == "p":
                kinds.append(kind)
                texts.append(value)
                lines.append(line)
            elif kind == "id" or kind == "word":
                if value in macros:
                    if macros[value][0] is None:
                        self._emit(self._expand([("id", value)], macros, frozenset()), line)
                        continue
                    rest, _, after, after_line = self._call(text, at, line)
                    if rest is not None:
                        self._emit(self._expand([("id", value), *rest], macros, frozenset()), line)
                        at, line = after, after_line
                        continue
                kinds.append("id")
                texts.append(value)
                lines.append(line)
            elif kind == "bad":
                if value == "/" and text.startswith("*", at):
                    self._error(line, "unterminated comment")
                    break
                self._error(line, {'"': "missing terminating \" character", "'": "missing terminating ' character"}.get(value, f"stray {value!r} in program"))
                if value in "\"'":
                    end = text.find("\n", at)
                    at = len(text) if end < 0 else end
            else:
                if kind == "num" and not _NUMBER.match(value):
                    self._error(line, f"invalid number {value[:20]!r}")
                kinds.append("str" if kind == "raw" else kind)
                texts.append('""' if kind == "raw" else value)
                lines.append(line)
                line += value.count("\n")
        if stack:
            self._error(line, "unterminated conditional directive")
        if not WORD_OPERATORS.keys().isdisjoint(texts):
            for i, value in enumerate(texts):
                if value in WORD_OPERATORS:
                    kinds[i], texts[i] = "p", WORD_OPERATORS[value]

    def _emit(self, tokens: list[tuple[str, str]], line: int) -> None:
        for k, v in tokens:
            self.kinds.append(k)
            self.texts.append(v)
            self.lines.append(line)

    @staticmethod
    def _directive(text: str, at: int) -> tuple[str, int, int]:
        """The logical line of a directive without comments, where it ends, and how many lines it has."""
        end = text.find("\n", at)
        whole = text[at:] if end < 0 else text[at:end]
        if "\\" not in whole and "/" not in whole and '"' not in whole:
            return whole.strip(), len(text) if end < 0 else end, 0
        out, lines, n = [], 0, len(text)
        while at < n:
            c = text[at]
            if c == "\n":
                break
            if c == "\\" and (m := re.compile(r"\\[ \t]*\r?\n").match(text, at)):
                at = m.end()
                lines += 1
                out.append(" ")
            elif text.startswith("//", at):
                m = _TOKEN.match(text, at)
                lines += m[0].count("\n")
                at = m.end()
            elif text.startswith("/*", at):
                end = text.find("*/", at + 2)
                end = n if end < 0 else end + 2
                lines += text.count("\n", at, end)
                at = end
                out.append(" ")
            elif c == '"' and (m := _TOKEN.match(text, at)).lastgroup == "str":
                out.append(m[0])
                at = m.end()
            else:
                out.append(c)
                at += 1
        return "".join(out).strip(), at, lines

    def _preprocess(self, body: str, line: int, macros: dict, stack: list, active: bool) -> bool:
        m = re.match(r"([A-Za-z_]\w*)?\s*(.*)", body, re.S)
        word, rest = m[1] or "", m[2].strip()
        if word in ("if", "ifdef", "ifndef"):
            if not active:
                value = False
            elif word == "if":
                value = self._condition(rest, macros, line)
            else:
                value = (rest.split()[:1] or [""])[0] in macros
                value = value if word == "ifdef" else not value
            stack.append([active, value, active and value, False])
            return active and value
        if word in ("elif", "else", "endif"):
            if not stack:
                self._error(line, f"#{word} without #if")
                return active
            top = stack[-1]
            if word == "endif":
                stack.pop()
                return top[0]
            if top[3]:
                self._error(line, f"#{word} after #else")
            top[3] = word == "else"
            value = top[0] and not top[1] and (word == "else" or self._condition(rest, macros, line))
            top[1] = top[1] or value
            return value
        if not active:
            return False
        if word == "define":
            m = re.match(r"([A-Za-z_$]\w*)(\(([^)]*)\))?", rest)
            if not m:
                self._error(line, "macro names must be identifiers")
            else:
                params = None if m[2] is None else [p.strip() for p in m[3].split(",")] if m[3].strip() else []
                macros[m[1]] = params, self._plain(rest[m.end() :])
        elif word == "undef":
            macros.pop(rest.split()[0] if rest else "", None)
        elif word in ("include", "include_next", "import"):
            if not rest:
                self._error(line, "#include expects a file name")
        elif word == "" and (not body or body[0].isdigit()):
            pass
        elif word not in ("pragma", "error", "warning", "line", "ident", "sccs", "assert", "unassert"):
            self._error(line, f"invalid preprocessing directive #{(word or body)[:20]}")
        return True

    @staticmethod
    def _plain(text: str) -> list[tuple[str, str]]:
        out = []
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup if m.lastgroup != "d" else "raw"
            if kind not in ("ws", "nl", "com"):
                out.append(("str", '""') if kind == "raw" else (kind, m[0]))
        return out

    def _call(self, text: str, at: int, line: int):
        """The tokens of a macro's parenthesised arguments, read from the text."""
        out, depth = [], 0
        match = _TOKEN.match
        while at < len(text):
            m = match(text, at)
            kind, value = m.lastgroup if m.lastgroup != "d" else "raw", m[0]
            line += value.count("\n")
            at = m.end()
            if kind in ("ws", "nl", "com"):
                continue
            if depth == 0 and value != "(":
                return None, 0, 0, 0
            out.append(("str", '""') if kind == "raw" else (kind, value))
            depth += (value == "(") - (value == ")")
            if depth == 0:
                return out, 0, at, line
        return None, 0, 0, 0

    def _expand(self, tokens: list[tuple[str, str]], macros: dict, hidden: frozenset) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        i = 0
        while i < len(tokens):
            kind, value = tokens[i]
            if kind != "id" or value not in macros or value in hidden:
                out.append((kind, value))
                i += 1
                continue
            params, body = macros[value]
            i += 1
            bound: dict[str, list] = {}
            if params is not None:
                if i >= len(tokens) or tokens[i][1] != "(":
                    out.append((kind, value))
                    continue
                args, depth, current = [], 0, []
                while i < len(tokens):
                    t = tokens[i]
                    i += 1
                    depth += (t[1] in "([{" and t[0] == "p") - (t[1] in ")]}" and t[0] == "p")
                    if t[1] == "(" and depth == 1 and not args and not current:
                        continue
                    if depth == 0:
                        break
                    if t[1] == "," and depth == 1 and not (params and params[-1].endswith("...") and len(args) >= len(params) - 1):
                        args.append(current)
                        current = []
                    else:
                        current.append(t)
                args.append(current)
                names = [p[:-3].strip() or "__VA_ARGS__" if p.endswith("...") else p for p in params]
                bound = dict(zip(names, args + [[]] * len(names)))
            new: list[tuple[str, str]] = []
            j = 0
            while j < len(body):
                k, v = body[j]
                if v == "#" and j + 1 < len(body) and body[j + 1][1] in bound:
                    new.append(("str", '""'))
                    j += 2
                elif v == "##":
                    j += 1
                    if new and j < len(body):
                        right = bound.get(body[j][1], [body[j]])
                        if right:
                            a = new.pop()
                            new.extend(self._plain(a[1] + right[0][1]) or [a])
                            new.extend(right[1:])
                        j += 1
                elif v in bound and k == "id":
                    new.extend(bound[v] if j + 1 < len(body) and body[j + 1][1] == "##" else self._expand(bound[v], macros, hidden))
                    j += 1
                else:
                    new.append((k, v))
                    j += 1
            out.extend(self._expand(new, macros, hidden | {value}))
        return out

    def _condition(self, text: str, macros: dict, line: int) -> bool:
        """Value of an #if; names that are no macros are 0."""
        text = re.sub(r"defined\s*(?:\(\s*(\w+)\s*\)|(\w+))", lambda m: "1" if (m[1] or m[2]) in macros else "0", text)
        text = re.sub(r"__has_include\s*(?:<[^>]*>|\([^)]*\))", "1", text)
        tokens = self._expand(self._plain(text), macros, frozenset())
        words = []
        for k, v in tokens:
            if k == "num":
                words.append(re.sub(r"[uUlL]+$", "", v.replace("'", "")).lstrip("0") or "0" if not v.lower().startswith(("0x", "0b")) else re.sub(r"[uUlL]+$", "", v))
            elif k == "id":
                words.append({"true": "1", "and": "and", "or": "or", "not": "not"}.get(v, "0"))
            elif k == "p":
                words.append({"&&": "and", "||": "or", "!": "not ", "/": "//"}.get(v, v))
            elif k == "chr":
                words.append(str(ord(v[1]) if len(v) == 3 else 0))
        code = re.sub(r"\b0\s*\((?:[\d\s,]*)\)", "0", " ".join(words)).replace("not  =", "!=")
        if not re.fullmatch(r"[\dxXa-fA-FbB\s+\-*/%<>=!&|^~().andortn?:]*", code) or not code.strip() or "**" in code:
            if not code.strip():
                self._error(line, "#if with no expression")
            return False
        try:
            return bool(_Arithmetic(code).value())
        except (Failure, ZeroDivisionError, ValueError, OverflowError):
            self._error(line, "bad #if expression")
            return False


_DIRECTIVE = re.compile(r"^[ \t]*\#[ \t]*(?=(?:if|ifdef|ifndef|elif|else|endif|define|undef)\b)", re.M)


def conditionals(text: str, inside) -> list[tuple[list[tuple[int, int]], int]]:
    """The conditional groups of a text, inner ones before outer ones: the ranges of each one's branches, and which one is compiled,
    -1 for none. ``inside(place)`` tells whether a place is in a comment or literal."""
    reader = Lexed.__new__(Lexed)
    reader.errors = []
    macros, stack, active = dict(PREDEFINED), [], True
    open_: list[tuple[list[tuple[int, int]], list[int], int]] = []
    out = []
    for m in _DIRECTIVE.finditer(text):
        if inside(m.start()):
            continue
        body, end, _ = reader._directive(text, m.end())
        active = reader._preprocess(body, 0, macros, stack, active)
        word = re.match(r"\w+", body)[0]
        if word in ("if", "ifdef", "ifndef"):
            open_.append(([], [0] if active else [], end))
        elif word in ("elif", "else", "endif") and open_:
            branches, taken, start = open_.pop()
            branches.append((start, m.start()))
            if word == "endif":
                out.append((branches, taken[0] if taken else -1))
            else:
                if active and not taken:
                    taken.append(len(branches))
                open_.append((branches, taken, end))
    return out


class _Arithmetic:
    """Integer expressions of #if, by precedence climbing."""

    LEVELS = {"or": 1, "and": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "//": 10, "%": 10}

    def __init__(self, code: str):
        self.tokens = re.findall(r"0[xX][0-9a-fA-F]+|0[bB][01]+|\d+|and|or|not|<<|>>|<=|>=|==|!=|//|[-+*%<>&|^~()?:]", code) + [""]
        self.at = 0

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def value(self) -> int:
        out = self.ternary()
        if self.tokens[self.at]:
            raise Failure("junk")
        return out

    def ternary(self) -> int:
        test = self.binary(1)
        if self.tokens[self.at] != "?":
            return test
        self.at += 1
        a = self.ternary()
        if self.next() != ":":
            raise Failure(":")
        b = self.ternary()
        return a if test else b

    def binary(self, least: int) -> int:
        a = self.unary()
        while (level := self.LEVELS.get(self.tokens[self.at], 0)) >= least:
            op = self.next()
            b = self.binary(level + 1)
            if op in ("<<", ">>") and not 0 <= b < 64:
                raise Failure(op)
            a = {"or": lambda: int(bool(a or b)), "and": lambda: int(bool(a and b)), "|": lambda: a | b, "^": lambda: a ^ b, "&": lambda: a & b, "==": lambda: int(a == b), "!=": lambda: int(a != b), "<": lambda: int(a < b), ">": lambda: int(a > b), "<=": lambda: int(a <= b), ">=": lambda: int(a >= b), "<<": lambda: a << b, ">>": lambda: a >> b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "//": lambda: a // b if b else 0, "%": lambda: a % b if b else 0}[op]()
        return a

    def unary(self) -> int:
        t = self.next()
        if t == "(":
            out = self.ternary()
            if self.next() != ")":
                raise Failure(")")
            return out
        if t in ("-", "+", "~", "not"):
            v = self.unary()
            return {"-": -v, "+": v, "~": ~v, "not": int(not v)}[t]
        if not t or not t[0].isdigit():
            raise Failure(t)
        return int(t, 0)


class Parser:
    def __init__(self, text: str):
        lexed = Lexed(text)
        self.kinds, self.texts, self.lines = lexed.kinds, lexed.texts, lexed.lines
        self.errors: list[tuple[int, str]] = lexed.errors
        self.at = 0
        self.angle = False  # inside template arguments, where ">" closes
        self.no_arguments: set[int] = set()  # places of "<" that open no template arguments

    # --- tools

    def fail(self, wanted: str):
        raise Failure(f"expected {wanted}" + (" at end of input" if self.kinds[self.at] == "end" else f" before {self.texts[self.at][:20]!r}"))

    def take(self, text: str) -> bool:
        if self.texts[self.at] == text and self.kinds[self.at] == "p":
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail(f"'{text}'")

    def word(self, text: str) -> bool:
        if self.texts[self.at] == text and self.kinds[self.at] == "id":
            self.at += 1
            return True
        return False

    def is_name(self, at: int | None = None) -> bool:
        at = self.at if at is None else at
        return self.kinds[at] == "id" and self.texts[at] not in KEYWORDS

    def attempt(self, rule, *args):
        """The rule's result, or None and the old place."""
        start = self.at
        try:
            return rule(*args) or True
        except Failure:
            self.at = start
            return None

    def bounded(self, angle: bool, rule, *args) -> None:
        """The rule with or without ">" as an operator."""
        before, self.angle = self.angle, angle
        try:
            rule(*args)
        finally:
            self.angle = before

    def close_angle(self) -> None:
        """One closing angle bracket, also out of a longer operator."""
        t = self.texts[self.at]
        if self.kinds[self.at] != "p" or not t.startswith(">"):
            self.fail("'>'")
        if t == ">":
            self.at += 1
        else:
            for column, first in ((self.texts, t[1:]), (self.kinds, "p"), (self.lines, self.lines[self.at])):
                column[self.at : self.at + 1] = [t[0] if column is self.texts else first, first]
            self.at += 1
            self.no_arguments.clear()  # places have moved

    # --- files

    def run(self) -> list[tuple[int, str]]:
        while self.kinds[self.at] != "end":
            start = self.at
            try:
                if self.texts[self.at] == "}":
                    self.fail("declaration")
                self.declaration()
            except Failure as e:
                self.recover(e, start, False)
            except RecursionError:
                self.errors.append((self.lines[self.at], "nested too deeply"))
                break
        return self.errors

    def recover(self, error: Failure, start: int, inside: bool) -> None:
        """Panic mode: on past the next ";" or block; inside a block its closing brace is left."""
        self.errors.append((self.lines[self.at], str(error)))
        depth = 0
        if self.at == start and self.texts[self.at] == "}" and not inside:
            self.at += 1
            return
        while self.kinds[self.at] != "end":
            t = self.texts[self.at] if self.kinds[self.at] == "p" else ""
            if t == "{":
                depth += 1
            elif t == "}":
                if depth == 0 and inside:
                    return
                depth -= 1
                if depth <= 0:
                    self.at += 1
                    self.take(";")
                    return
            elif t == ";" and depth == 0:
                self.at += 1
                return
            self.at += 1

    # --- declarations

    def attributes(self) -> None:
        while True:
            t = self.texts[self.at]
            if t == "[" and self.texts[self.at + 1] == "[" and self.kinds[self.at] == "p":
                self.balanced("[", "]")
            elif t in ("alignas", "__attribute__", "__declspec") and self.kinds[self.at] == "id":
                self.at += 1
                self.balanced("(", ")")
            else:
                return

    def balanced(self, opening: str, closing: str) -> None:
        if self.texts[self.at] != opening:
            self.fail(f"'{opening}'")
        depth = 0
        while self.kinds[self.at] != "end":
            t = self.texts[self.at] if self.kinds[self.at] == "p" else ""
            depth += (t == opening) - (t == closing)
            self.at += 1
            if depth == 0:
                return
        self.fail(f"'{closing}'")

    def declaration(self, member_of: str | None = None, block: bool = False) -> None:
        if self.take(";"):
            return
        self.attributes()
        t = self.texts[self.at] if self.kinds[self.at] == "id" else ""
        if t == "namespace" or t == "inline" and self.texts[self.at + 1] == "namespace":
            return self.namespace()
        if t == "using":
            return self.using()
        if t == "template":
            return self.template(member_of)
        if t == "extern" and self.kinds[self.at + 1] == "str":
            self.at += 2
            if self.texts[self.at] == "{":
                return self.declarations(None)
            return self.declaration()
        if t == "static_assert":
            self.at += 1
            self.need("(")
            self.expressions(")")
            self.need(")")
            self.need(";")
            return
        if t == "asm" or t == "__asm__":
            self.at += 1
            self.word("volatile")
            self.balanced("(", ")")
            self.need(";")
            return
        if t in STATEMENT_ONLY:
            self.fail("unqualified-id" if member_of is None else "member")
        self.simple_declaration(member_of, block)

    def declarations(self, member_of: str | None) -> None:
        """A braced list of declarations."""
        self.need("{")
        while not self.take("}"):
            if self.kinds[self.at] == "end":
                self.fail("'}'")
            start = self.at
            try:
                if member_of is not None and self.texts[self.at] in ("public", "private", "protected") and self.kinds[self.at] == "id":
                    self.at += 1
                    if self.is_name():  # as in "public slots:"
                        self.at += 1
                    self.need(":")
                else:
                    self.declaration(member_of)
            except Failure as e:
                if self.kinds[self.at] == "end":
                    raise
                self.recover(e, start, True)

    def namespace(self) -> None:
        self.word("inline")
        self.at += 1
        self.attributes()
        if self.is_name():
            self.at += 1
            while self.take("::"):
                self.word("inline")
                self.name()
            self.attributes()
            if self.take("="):
                self.qualified()
                self.need(";")
                return
        self.declarations(None)

    def using(self) -> None:
        self.at += 1
        if self.word("namespace"):
            self.take("::")
            self.qualified()
        elif self.is_name() and self.texts[self.at + 1] in ("=", "["):
            self.at += 1
            self.attributes()
            self.need("=")
            self.type_id(True)
        else:
            while True:
                self.word("typename")
                self.qualified(True)
                self.take("...")
                if not self.take(","):
                    break
        self.need(";")

    def template(self, member_of: str | None) -> None:
        self.at += 1
        if self.take("<"):
            self.template_parameters()
            if self.texts[self.at] == "requires":
                self.fail("declaration")
        if self.texts[self.at] == "template" and self.kinds[self.at] == "id":
            return self.template(member_of)
        self.declaration(member_of)

    def template_parameters(self) -> None:
        while not (self.kinds[self.at] == "p" and self.texts[self.at].startswith(">")):
            if self.word("template"):
                self.need("<")
                self.template_parameters()
            if self.texts[self.at] in ("class", "typename") and (self.texts[self.at + 1] in (",", ">", "...", "=", ">>") or self.is_name(self.at + 1) and self.texts[self.at + 2] in (",", ">", "=", ">>")):
                self.at += 1
                self.take("...")
                if self.is_name():
                    self.at += 1
                if self.take("="):
                    if self.attempt(self.type_id, True) is None or self.texts[self.at] not in (",", ">", ">>"):
                        self.fail("type")
            else:
                self.specifiers(True)
                self.declarator(True)
                if self.take("="):
                    self.bounded(True, self.ternary)
            if not self.take(","):
                break
        self.close_angle()

    def name(self) -> str:
        if not self.is_name():
            self.fail("identifier")
        self.at += 1
        return self.texts[self.at - 1]

    def qualified(self, allow_operator: bool = False) -> None:
        """A name with its scopes and template arguments, in a place for types."""
        self.take("::")
        while True:
            self.word("template")
            if self.word("decltype"):
                self.need("(")
                self.expression()
                self.need(")")
            elif self.take("~"):
                self.name()
            elif allow_operator and self.texts[self.at] == "operator":
                self.operator_name()
            else:
                self.name()
            if self.texts[self.at] == "<" and self.kinds[self.at] == "p":
                start = self.at
                if self.attempt(self.template_arguments) is None:
                    self.at = start
                    return
            if self.texts[self.at] == "::" and self.texts[self.at + 1] != "*":
                self.at += 1
                continue
            return

    def template_arguments(self) -> None:
        """Fails at once where it failed before: in a chain of comparisons each "<" is tried once."""
        start = self.at
        if start in self.no_arguments:
            self.fail("template-argument")
        try:
            self._template_arguments()
        except Failure:
            self.no_arguments.add(start)
            raise

    def _template_arguments(self) -> None:
        self.need("<")
        if self.kinds[self.at] == "p" and self.texts[self.at].startswith(">"):
            return self.close_angle()
        while True:
            start = self.at
            if self.attempt(self.type_id, True) is not None:
                self.take("...")
                if not (self.texts[self.at] == "," or self.kinds[self.at] == "p" and self.texts[self.at].startswith(">")):
                    self.at = start
                    self.bounded(True, self.ternary)
                    self.take("...")
            else:
                self.bounded(True, self.ternary)
                self.take("...")
            if not self.take(","):
                break
        self.close_angle()

    def specifiers(self, parameter: bool = False, member_of: str | None = None, block: bool = False) -> bool:
        """Decl-specifiers; whether one of them is a type."""
        typed = False
        start = self.at
        kinds_of_type: set[str] = set()
        while True:
            self.attributes()
            kind, t = self.kinds[self.at], self.texts[self.at]
            if kind != "id":
                if t == "::" and not typed and self.is_name(self.at + 1):
                    self.qualified()
                    typed = True
                    continue
                return typed
            if t in SPECIFIERS or t == "typedef":
                self.at += 1
                if t == "explicit" and self.texts[self.at] == "(":
                    self.balanced("(", ")")
            elif t in BUILTIN:
                if typed and t in ("auto", "void"):
                    return typed
                if t in kinds_of_type and t != "long":
                    self.fail("unqualified-id")
                kinds_of_type.add(t)
                self.at += 1
                typed = True
            elif t == "decltype" and not typed:
                self.qualified()
                typed = True
            elif t == "typename":
                self.at += 1
                self.qualified()
                typed = True
            elif t in ("class", "struct", "union"):
                if typed:
                    self.fail("unqualified-id")
                self.class_specifier(parameter)
                typed = True
            elif t == "enum":
                if typed:
                    self.fail("unqualified-id")
                self.enum_specifier()
                typed = True
            elif t in KEYWORDS:
                return typed
            elif typed:
                return typed
            else:
                # A name: the type, unless it is what is declared (constructors and the like).
                after = self.texts[self.at + 1]
                if after == "(" and self.kinds[self.at + 1] == "p" and (member_of is not None and t == member_of) and not block:
                    return typed
                back = self.at
                self.qualified()
                if self.texts[self.at] == "(" and member_of is None and not block and not parameter and "::" in self.texts[back : self.at]:
                    # A::A(...) outside its class
                    self.at = back
                    return typed
                if self.texts[self.at - 1] == "operator":
                    self.at = back
                    return typed
                typed = True
        return typed and self.at > start

    def class_specifier(self, parameter: bool) -> None:
        self.at += 1
        self.attributes()
        name = ""
        if self.is_name() or self.texts[self.at] == "::":
            self.qualified()
            name = self.texts[self.at - 1] if self.is_name(self.at - 1) else ""
            if not name:
                at = self.at - 1
                depth = 0
                while at > 0:
                    depth += self.texts[at].count(">") - (self.texts[at] == "<")
                    if depth == 0:
                        break
                    at -= 1
                name = self.texts[at - 1]
            if self.is_name() and self.texts[self.at + 1] in ("{", ":") and self.texts[self.at] != "final":
                name = self.name()  # a macro before the name
            if self.texts[self.at] == "final" and self.texts[self.at + 1] in ("{", ":"):
                self.at += 1
        if self.texts[self.at] == ":" and not parameter and self.kinds[self.at] == "p":
            self.at += 1
            while True:
                self.attributes()
                while self.texts[self.at] in ("public", "private", "protected", "virtual"):
                    self.at += 1
                self.qualified()
                self.take("...")
                if not self.take(","):
                    break
            if self.texts[self.at] != "{":
                self.fail("'{'")
        if self.texts[self.at] == "{" and self.kinds[self.at] == "p":
            self.declarations(name)
        elif not name:
            self.fail("'{'")

    def enum_specifier(self) -> None:
        self.at += 1
        if not self.word("class"):
            self.word("struct")
        self.attributes()
        named = self.is_name()
        if named:
            self.qualified()
        if self.texts[self.at] == ":" and self.texts[self.at + 1] != ":":
            self.at += 1
            self.type_id()
        if self.take("{"):
            while not self.take("}"):
                self.name()
                self.attributes()
                if self.take("="):
                    self.ternary()
                if not self.take(","):
                    self.need("}")
                    break
        elif not named:
            self.fail("'{'")

    def type_id(self, abstract_functions: bool = False) -> None:
        if not self.specifiers(True):
            self.fail("type-specifier")
        self.declarator(True, abstract_only=True)

    def declarator(self, abstract: bool = False, abstract_only: bool = False, call: bool = True) -> bool:
        """A declarator; whether it ends in a parameter list."""
        self.pointers()
        function = False
        self.take("...")
        self.attributes()
        t = self.texts[self.at]
        if t == "(" and self.kinds[self.at] == "p" and (self.texts[self.at + 1] in ("*", "&", "&&", "(", "^") or self.is_name(self.at + 1) and (self.texts[self.at + 2] in (")", "[") or self.texts[self.at + 2] == "::") and not abstract_only):
            start = self.at
            self.at += 1
            if self.attempt(self.declarator, True) is None or not self.take(")"):
                self.at = start
                if not abstract:
                    self.fail("declarator")
        elif self.kinds[self.at] == "id" and not abstract_only and (self.is_name() or t == "operator"):
            self.declared_name()
        elif t in ("~", "::") and not abstract_only and self.kinds[self.at] == "p":
            self.declared_name()
        elif not abstract:
            self.fail("unqualified-id")
        self.attributes()
        while self.kinds[self.at] == "p":
            if self.texts[self.at] == "(" and call:
                start = self.at
                if self.attempt(self.parameters) is None:
                    self.at = start
                    return function
                function = True
            elif self.texts[self.at] == "[" and self.texts[self.at + 1] != "[":
                self.at += 1
                if not self.take("]"):
                    self.expression()
                    self.need("]")
            else:
                break
            self.attributes()
        return function

    def pointers(self) -> None:
        while True:
            if self.kinds[self.at] == "p" and self.texts[self.at] in ("*", "&", "&&"):
                self.at += 1
            elif self.texts[self.at] in ("const", "volatile", "__restrict", "__restrict__", "restrict") and self.kinds[self.at] == "id":
                self.at += 1
            elif (self.is_name() or self.texts[self.at] == "::") and (self.texts[self.at + 1] == "::" and self.texts[self.at + 2] == "*"):
                self.at += 3
            else:
                return

    def declared_name(self) -> None:
        self.take("::")
        while True:
            if self.texts[self.at] == "operator" and self.kinds[self.at] == "id":
                return self.operator_name()
            if self.take("~"):
                self.name()
                if self.texts[self.at] == "<":
                    self.attempt(self.template_arguments)
                return
            self.name()
            if self.texts[self.at] == "<" and self.kinds[self.at] == "p":
                self.attempt(self.template_arguments)
            if not self.take("::"):
                return

    def operator_name(self) -> None:
        self.at += 1
        t = self.texts[self.at]
        if self.kinds[self.at] == "p":
            if t in ("(", "["):
                self.at += 1
                self.need(")" if t == "(" else "]")
            elif t in ("{", "}", ";", ")", "]", ":", "::", "?", ".", "#"):
                self.fail("operator")
            else:
                self.at += 1
                if t == ">" and self.texts[self.at] in (">", ">=") and self.lines[self.at] == self.lines[self.at - 1]:
                    self.at += 1
        elif t in ("new", "delete"):
            self.at += 1
            if self.take("["):
                self.need("]")
        elif self.kinds[self.at] == "str":
            self.at += 1
            if self.is_name():
                self.at += 1
        else:
            if not self.specifiers(True):
                self.fail("operator")
            self.pointers()

    def parameters(self) -> None:
        """A parameter list and what may follow it."""
        self.need("(")
        while not self.take(")"):
            if self.take("..."):
                self.need(")")
                break
            if not self.specifiers(True):
                self.fail("type")
            self.declarator(True)
            self.take("...")
            if self.take("="):
                self.initializer()
            if self.texts[self.at] == "...":
                continue
            if not self.take(","):
                self.need(")")
                break
            elif self.texts[self.at] == ")":
                self.fail("parameter")
        self.function_suffix()

    def function_suffix(self) -> None:
        while True:
            t = self.texts[self.at]
            if self.kinds[self.at] == "id" and t in ("const", "volatile", "override", "final", "mutable", "constexpr"):
                self.at += 1
            elif self.kinds[self.at] == "id" and t in ("noexcept", "throw"):
                self.at += 1
                if self.texts[self.at] == "(":
                    self.balanced("(", ")")
            elif self.kinds[self.at] == "p" and t in ("&", "&&"):
                self.at += 1
            elif self.kinds[self.at] == "p" and t == "->":
                self.at += 1
                self.type_id()
            elif t == "[" and self.texts[self.at + 1] == "[" or t == "__attribute__":
                self.attributes()
            else:
                return

    def initializer(self) -> None:
        if self.texts[self.at] == "{" and self.kinds[self.at] == "p":
            self.braced()
        else:
            self.assignment()

    def braced(self) -> None:
        self.bounded(False, self._braced)

    def _braced(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.texts[self.at] == "." and self.is_name(self.at + 1):
                self.at += 2
                if self.texts[self.at] == "{":
                    self.braced()
                else:
                    self.need("=")
                    self.initializer()
            else:
                if self.texts[self.at] == "[" and self.attempt(self._index_designator) is not None:
                    pass
                else:
                    self.initializer()
            self.take("...")
            if not self.take(","):
                self.need("}")
                return

    def _index_designator(self) -> None:
        self.need("[")
        self.ternary()
        self.need("]")
        self.need("=")
        self.initializer()

    def simple_declaration(self, member_of: str | None, block: bool) -> None:
        typed = self.specifiers(False, member_of, block)
        if self.take(";"):
            if not typed:
                self.fail("declaration")
            return
        if typed and self.texts[self.at] == "[" and self.kinds[self.at] == "p" or typed and self.texts[self.at] in ("&", "&&") and self.texts[self.at + 1] == "[":
            return self.binding()
        first = True
        while True:
            if not typed and first:
                self.untyped_declarator(member_of, block)
                function = True
            elif self.texts[self.at] == ":" and member_of is not None:
                function = False  # a bit-field without a name
            else:
                function = self.declarator()
            if function and self.texts[self.at] in ("{", ":", "try") and first:
                return self.function_body()
            if self.take("="):
                if function and (self.word("default") or self.word("delete") or self.texts[self.at] == "0"):
                    if self.texts[self.at] == "0" and self.kinds[self.at] == "num":
                        self.at += 1
                else:
                    self.initializer()
            elif self.texts[self.at] == "(" and self.kinds[self.at] == "p" and not function:
                self.at += 1
                self.expressions(")")
                self.need(")")
            elif self.texts[self.at] == "{" and not function:
                self.braced()
            elif self.texts[self.at] == ":" and member_of is not None:
                self.at += 1
                self.ternary()
                if self.texts[self.at] in ("=", "{"):
                    self.take("=")
                    self.initializer()
            first = False
            if not self.take(","):
                break
        self.need(";")

    def untyped_declarator(self, member_of: str | None, block: bool) -> None:
        """Constructors, destructors, conversions: declarators without a type."""
        if block:
            self.fail("type-specifier")
        start = self.at
        self.declared_name()
        if self.texts[self.at] != "(":
            self.fail("'(' of a constructor" if self.at > start else "unqualified-id")
        if member_of is None and "::" not in self.texts[start : self.at] and "operator" not in self.texts[start : self.at]:
            self.at = start
            self.fail("type-specifier")
        self.parameters()

    def binding(self) -> None:
        self.pointers()
        self.need("[")
        while True:
            self.name()
            if not self.take(","):
                break
        self.need("]")
        if self.take("="):
            self.initializer()
        elif self.texts[self.at] == "{":
            self.braced()
        else:
            self.need("(")
            self.expression()
            self.need(")")
        self.need(";")

    def function_body(self) -> None:
        tried = self.word("try")
        if self.take(":"):
            while True:
                self.qualified()
                if self.take("("):
                    self.expressions(")")
                    self.need(")")
                else:
                    self.braced()
                self.take("...")
                if not self.take(","):
                    break
        self.compound()
        if tried:
            self.handlers()

    # --- statements

    def compound(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.kinds[self.at] == "end":
                self.fail("'}'")
            start = self.at
            try:
                self.statement()
            except Failure as e:
                if self.kinds[self.at] == "end":
                    raise
                self.recover(e, start, True)

    def handlers(self) -> None:
        if self.texts[self.at] != "catch":
            self.fail("'catch'")
        while self.word("catch"):
            self.need("(")
            if not self.take("..."):
                if not self.specifiers(True):
                    self.fail("type")
                self.declarator(True)
            self.need(")")
            self.compound()

    def statement(self) -> None:
        self.attributes()
        kind, t = self.kinds[self.at], self.texts[self.at]
        if kind == "p":
            if t == "{":
                return self.compound()
            if t == ";":
                self.at += 1
                return
        elif kind == "id":
            rule = getattr(self, f"do_{t}", None) if t in STATEMENT_ONLY else None
            if rule:
                self.at += 1
                return rule()
            if t not in KEYWORDS and self.texts[self.at + 1] == ":" and self.kinds[self.at + 1] == "p":
                self.at += 2
                if self.texts[self.at] == "}":
                    self.fail("statement")
                return self.statement()
        self.declaration_or_expression()
        # what stands before ";" was complete

    def declaration_or_expression(self) -> None:
        kind, t = self.kinds[self.at], self.texts[self.at]
        if kind == "id" and (t in ("using", "namespace", "static_assert", "asm", "template", "typedef", "extern") or t in SPECIFIERS or t in ("class", "struct", "union", "enum")):
            return self.declaration(None, True)
        if kind == "id" and t not in KEYWORDS and self.texts[self.at + 1] in ONLY_EXPRESSIONS and self.kinds[self.at + 1] == "p":
            self.expression()
            self.need(";")
            return
        if kind == "id" and t not in KEYWORDS or t in BUILTIN or t in ("typename", "decltype") or t == "::":
            start, errors = self.at, len(self.errors)
            try:
                self.simple_declaration(None, True)
                return
            except Failure as e:
                first, reached = e, self.at
            self.at = start
            del self.errors[errors:]
            try:
                self.expression()
                self.need(";")
            except Failure:
                if self.at < reached:
                    self.at = reached
                    raise first from None
                raise
            return
        self.expression()
        self.need(";")

    def condition(self) -> None:
        """An expression, or the declaration of one variable."""
        start = self.at
        if self.specifiers_then_name():
            if self.take("="):
                self.initializer()
                return
            if self.texts[self.at] == "{":
                self.braced()
                return
        self.at = start
        self.expression()

    def specifiers_then_name(self) -> bool:
        try:
            return self.specifiers(True) and (self.pointers() or True) and self.kinds[self.at] == "id" and bool(self.name())
        except Failure:
            return False

    def head(self) -> None:
        """The parenthesis of if and switch, with an optional first statement."""
        self.need("(")
        start = self.at
        if self.texts[self.at] == ";" or self.attempt(self._first_statement) is None:
            self.at = start
            self.take(";")
        self.condition()
        self.need(")")

    def _first_statement(self) -> None:
        errors = len(self.errors)
        try:
            self.declaration_or_expression()
        except Failure:
            del self.errors[errors:]
            raise

    def do_if(self) -> None:
        self.word("constexpr")
        self.head()
        self.statement()
        if self.word("else"):
            self.statement()

    def do_else(self) -> None:
        self.at -= 1
        self.fail("statement: 'else' without 'if'")

    def do_switch(self) -> None:
        self.head()
        self.statement()

    def do_while(self) -> None:
        self.need("(")
        self.condition()
        self.need(")")
        self.statement()

    def do_do(self) -> None:
        self.statement()
        if not self.word("while"):
            self.fail("'while'")
        self.need("(")
        self.expression()
        self.need(")")
        self.need(";")

    def do_for(self) -> None:
        self.need("(")
        start = self.at
        if self.attempt(self._range) is None:
            self.at = start
            if not self.take(";"):
                self.declaration_or_expression()
            if not self.take(";"):
                self.condition()
                self.need(";")
            if self.texts[self.at] != ")":
                self.expression()
            self.need(")")
        self.statement()

    def _range(self) -> None:
        if not self.specifiers(True):
            self.fail("type")
        self.pointers()
        if self.take("["):
            while True:
                self.name()
                if not self.take(","):
                    break
            self.need("]")
        else:
            self.name()
        self.need(":")
        self.initializer()
        self.need(")")

    def do_return(self) -> None:
        if not self.take(";"):
            if self.texts[self.at] == "{":
                self.braced()
            else:
                self.expression()
            self.need(";")

    def do_break(self) -> None:
        self.need(";")

    do_continue = do_break

    def do_goto(self) -> None:
        if not self.take("*"):
            self.name()
        else:
            self.expression()
        self.need(";")

    def do_case(self) -> None:
        self.ternary()
        if self.take("..."):
            self.ternary()
        self.need(":")
        if self.texts[self.at] == "}":
            return
        self.statement()

    def do_default(self) -> None:
        self.need(":")
        if self.texts[self.at] == "}":
            return
        self.statement()

    def do_try(self) -> None:
        self.compound()
        self.handlers()

    def do_catch(self) -> None:
        self.at -= 1
        self.fail("statement")

    # --- expressions

    def expressions(self, closing: str) -> None:
        if self.texts[self.at] == closing and self.kinds[self.at] == "p":
            return
        while True:
            self.initializer()
            self.take("...")
            if not self.take(","):
                return

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            if self.take("..."):  # a fold over commas
                return
            self.assignment()

    def assignment(self) -> None:
        if self.kinds[self.at] == "id" and self.texts[self.at] == "throw":
            self.at += 1
            if self.texts[self.at] not in (";", ")", ",", ":") or self.kinds[self.at] != "p":
                self.assignment()
            return
        self.ternary()
        if self.kinds[self.at] == "p" and self.texts[self.at] in ASSIGNMENTS:
            self.at += 1
            self.initializer()

    def ternary(self) -> None:
        self.binary(1)
        if self.take("?"):
            if self.texts[self.at] != ":":
                self.expression()
            self.need(":")
            self.assignment()

    def binary(self, least: int) -> None:
        """Precedence climbing."""
        self.unary()
        while self.kinds[self.at] == "p":
            op = self.texts[self.at]
            level = PRECEDENCE.get(op, 0)
            if level < least or level == 0 or self.angle and op in (">", ">>", ">="):
                return
            self.at += 1
            if self.texts[self.at] == "..." and self.kinds[self.at] == "p":
                self.at += 1  # a fold expression
                if self.texts[self.at] == op:
                    self.at += 1
                else:
                    return
            self.binary(level + 1)

    def unary(self) -> None:
        kind, t = self.kinds[self.at], self.texts[self.at]
        if kind == "p":
            if t in ("+", "-", "!", "~", "*", "&", "++", "--"):
                self.at += 1
                return self.unary()
            if t == "&&" and self.is_name(self.at + 1):  # the address of a label
                self.at += 2
                return
            if t == "(" and self.attempt(self.cast) is not None:
                return
            if t == "..." :
                self.at += 1
                if self.kinds[self.at] == "p" and self.texts[self.at] in PRECEDENCE or self.texts[self.at] == ",":
                    self.at += 1
                    return self.unary()
                self.fail("operator")
            if t == "::" and self.texts[self.at + 1] in ("new", "delete"):
                self.at += 1
                return self.unary()
        elif kind == "id":
            if t in ("sizeof", "alignof", "__alignof__", "noexcept"):
                self.at += 1
                if self.take("..."):
                    self.need("(")
                    self.name()
                    self.need(")")
                    return
                if self.texts[self.at] == "(" and self.attempt(self._parenthesised_type) is not None:
                    return
                return self.unary()
            if t == "new":
                return self.new()
            if t == "delete":
                self.at += 1
                if self.take("["):
                    self.need("]")
                return self.unary()
        self.postfix()

    def _parenthesised_type(self) -> None:
        self.need("(")
        self.type_id()
        self.need(")")

    def cast(self) -> None:
        """(type) operand; a name in parentheses is a type if an operand follows that no operator joins."""
        self.need("(")
        start = self.at
        self.type_id()
        plain = all(self.kinds[i] == "id" and self.texts[i] not in BUILTIN and self.texts[i] not in SPECIFIERS or self.texts[i] == "::" for i in range(start, self.at))
        self.need(")")
        kind, t = self.kinds[self.at], self.texts[self.at]
        if kind == "p":
            if t == "{":
                self.braced()
                return self.postfix_tail()
            if t not in ("(", "~", "!", "[", "::") and (plain or t not in ("+", "-", "*", "&", "++", "--")):
                self.fail("operand")
            if plain and t in ("(", "["):
                self.fail("operand")  # reads as a call or an index, too
        elif kind == "end" or kind == "id" and t in KEYWORDS and t not in ("this", "true", "false", "nullptr", "new", "sizeof", "not", "static_cast", "const_cast", "reinterpret_cast", "dynamic_cast", "typeid", "delete", "alignof", "noexcept") and t not in BUILTIN:
            self.fail("operand")
        self.unary()

    def new(self) -> None:
        self.at += 1
        if self.texts[self.at] == "(":
            start = self.at
            if self.attempt(self._parenthesised_type) is not None and self.texts[self.at] in (";", ",", ")", "(", "{", "["):
                pass
            else:
                self.at = start + 1
                self.expressions(")")
                self.need(")")
                self._new_type()
        else:
            self._new_type()
        if self.take("("):
            self.expressions(")")
            self.need(")")
        elif self.texts[self.at] == "{":
            self.braced()
        self.postfix_tail()

    def _new_type(self) -> None:
        if self.texts[self.at] == "(":
            return self._parenthesised_type()
        if not self.specifiers(True):
            self.fail("type-specifier")
        while self.kinds[self.at] == "p" and self.texts[self.at] in ("*", "&"):
            self.at += 1
        while self.take("["):
            if not self.take("]"):
                self.expression()
                self.need("]")

    def postfix(self) -> None:
        self.primary()
        self.postfix_tail()

    def postfix_tail(self) -> None:
        while self.kinds[self.at] == "p":
            t = self.texts[self.at]
            if t == "(":
                self.at += 1
                self.bounded(False, self.expressions, ")")
                self.need(")")
            elif t == "[":
                self.at += 1
                self.bounded(False, self.braced if self.texts[self.at] == "{" else self.expression)
                self.need("]")
            elif t in (".", "->"):
                self.at += 1
                self.word("template")
                if self.texts[self.at] == "operator":
                    self.operator_name()
                elif self.take("~"):
                    self.name()
                else:
                    self.scoped_name()
            elif t in ("++", "--"):
                self.at += 1
            else:
                return

    def scoped_name(self) -> None:
        """A name in an expression; angle brackets are template arguments if what follows cannot be compared."""
        self.take("::")
        while True:
            self.word("template")
            if self.texts[self.at] == "operator" and self.kinds[self.at] == "id":
                return self.operator_name()
            if self.take("~"):
                self.name()
                return
            self.name()
            if self.texts[self.at] == "<" and self.kinds[self.at] == "p":
                start = self.at
                if self.attempt(self.template_arguments) is None or not (self.kinds[self.at] == "p" and self.texts[self.at] in ("(", "::", "{", ")", ",", ";", "}", "]", "...", ".")):
                    self.at = start
                    self.no_arguments.add(start)
                    return
            if not self.take("::"):
                return

    def primary(self) -> None:
        kind, t = self.kinds[self.at], self.texts[self.at]
        if kind in ("num", "chr"):
            self.at += 1
        elif kind == "str":
            while self.kinds[self.at] == "str":
                self.at += 1
        elif kind == "p":
            if t == "(":
                self.at += 1
                self.bounded(False, self.compound if self.texts[self.at] == "{" else self.expression)
                self.take("...")
                self.need(")")
            elif t == "[":
                self.bounded(False, self.lambda_)
            elif t in ("::", "~"):
                self.scoped_name()
                self.maybe_braced()
            elif t == "{":
                self.braced()
            else:
                self.fail("primary-expression")
        elif kind == "id":
            if t in ("this", "true", "false", "nullptr"):
                self.at += 1
            elif t in CASTS:
                self.at += 1
                self.need("<")
                self.type_id()
                self.close_angle()
                self.need("(")
                self.expression()
                self.need(")")
            elif t == "typeid":
                self.at += 1
                self.need("(")
                if self.attempt(self.type_id) is None or self.texts[self.at] != ")":
                    self.expression()
                self.need(")")
            elif t in BUILTIN or t in ("typename", "decltype"):
                if not self.specifiers(True):
                    self.fail("type")
                if self.texts[self.at] == "(":
                    self.at += 1
                    self.expressions(")")
                    self.need(")")
                elif self.texts[self.at] == "{":
                    self.braced()
                elif t != "decltype":
                    self.fail("primary-expression")
            elif t == "operator":
                self.operator_name()
            elif t in KEYWORDS:
                self.fail("primary-expression")
            else:
                self.scoped_name()
                self.maybe_braced()
        else:
            self.fail("primary-expression")

    def maybe_braced(self) -> None:
        """T{...}: not where the brace opens a block, as after a condition, since a name there is followed by ")"."""
        if self.texts[self.at] == "{" and self.kinds[self.at] == "p":
            self.braced()

    def lambda_(self) -> None:
        self.need("[")
        while not self.take("]"):
            if self.texts[self.at] in ("=", "&", "*", "...") and self.kinds[self.at] == "p":
                self.at += 1
                continue
            if self.word("this") or self.is_name():
                if self.is_name():
                    self.at += 1
                if self.take("="):
                    self.assignment()
                elif self.texts[self.at] in ("(", "{"):
                    if self.take("("):
                        self.expressions(")")
                        self.need(")")
                    else:
                        self.braced()
                self.take("...")
            elif not self.take(","):
                self.fail("capture")
        if self.texts[self.at] == "(":
            self.parameters()
        else:
            self.function_suffix()
        self.compound()


def parse_errors(text: str) -> list[tuple[int, str]]:
    """(line, message) of every error, in the order in which they were met."""
    parser = Parser(text)
    return parser.run()
