"""A Python 3.11 parser that only decides whether text can be parsed: tokens with indentation, recursive descent
over statements, precedence climbing over expressions, panic-mode recovery."""

from __future__ import annotations

import re

_STRING_OPEN = re.compile(r"(?i)(?P<prefix>r|u|b|f|br|rb|fr|rf)?(?P<q>'''|\"\"\"|'|\")")
_NUMBER = re.compile(r"(?i)0x(?:_?[0-9a-f])+|0b(?:_?[01])+|0o(?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:e[+-]?\d(?:_?\d)*)?j?|\d(?:_?\d)*e[+-]?\d(?:_?\d)*j?|\d(?:_?\d)*j?")
_NAME = re.compile(r"[^\W\d]\w*")
_OPERATOR = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|<=|>=|==|!=|[-+*/%&|^@]=|[-+*/%&|^~@<>=:;,.(){}\[\]]")
_BLANK = re.compile(r"[ \f\t]*")

#: The words of the language.
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
#: Precedence of the binary operators below comparisons.
PRECEDENCE = {op: level for level, ops in enumerate((("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "//", "%", "@")), 1) for op in ops}
CLOSING = {"(": ")", "[": "]", "{": "}"}


class Failure(Exception):
    def __init__(self, what: str, line: int | None = None):
        super().__init__(what)
        self.line = line


class Tokens:
    """kind (name, num, str, op, nl, in, out, end), text and line of each token."""

    def __init__(self, text: str):
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.lines: list[int] = []
        self.errors: list[tuple[int, str]] = []
        self._run(text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))

    def _put(self, kind: str, text: str, line: int) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.lines.append(line)

    def _run(self, text: str) -> None:
        if "\0" in text:
            self.errors.append((1, "source code cannot contain null bytes"))
        at, line, n = 0, 1, len(text)
        indents: list[tuple[int, int]] = [(0, 0)]
        open_: list[tuple[str, int]] = []
        fresh = True
        while at < n:
            if fresh and not open_:
                m = _BLANK.match(text, at)
                blank = m[0].rpartition("\f")[2]
                at = m.end()
                c = text[at : at + 1]
                if c in ("\n", "#", ""):
                    end = text.find("\n", at)
                    if end < 0:
                        break
                    at = end + 1
                    line += 1
                    continue
                if c == "\\" and text[at + 1 : at + 2] == "\n":
                    at += 2
                    line += 1
                    fresh = False
                    continue
                wide = len(blank.expandtabs(8))
                narrow = len(blank.expandtabs(1))
                fresh = False
                if wide > indents[-1][0]:
                    if narrow <= indents[-1][1]:
                        self.errors.append((line, "inconsistent use of tabs and spaces in indentation"))
                    indents.append((wide, narrow))
                    self._put("in", "", line)
                else:
                    while wide < indents[-1][0]:
                        indents.pop()
                        self._put("out", "", line)
                    if wide != indents[-1][0]:
                        self.errors.append((line, "unindent does not match any outer indentation level"))
                        indents[-1] = (wide, narrow) if len(indents) > 1 else indents[-1]
                    elif narrow != indents[-1][1]:
                        self.errors.append((line, "inconsistent use of tabs and spaces in indentation"))
            c = text[at]
            if c == "\n":
                if not open_:
                    self._put("nl", "", line)
                    fresh = True
                line += 1
                at += 1
            elif c in " \t\f":
                at += 1
            elif c == "#":
                end = text.find("\n", at)
                at = n if end < 0 else end
            elif c == "\\":
                if text[at + 1 : at + 2] == "\n":
                    at += 2
                    line += 1
                    if at >= n:
                        self.errors.append((line, "unexpected end of file after line continuation"))
                else:
                    self.errors.append((line, "unexpected character after line continuation character"))
                    at += 1
            elif m := _STRING_OPEN.match(text, at):
                at, line = self._string(text, m, line)
            elif c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
                at = self._number(text, at, line)
            elif m := _NAME.match(text, at):
                self._put("name", m[0], line)
                at = m.end()
            elif text.startswith("!=", at):
                self._put("op", "!=", line)
                at += 2
            elif m := _OPERATOR.match(text, at):
                t = m[0]
                at = m.end()
                if t in CLOSING:
                    open_.append((t, line))
                elif t in ")]}":
                    if not open_:
                        self.errors.append((line, f"unmatched {t!r}"))
                        continue
                    if CLOSING[open_[-1][0]] != t:
                        self.errors.append((line, f"closing parenthesis {t!r} does not match opening parenthesis {open_[-1][0]!r}"))
                    open_.pop()
                self._put("op", t, line)
            else:
                self.errors.append((line, f"invalid character {c!r}"))
                at += 1
        if open_:
            self.errors.append((open_[-1][1], f"{open_[-1][0]!r} was never closed"))
        if self.kinds and self.kinds[-1] not in ("nl",):
            self._put("nl", "", line)
        for _ in indents[1:]:
            self._put("out", "", line)
        self._put("end", "", line)

    def _number(self, text: str, at: int, line: int) -> int:
        m = _NUMBER.match(text, at)
        t, end = m[0], m.end()
        if re.fullmatch(r"0[\d_]*[1-9][\d_]*", t):
            self.errors.append((line, "leading zeros in decimal integer literals are not permitted"))
        after = _NAME.match(text, end)
        # A keyword may follow a number without a blank.
        if text[end : end + 1] == "_" or after and not re.match(r"(?:and|else|for|if|in|is|not|or)\b", text[end:]):
            self.errors.append((line, "invalid decimal literal"))
            end = after.end() if after else end + 1
        elif text[end : end + 1].isdigit():
            self.errors.append((line, "invalid digit"))
            end += 1
        self._put("num", t, line)
        return end

    def _string(self, text: str, m: re.Match, line: int) -> tuple[int, int]:
        quote, at, n = m["q"], m.end(), len(text)
        start_line = line
        while True:
            if at >= n:
                self.errors.append((start_line, "unterminated triple-quoted string literal" if len(quote) == 3 else "unterminated string literal"))
                break
            c = text[at]
            if c == "\\":
                line += text[at + 1 : at + 2] == "\n"
                at += 2
            elif c == "\n" and len(quote) == 1:
                self.errors.append((start_line, "unterminated string literal"))
                break
            elif text.startswith(quote, at):
                body = text[m.end() : at]
                at += len(quote)
                prefix = (m["prefix"] or "").lower()
                if "b" in prefix and not body.isascii():
                    self.errors.append((start_line, "bytes can only contain ASCII literal characters"))
                if "f" in prefix:
                    self._format(body, "r" in prefix, quote, start_line)
                elif "b" not in prefix and "r" not in prefix and "\\" in body:
                    self._escapes(body, start_line)
                self._put("str", "b" if "b" in prefix else "s", start_line)
                return at, line
            else:
                line += c == "\n"
                at += 1
        self._put("str", "s", start_line)
        return at, line

    def _escapes(self, body: str, line: int) -> None:
        for m in re.finditer(r"\\(?:(x)([0-9a-fA-F]{2})?|(u)([0-9a-fA-F]{4})?|(U)([0-9a-fA-F]{8})?|(N)(\{[^}]+\})?|[^xuUN])", body, re.S):
            if m[1] and not m[2] or m[3] and not m[4] or m[5] and not m[6] or m[7] and not m[8]:
                self.errors.append((line, "(unicode error) truncated escape"))

    def _format(self, body: str, raw: bool, quote: str, line: int, depth: int = 0) -> None:
        """The replacement fields of an f-string, by the rules before 3.12."""
        at, n = 0, len(body)
        while at < n:
            c = body[at]
            if c == "\\" and not raw:
                at += 2
                if body[at - 1 : at] == "N" and body[at : at + 1] == "{":
                    at = body.find("}", at) + 1 or n
            elif c == "{":
                if body[at + 1 : at + 2] == "{" and depth == 0:
                    at += 2
                    continue
                at = self._field(body, at + 1, raw, quote, line, depth)
                if at < 0:
                    return
            elif c == "}":
                if body[at + 1 : at + 2] == "}" and depth == 0:
                    at += 2
                    continue
                self.errors.append((line, "f-string: single '}' is not allowed"))
                return
            else:
                at += 1

    def _field(self, body: str, at: int, raw: bool, quote: str, line: int, depth: int) -> int:
        start, n, stack = at, len(body), []
        inner = ""
        while at < n:
            c = body[at]
            if inner:
                if c == "\\":
                    self.errors.append((line, "f-string expression part cannot include a backslash"))
                    return -1
                if body.startswith(inner, at):
                    at += len(inner)
                    inner = ""
                else:
                    at += 1
                continue
            if c == "\\":
                self.errors.append((line, "f-string expression part cannot include a backslash"))
                return -1
            if c == "#":
                self.errors.append((line, "f-string expression part cannot include '#'"))
                return -1
            if c in "'\"":
                inner = c * 3 if body.startswith(c * 3, at) else c
                at += len(inner)
                continue
            if c in "([{":
                stack.append(c)
            elif c in ")]}" and stack:
                if CLOSING[stack.pop()] != c:
                    self.errors.append((line, "f-string: closing parenthesis does not match"))
                    return -1
            elif not stack and (c == "}" or c == ":" or c == "!" and body[at + 1 : at + 2] != "=" or c == "=" and body[at + 1 : at + 2] != "=" and body[at - 1 : at] not in ("=", "!", "<", ">")):
                break
            at += 1
        if at >= n or inner:
            self.errors.append((line, "f-string: expecting '}'"))
            return -1
        code = body[start:at]
        if not code.strip():
            self.errors.append((line, "f-string: empty expression not allowed"))
            return -1
        if any(parse_errors("(" + code + ")")):
            self.errors.append((line, "f-string: invalid syntax"))
            return -1
        if body[at] == "=":
            at += 1
            while body[at : at + 1].isspace():
                at += 1
        if body[at : at + 1] == "!":
            if body[at + 1 : at + 2] not in ("s", "r", "a") or body[at + 2 : at + 3] not in ("}", ":"):
                self.errors.append((line, "f-string: invalid conversion character"))
                return -1
            at += 2
        if body[at : at + 1] == ":":
            end, level = at + 1, 0
            while end < n and (body[end] != "}" or level):
                level += (body[end] == "{") - (body[end] == "}")
                end += 1
            if end >= n or depth >= 2:
                self.errors.append((line, "f-string: expecting '}'" if end >= n else "f-string: expressions nested too deeply"))
                return -1
            self._format(body[at + 1 : end], raw, quote, line, depth + 1)
            at = end
        if body[at : at + 1] != "}":
            self.errors.append((line, "f-string: expecting '}'"))
            return -1
        return at + 1


class Parser:
    """Expressions answer what they are, for the rules on targets: name, attribute, index, tuple, list, star, paren, call, other."""

    def __init__(self, text: str):
        tokens = Tokens(text)
        self.kinds, self.texts, self.lines, self.errors = tokens.kinds, tokens.texts, tokens.lines, tokens.errors
        self.at = 0

    def fail(self, what: str = "invalid syntax"):
        raise Failure(what)

    def op(self, text: str) -> bool:
        if self.texts[self.at] == text and self.kinds[self.at] == "op":
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail(f"expected {text!r}")

    def word(self, text: str) -> bool:
        if self.texts[self.at] == text and self.kinds[self.at] == "name":
            self.at += 1
            return True
        return False

    def is_op(self, *texts: str) -> bool:
        return self.kinds[self.at] == "op" and self.texts[self.at] in texts

    def is_word(self, *texts: str) -> bool:
        return self.kinds[self.at] == "name" and self.texts[self.at] in texts

    def name(self) -> str:
        if self.kinds[self.at] != "name" or self.texts[self.at] in KEYWORDS:
            self.fail()
        self.at += 1
        return self.texts[self.at - 1]

    # --- statements

    def run(self) -> list[tuple[int, str]]:
        while self.kinds[self.at] != "end":
            try:
                if self.kinds[self.at] in ("in", "out"):
                    self.at += 1
                    if self.kinds[self.at - 1] == "in":
                        self.errors.append((self.lines[self.at], "unexpected indent"))
                    continue
                self.statement()
            except Failure as e:
                self.recover(e)
            except RecursionError:
                self.errors.append((self.lines[self.at], "nested too deeply"))
                break
        return sorted(self.errors, key=lambda e: e[0]) if self.errors else self.errors

    def recover(self, error: Failure) -> None:
        """Panic mode: on past the end of the line, and past a block that follows it."""
        self.errors.append((self.lines[self.at], str(error)))
        while self.kinds[self.at] not in ("nl", "end"):
            self.at += 1
        if self.kinds[self.at] == "nl":
            self.at += 1
        if self.kinds[self.at] == "in":
            depth = 0
            while self.kinds[self.at] != "end":
                depth += (self.kinds[self.at] == "in") - (self.kinds[self.at] == "out")
                self.at += 1
                if depth == 0:
                    break

    def statement(self) -> None:
        t = self.texts[self.at] if self.kinds[self.at] == "name" else ""
        if t in ("if", "while", "for", "try", "with", "def", "class", "async"):
            getattr(self, "do_" + t)()
        elif self.is_op("@"):
            self.decorated()
        elif t == "match" and self.match_statement():
            pass
        else:
            self.simple_line()

    def simple_line(self) -> None:
        while True:
            self.simple()
            if self.op(";"):
                if self.kinds[self.at] == "nl":
                    break
                continue
            break
        if self.kinds[self.at] != "nl":
            self.fail()
        self.at += 1

    def block(self) -> None:
        self.need(":")
        if self.kinds[self.at] != "nl":
            return self.simple_line()
        self.at += 1
        if self.kinds[self.at] != "in":
            raise Failure("expected an indented block")
        self.at += 1
        while self.kinds[self.at] != "out":
            if self.kinds[self.at] == "end":
                return
            if self.kinds[self.at] == "in":
                self.errors.append((self.lines[self.at], "unexpected indent"))
                self.at += 1
                while self.kinds[self.at] not in ("out", "end"):
                    self._guarded()
                if self.kinds[self.at] == "out":
                    self.at += 1
                continue
            self._guarded()
        self.at += 1

    def _guarded(self) -> None:
        try:
            self.statement()
        except Failure as e:
            self.recover(e)

    def do_if(self) -> None:
        self.at += 1
        self.named()
        self.block()
        while self.word("elif"):
            self.named()
            self.block()
        if self.word("else"):
            self.block()

    def do_while(self) -> None:
        self.at += 1
        self.named()
        self.block()
        if self.word("else"):
            self.block()

    def do_for(self) -> None:
        self.at += 1
        self.targets(("in",))
        if not self.word("in"):
            self.fail("expected 'in'")
        self.star_expressions()
        self.block()
        if self.word("else"):
            self.block()

    def do_try(self) -> None:
        self.at += 1
        self.block()
        handlers = stars = 0
        bare = False
        while self.word("except"):
            if bare:
                self.fail("default 'except:' must be last")
            stars += self.op("*")
            if not self.is_op(":"):
                self.ternary()
                if self.word("as"):
                    self.name()
                elif self.is_op(","):
                    self.fail("multiple exception types must be parenthesized")
            else:
                bare = True
                if stars:
                    self.fail("expected one or more exception types")
            handlers += 1
            self.block()
        if stars and stars != handlers:
            self.fail("cannot have both 'except' and 'except*'")
        if handlers and self.word("else"):
            self.block()
        if self.word("finally"):
            self.block()
        elif not handlers:
            self.fail("expected 'except' or 'finally' block")

    def do_with(self) -> None:
        self.at += 1
        start = self.at
        if self.is_op("(") and self.attempt(self._parenthesised_items) and self.is_op(":"):
            return self.block()
        self.at = start
        while True:
            self._with_item()
            if not self.op(","):
                break
        self.block()

    def _with_item(self) -> None:
        self.ternary()
        if self.word("as"):
            kind = self.star_target()
            self.check_target(kind, True)

    def _parenthesised_items(self) -> None:
        self.need("(")
        while True:
            self._with_item()
            if not self.op(","):
                break
            if self.is_op(")"):
                break
        self.need(")")

    def attempt(self, rule) -> bool:
        start, errors = self.at, len(self.errors)
        try:
            rule()
            return True
        except Failure:
            self.at = start
            del self.errors[errors:]
            return False

    def do_async(self) -> None:
        self.at += 1
        if not self.is_word("def", "with", "for"):
            self.fail()
        getattr(self, "do_" + self.texts[self.at])()

    def decorated(self) -> None:
        while self.op("@"):
            self.named()
            if self.kinds[self.at] != "nl":
                self.fail()
            self.at += 1
        if self.is_word("async") and self.texts[self.at + 1] == "def":
            self.at += 1
        if not self.is_word("def", "class"):
            self.fail()
        getattr(self, "do_" + self.texts[self.at])()

    def do_def(self) -> None:
        self.at += 1
        self.name()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.op("->"):
            self.expression()
        self.block()

    def parameters(self, closing: str, annotated: bool) -> None:
        seen_default = star = keywords = False
        names: set[str] = set()
        count = 0
        while not self.is_op(closing):
            if keywords:
                self.fail("arguments cannot follow var-keyword argument")
            if self.op("/"):
                if not count or star:
                    self.fail("at least one argument must precede /")
            elif self.op("**"):
                self._parameter(names, annotated)
                keywords = True
            elif self.op("*"):
                if star:
                    self.fail("* argument may appear only once")
                star = True
                if self.is_op(","):
                    if self.texts[self.at + 1] in (closing, "**"):
                        self.fail("named arguments must follow bare *")
                elif self.is_op(closing):
                    self.fail("named arguments must follow bare *")
                else:
                    self._parameter(names, annotated, True)
            else:
                self._parameter(names, annotated)
                if self.op("="):
                    self.ternary()
                    seen_default = True
                elif seen_default and not star:
                    self.fail("non-default argument follows default argument")
            count += 1
            if not self.op(","):
                break
        if not self.is_op(closing):
            self.fail()

    def _parameter(self, names: set[str], annotated: bool, starred: bool = False) -> None:
        self.name()
        if annotated and self.op(":"):
            if starred and self.op("*"):
                self.binary(1)
            else:
                self.ternary()

    def do_class(self) -> None:
        self.at += 1
        self.name()
        if self.op("("):
            self.arguments()
            self.need(")")
        self.block()

    def match_statement(self) -> bool:
        """A match statement, if what follows reads as one."""
        start, errors = self.at, len(self.errors)
        try:
            self.at += 1
            self._subject()
            self.need(":")
            if self.kinds[self.at] != "nl" or self.kinds[self.at + 1] != "in" or self.texts[self.at + 2] != "case":
                self.fail()
        except Failure:
            self.at = start
            del self.errors[errors:]
            return False
        self.at += 2
        while self.word("case"):
            self.patterns()
            if self.word("if"):
                self.named()
            self.block()
        if self.kinds[self.at] == "out":
            self.at += 1
        elif self.kinds[self.at] != "end":
            self.fail()
        return True

    def _subject(self) -> None:
        kind, comma = self.star_expression(True), False
        while self.op(","):
            comma = True
            if self.is_op(":"):
                break
            self.star_expression(True)
        if kind == "star" and not comma:
            self.fail()

    def patterns(self) -> None:
        star = comma = False
        while True:
            if self.op("*"):
                self.name()
                star = True
            else:
                self.pattern()
            if not self.op(","):
                break
            comma = True
            if self.is_op(":", ")") or self.is_word("if"):
                break
        if star and not comma:
            self.fail()

    def pattern(self) -> None:
        while True:
            self.closed_pattern()
            if not self.op("|"):
                break
        if self.word("as"):
            self.name()

    def closed_pattern(self) -> None:
        if self.op("("):
            if not self.is_op(")"):
                self.patterns()
            self.need(")")
        elif self.op("["):
            if not self.is_op("]"):
                while not self.is_op("]"):
                    if self.op("*"):
                        self.name()
                    else:
                        self.pattern()
                    if not self.op(","):
                        break
            self.need("]")
        elif self.op("{"):
            while not self.is_op("}"):
                if self.op("**"):
                    self.name()
                else:
                    if self.kinds[self.at] == "num" or self.is_op("-"):
                        self._number_pattern()
                    else:
                        self.postfix()
                    self.need(":")
                    self.pattern()
                if not self.op(","):
                    break
            self.need("}")
        elif self.kinds[self.at] == "num" or self.is_op("-"):
            self._number_pattern()
        elif self.kinds[self.at] == "str":
            self.atom()
        elif self.is_word("None", "True", "False"):
            self.at += 1
        else:
            self.name()
            while self.op("."):
                self.name()
            if self.op("("):
                while not self.is_op(")"):
                    if self.kinds[self.at] == "name" and self.texts[self.at + 1] == "=":
                        self.at += 2
                    self.pattern()
                    if not self.op(","):
                        break
                self.need(")")

    def _number_pattern(self) -> None:
        """A number with a sign, or a complex one."""
        self.op("-")
        for last in (False, True):
            if self.kinds[self.at] != "num":
                self.fail()
            self.at += 1
            if last or not self.is_op("+", "-"):
                return
            self.at += 1

    def simple(self) -> None:
        t = self.texts[self.at] if self.kinds[self.at] == "name" else ""
        if t in ("pass", "break", "continue"):
            self.at += 1
        elif t == "return":
            self.at += 1
            if self.kinds[self.at] != "nl" and not self.is_op(";"):
                self.star_expressions()
        elif t == "raise":
            self.at += 1
            if self.kinds[self.at] != "nl" and not self.is_op(";"):
                self.expression()
                if self.word("from"):
                    self.expression()
        elif t in ("global", "nonlocal"):
            self.at += 1
            self.name()
            while self.op(","):
                self.name()
        elif t == "del":
            self.at += 1
            while True:
                kind = self.primary_star()
                self.check_target(kind, False, "delete")
                if not self.op(",") or self.kinds[self.at] == "nl" or self.is_op(";"):
                    break
        elif t == "assert":
            self.at += 1
            self.ternary()
            if self.op(","):
                self.ternary()
        elif t == "import":
            self.at += 1
            while True:
                self.dotted()
                if self.word("as"):
                    self.name()
                if not self.op(","):
                    break
        elif t == "from":
            self.from_import()
        else:
            self.expression_statement()

    def dotted(self) -> None:
        self.name()
        while self.op("."):
            self.name()

    def from_import(self) -> None:
        self.at += 1
        dots = 0
        while self.is_op(".", "..."):
            self.at += 1
            dots += 1
        if not dots or not self.is_word("import"):
            self.dotted()
        if not self.word("import"):
            self.fail("expected 'import'")
        if self.op("*"):
            return
        closing = self.op("(")
        while True:
            self.name()
            if self.word("as"):
                self.name()
            if not self.op(","):
                break
            if closing and self.is_op(")"):
                break
            if not closing and self.kinds[self.at] == "nl":
                self.fail("trailing comma not allowed without surrounding parentheses")
        if closing:
            self.need(")")

    def expression_statement(self) -> None:
        kind = self.star_expressions(True)
        if self.is_op("="):
            while self.op("="):
                self.check_target(kind, True)
                kind = self.star_expressions(True)
            return
        if self.kinds[self.at] == "op" and self.texts[self.at] in AUGMENTED:
            if kind not in ("name", "attribute", "index"):
                self.fail("illegal expression for augmented assignment")
            self.at += 1
            self.star_expressions(True)
            return
        if self.is_op(":"):
            if kind not in ("name", "attribute", "index", "paren-name", "paren-attribute", "paren-index"):
                self.fail("illegal target for annotation")
            self.at += 1
            self.expression()
            if self.op("="):
                self.star_expressions(True)
            return

    def check_target(self, kind: str, star: bool, verb: str = "assign to") -> None:
        kind = kind.removeprefix("paren-")
        if kind not in ("name", "attribute", "index", "target", "list-target") and not (star and kind == "star"):
            self.fail(f"cannot {verb} {kind}")

    def targets(self, stop: tuple[str, ...]) -> None:
        """for-loop targets: up to "in", so comparisons are not read."""
        while True:
            kind = self.star_target()
            self.check_target(kind, True)
            if not self.op(",") or self.is_word(*stop):
                return

    def star_target(self) -> str:
        if self.op("*"):
            self.check_target(self.postfix(), False)
            return "star"
        return self.postfix()

    def primary_star(self) -> str:
        return self.postfix()

    # --- expressions

    def star_expressions(self, yields: bool = False) -> str:
        if yields and self.is_word("yield"):
            return self.yield_()
        kind = self.star_expression()
        if not self.is_op(","):
            return kind
        good = kind.removeprefix("paren-") in ("name", "attribute", "index", "target", "list-target", "star")
        while self.op(","):
            if self.kinds[self.at] in ("nl", "end") or self.kinds[self.at] == "op" and self.texts[self.at] in ("=", ")", "]", "}", ":", ";") or self.kinds[self.at] == "op" and self.texts[self.at] in AUGMENTED:
                break
            kind = self.star_expression()
            good = good and kind.removeprefix("paren-") in ("name", "attribute", "index", "target", "list-target", "star")
        return "target" if good else "tuple"

    def star_expression(self, named: bool = False) -> str:
        """An expression or an unpacked one; only inside brackets may it name its value."""
        if self.op("*"):
            self.binary(1)
            return "star"
        return self.named() if named else self.expression()

    def yield_(self) -> str:
        self.at += 1
        if self.word("from"):
            self.expression()
        elif self.kinds[self.at] != "nl" and not self.is_op(")", "]", "}", ";", "=", ":"):
            self.star_expressions()
        return "yield"

    def named(self) -> str:
        if self.kinds[self.at] == "name" and self.texts[self.at] not in KEYWORDS and self.texts[self.at + 1] == ":=" and self.kinds[self.at + 1] == "op":
            self.at += 2
            self.expression()
            return "named"
        return self.expression()

    def expression(self) -> str:
        return self.ternary()

    def ternary(self) -> str:
        if self.is_word("lambda"):
            self.at += 1
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return "lambda"
        kind = self.or_()
        if self.word("if"):
            self.or_()
            if not self.word("else"):
                self.fail("expected 'else' after 'if' expression")
            self.expression()
            return "conditional"
        return kind

    def or_(self) -> str:
        kind = self.and_()
        while self.word("or"):
            self.and_()
            kind = "operation"
        return kind

    def and_(self) -> str:
        kind = self.not_()
        while self.word("and"):
            self.not_()
            kind = "operation"
        return kind

    def not_(self) -> str:
        if self.word("not"):
            self.not_()
            return "operation"
        kind = self.binary(1)
        while True:
            if self.is_op("<", ">", "<=", ">=", "==", "!="):
                self.at += 1
            elif self.is_word("in"):
                self.at += 1
            elif self.is_word("is"):
                self.at += 1
                self.word("not")
            elif self.is_word("not") and self.texts[self.at + 1] == "in":
                self.at += 2
            else:
                return kind
            self.binary(1)
            kind = "comparison"

    def binary(self, least: int) -> str:
        """Precedence climbing over the operators that bind tighter than comparisons."""
        kind = self.unary()
        while self.kinds[self.at] == "op" and (level := PRECEDENCE.get(self.texts[self.at], 0)) >= least and level:
            self.at += 1
            self.binary(level + 1)
            kind = "operation"
        return kind

    def unary(self) -> str:
        if self.is_op("+", "-", "~"):
            self.at += 1
            self.unary()
            return "operation"
        awaited = self.word("await")
        kind = self.postfix()
        if self.op("**"):
            self.unary()
            return "operation"
        return "operation" if awaited else kind

    def postfix(self) -> str:
        kind = self.atom()
        while self.kinds[self.at] == "op":
            t = self.texts[self.at]
            if t == ".":
                self.at += 1
                self.name()
                kind = "attribute"
            elif t == "(":
                self.at += 1
                self.arguments()
                self.need(")")
                kind = "call"
            elif t == "[":
                self.at += 1
                self.slices()
                self.need("]")
                kind = "index"
            else:
                break
        return kind

    def slices(self) -> None:
        while True:
            if self.op("*"):
                self.binary(1)
            else:
                if not self.is_op(":"):
                    self.named()
                if self.op(":"):
                    if not self.is_op(":", ",", "]"):
                        self.expression()
                    if self.op(":") and not self.is_op(",", "]"):
                        self.expression()
            if not self.op(",") or self.is_op("]"):
                return

    def arguments(self) -> None:
        keyword = unpacked = False
        count = 0
        while not self.is_op(")"):
            if self.op("**"):
                self.expression()
                unpacked = True
            elif self.op("*"):
                if unpacked:
                    self.fail("iterable argument unpacking follows keyword argument unpacking")
                self.expression()
            elif self.kinds[self.at] == "name" and self.texts[self.at + 1] == "=" and self.kinds[self.at + 1] == "op":
                if self.texts[self.at] in KEYWORDS:
                    self.fail("expression cannot contain assignment")
                self.at += 2
                self.expression()
                keyword = True
            else:
                self.named()
                if self.is_word("for", "async"):
                    self.comprehension()
                    if (count or self.is_op(",")) and not (self.is_op(",") and self.texts[self.at + 1] == ")" and not count):
                        self.fail("generator expression must be parenthesized")
                elif keyword or unpacked:
                    self.fail("positional argument follows keyword argument")
                elif self.is_op("="):
                    self.fail("expression cannot contain assignment, perhaps you meant \"==\"?")
            count += 1
            if not self.op(","):
                break

    def comprehension(self) -> None:
        while self.is_word("for", "async"):
            if self.word("async") and not self.is_word("for"):
                self.fail()
            self.at += 1
            self.targets(("in",))
            if not self.word("in"):
                self.fail("expected 'in'")
            self.or_()
            while self.word("if"):
                if self.kinds[self.at] == "name" and self.texts[self.at + 1] == ":=":
                    self.fail()
                self.or_()

    def atom(self) -> str:
        kind, t = self.kinds[self.at], self.texts[self.at]
        if kind == "name":
            if t in ("None", "True", "False"):
                self.at += 1
                return "literal"
            self.name()
            return "name"
        if kind == "num":
            self.at += 1
            return "literal"
        if kind == "str":
            first = t
            while self.kinds[self.at] == "str":
                if self.texts[self.at] != first:
                    self.fail("cannot mix bytes and nonbytes literals")
                self.at += 1
            return "literal"
        if kind == "op":
            if t == "...":
                self.at += 1
                return "ellipsis"
            if t == "(":
                self.at += 1
                if self.op(")"):
                    return "target"
                if self.is_word("yield"):
                    self.yield_()
                    self.need(")")
                    return "yield"
                kind = self.star_expression(True)
                if self.is_word("for", "async"):
                    if kind == "star":
                        self.fail("iterable unpacking cannot be used in comprehension")
                    self.comprehension()
                    self.need(")")
                    return "generator expression"
                if self.is_op(","):
                    good = kind.removeprefix("paren-") in ("name", "attribute", "index", "target", "list-target", "star")
                    while self.op(","):
                        if self.is_op(")"):
                            break
                        kind = self.star_expression(True)
                        good = good and kind.removeprefix("paren-") in ("name", "attribute", "index", "target", "list-target", "star")
                    self.need(")")
                    return "target" if good else "tuple"
                self.need(")")
                if kind == "star":
                    self.fail("cannot use starred expression here")
                return kind if kind.startswith("paren-") else "paren-" + kind
            if t == "[":
                self.at += 1
                good = True
                if not self.is_op("]"):
                    kind = self.star_expression(True)
                    if self.is_word("for", "async"):
                        if kind == "star":
                            self.fail("iterable unpacking cannot be used in comprehension")
                        self.comprehension()
                        self.need("]")
                        return "list comprehension"
                    good = kind.removeprefix("paren-") in ("name", "attribute", "index", "target", "list-target", "star")
                    while self.op(","):
                        if self.is_op("]"):
                            break
                        kind = self.star_expression(True)
                        good = good and kind.removeprefix("paren-") in ("name", "attribute", "index", "target", "list-target", "star")
                self.need("]")
                return "list-target" if good else "list"
            if t == "{":
                return self.braces()
        self.fail()

    def braces(self) -> str:
        self.at += 1
        if self.op("}"):
            return "dict"
        if self.op("**"):
            self.binary(1)
            mapping = True
        else:
            kind = self.star_expression(True)
            mapping = self.op(":")
            if mapping:
                self.expression()
            if self.is_word("for", "async"):
                if kind == "star":
                    self.fail()
                self.comprehension()
                self.need("}")
                return "comprehension"
        while self.op(","):
            if self.is_op("}"):
                break
            if mapping:
                if self.op("**"):
                    self.binary(1)
                else:
                    self.expression()
                    self.need(":")
                    self.expression()
            else:
                self.star_expression(True)
        self.need("}")
        return "dict" if mapping else "set"


def parse_errors(text: str) -> list[tuple[int, str]]:
    """(line, message) of every error, in the order of the lines."""
    return Parser(text).run()
