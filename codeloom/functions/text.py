"""Column builders over source text. Every one is a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import fixed as X


def java(pattern: str, flags: str = "") -> str:
    return X.JAVA_FLAGS[:-1] + flags + ")" + pattern


def normalise(c: Column) -> Column:
    """Line ends as text mode reads them."""
    return F.regexp_replace(c, "\r\n?", "\n")


def decode(c: Column) -> Column:
    """Bytes as UTF-8 text with normalised line ends."""
    return normalise(F.decode(c, "UTF-8"))


def strip_comments(c: Column) -> Column:
    """Block comments, then line comments, each replaced by a blank. Strings are not looked at."""
    return F.regexp_replace(F.regexp_replace(c, java(X.BLOCK_COMMENT, "s"), " "), java(X.LINE_COMMENT), " ")


def blank_strings(c: Column) -> Column:
    return F.regexp_replace(c, java(X.STRING_LITERAL_JAVA), '""')


def count(c: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(c, F.lit(java(pattern, flags)))


def strip(c: Column) -> Column:
    """Without white space at both ends, by the Unicode rule."""
    return F.btrim(c, F.lit(X.WHITE_SPACE))


def line_classes(text: Column) -> Column:
    """STRUCT(total, code, blank, comment): one fold over the lines, carrying whether a block comment is open."""
    lines = F.transform(F.split(text, "\n", -1), strip)
    zero = F.struct(F.lit(0).alias("code"), F.lit(0).alias("blank"), F.lit(0).alias("comment"), F.lit(False).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        blank = line == ""
        whole = F.startswith(line, F.lit("//"))
        opens = F.contains(line, F.lit("/*"))
        closes = F.contains(line, F.lit("*/"))
        comment = ~blank & (acc["open"] | whole | opens)
        return F.struct(
            (acc["code"] + F.when(blank | comment, 0).otherwise(1)).alias("code"),
            (acc["blank"] + F.when(blank, 1).otherwise(0)).alias("blank"),
            (acc["comment"] + F.when(comment, 1).otherwise(0)).alias("comment"),
            F.when(blank, acc["open"]).when(acc["open"], ~closes).when(whole, F.lit(False)).otherwise(opens & ~closes).alias("open"),
        )

    return F.aggregate(lines, zero, step, lambda acc: F.struct((acc["code"] + acc["blank"] + acc["comment"]).alias("total"), acc["code"].alias("code"), acc["blank"].alias("blank"), acc["comment"].alias("comment")))


def nesting_depth(clean: Column) -> Column:
    """Greatest prefix depth of braces; the depth itself may go below zero."""
    braces = F.split(F.regexp_replace(clean, "[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("top"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.greatest(acc["top"], depth).alias("top"))

    return F.aggregate(braces, zero, step, lambda acc: acc["top"])


def stl_usage(text: Column) -> Column:
    """Sorted library words that occur anywhere in the text, joined; or "none"."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.lit(t) for t in sorted(X.STL_TOKENS)]), lambda t: F.contains(low, t))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(F.lit("none"))


def structure_counts(clean: Column) -> dict[str, Column]:
    """Pattern counts over text without comments. An else-if counts as if, too, and so twice."""
    return {
        "functions": count(clean, X.FUNCTION),
        "loops": count(clean, X.FOR) + count(clean, X.WHILE),
        "conditionals": count(clean, X.IF) + count(clean, X.ELSE_IF) + count(clean, X.SWITCH),
        "classes": count(clean, X.CLASS),
        "namespaces": count(clean, X.NAMESPACE),
        "templates": count(clean, X.TEMPLATE),
        "lambdas": count(clean, X.LAMBDA),
        "includes": count(clean, X.INCLUDE, "m"),
        "returns": count(clean, X.RETURN),
    }


def complexity(clean: Column) -> Column:
    return 1 + count(clean, X.DECISION)


def has_main(blanked: Column) -> Column:
    out = F.lit(False)
    for pattern in X.MAIN_PATTERNS:
        out = out | F.rlike(blanked, F.lit(java(pattern)))
    return out


def test_framework(blanked: Column) -> Column:
    """The first framework whose pattern occurs, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in X.TEST_FRAMEWORKS:
        out = out.when(F.rlike(blanked, F.lit(java(pattern))), F.lit(name))
    return out


def local_includes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(java(X.LOCAL_INCLUDE, "m")), F.lit(1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def normal_path(path: Column) -> Column:
    """A path without "." and ".." parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(folded, "/"))
