"""Column builders against independent models in plain Python."""

import random
import re

from pyspark.sql import functions as F

from codeloom.functions import fixed as X
from codeloom.functions import lenient as L
from codeloom.functions import text as T


def model_lines(source):
    total = source.split("\n")
    out = {"total": len(total), "code": 0, "blank": 0, "comment": 0}
    inside = False
    for line in map(str.strip, total):
        if not line:
            out["blank"] += 1
        elif inside or line.startswith("//") or "/*" in line:
            out["comment"] += 1
            if inside:
                inside = "*/" not in line
            elif not line.startswith("//"):
                inside = "*/" not in line
        else:
            out["code"] += 1
    return out


def generated(n, seed=5):
    draw = random.Random(seed)
    pieces = ["int main() {", "}", "", "  ", "// note é", "/* open", "close */", "x = 1; /* a */", "for (int i = 0; i<n; i++) {", "if (a&&b) {", "} else if (c) {", 'cout << "a // b { \\" }";', "switch (x) {", "#include <map>", ' #  include "my.h"', "void f(int a) {", "class Foo {", "namespace n {", "template <class T>", "[&](int x) { return x; };", "while (x) y?1:2;", " ", "　//x"]
    return ["\n".join(draw.choice(pieces) for _ in range(draw.randrange(12))) for _ in range(n)] + ["", "\n", "/*", "}}}{{{"]


def collect(spark, texts, *columns):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *columns).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def test_line_classes(spark):
    texts = generated(300)
    rows = collect(spark, texts, T.line_classes(F.col("t")).alias("l"))
    assert [r[0].asDict() for r in rows] == [model_lines(t) for t in texts]
    assert all(r[0].total == r[0].code + r[0].blank + r[0].comment for r in rows)


def test_counts_complexity_depth(spark):
    texts = [t.replace("\\", "") for t in generated(200, 9)]

    def clean(t):
        return re.sub(X.LINE_COMMENT, " ", re.sub(X.BLOCK_COMMENT, " ", t, flags=re.S))

    def depth(t):
        d = top = 0
        for c in t:
            d += (c == "{") - (c == "}")
            top = max(top, d)
        return top

    c = T.strip_comments(F.col("t"))
    counts = T.structure_counts(c)
    rows = collect(spark, texts, T.complexity(c), T.nesting_depth(c), T.stl_usage(F.col("t")), *counts.values())
    for t, r in zip(texts, rows):
        k = clean(t)
        n = lambda p, f=0: len(re.findall(p, k, f))  # noqa: B023, E731
        assert r[0] == 1 + n(X.DECISION)
        assert r[1] == depth(k)
        used = sorted(w for w in X.STL_TOKENS if w in t.lower())
        assert r[2] == (", ".join(used) or "none")
        assert list(r[3:]) == [n(X.FUNCTION), n(X.FOR) + n(X.WHILE), n(X.IF) + n(X.ELSE_IF) + n(X.SWITCH), n(X.CLASS), n(X.NAMESPACE), n(X.TEMPLATE), n(X.LAMBDA), n(X.INCLUDE, re.M), n(X.RETURN)]


def test_quirks_of_complexity(spark):
    rows = collect(spark, ["a&&b", "a && b", "else if (x)", "case 'x':", "x?1:2", "x ? 1 : 2"], T.complexity(F.col("t")))
    assert [r[0] for r in rows] == [2, 1, 2, 1, 2, 1]


def test_long_literal_does_not_overflow(spark):
    long = 'x = "' + "a" * 200_000 + '" + "' + "\\n" * 20_000 + '";'
    assert collect(spark, [long], T.blank_strings(F.col("t"))) == [('x = "" + "";',)]


def test_frameworks_and_main(spark):
    texts = ["TEST(a, b)", "TEST_CASE(\"x\")", "SUBCASE(\"\")", "BOOST_AUTO_TEST_CASE(x)", "BENCHMARK(f)", "CHECK(1)", "int main() {}", "signed main(void)", "int main(int c, char **v)", "void main()", "int domain()"]
    rows = collect(spark, texts, T.test_framework(F.col("t")), T.has_main(F.col("t")))
    assert [r[0] for r in rows] == ["GoogleTest", "Catch2", "doctest", "BoostTest", "Benchmark", "Catch2", None, None, None, None, None]
    assert [r[1] for r in rows] == [False] * 6 + [True] * 4 + [False]


def test_paths(spark):
    rows = collect(spark, ["/a/b/../c/./d.h", "a/../../x.h", "/x.h"], T.normal_path(F.col("t")), T.base_name(F.col("t")), T.directory(F.col("t")))
    assert [r[0] for r in rows] == ["/a/c/d.h", "../x.h", "/x.h"]
    assert [r[1] for r in rows] == ["d.h", "x.h", "x.h"]
    assert rows[0][2] == "/a/b/../c/."


def test_lenient_and_strict(spark):
    texts = ["3", "3.7", "-3.7", " 5 ", "", None, "1.0d", "pass", "YES ", "3.0", "inf", "nan", "1e3", "0x10"]
    rows = collect(spark, texts, L.to_double(F.col("t")), L.to_int(F.col("t")), L.to_bool(F.col("t")), L.strict_int(F.col("t")), L.strict_bool(F.col("t")))
    assert [r[1] for r in rows] == [3, 3, -3, 5, 0, 0, 0, 0, 0, 3, 0, 0, 1000, 0]
    assert [r[3] for r in rows] == [3, 0, 0, 5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    assert [r[2] for r in rows].count(True) == 2 and rows[7][2] and rows[8][2]
    assert not rows[7][4] and rows[8][4]
    assert rows[0][0] == 3.0 and rows[6][0] == 0.0 and rows[10][0] == float("inf")
