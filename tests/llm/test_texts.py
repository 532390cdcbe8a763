"""Problems 3, 6, 7, 10: parsers, lexers and detectors on hand-made cases."""

import ast
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import cpp_lexer as X
from codeloom.llm import cpp_parser, documented, language, pii, py_parser, syntax


def table(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    for c in ("k", "t", "item", "parts", "left", "state"):
        df = df.withColumn(c, F.lit(c))
    return df


# --- lexer

CODE_TEXT = st.lists(st.sampled_from(['"', "'", "\\", "\n", "//", "/*", "*/", 'R"x(', ')x"', "a", " ", "1'0", "u8", "{", "}", "é"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(CODE_TEXT, st.integers(1, 12))
def test_chunks_compose_to_the_whole(text, size):
    pieces = X.chunks(text, size)
    assert "".join(pieces) == text
    delimiters = set(X.RAW_DELIMITERS.findall(text))
    maps = [X.transitions(p, delimiters) for p in pieces]
    assert all(to == X.lex(p, s)[1] for p, m in zip(pieces, maps) for s, to in m.items())
    states = X.entry_states(maps)
    state = X.CODE
    covered = []
    at = 0
    for p, s in zip(pieces, states):
        assert s == state
        spans, state = X.lex(p, s)
        covered += [(kind, at + a, at + b) for kind, a, b in spans]
        at += len(p)
    whole, end = X.lex(text)
    assert end == state and X.scan(text, size) == whole
    inside = lambda spans: {i for _, a, b in spans for i in range(a, b)}
    assert inside(whole) == inside(covered)


def test_lexer_cases():
    kinds = lambda t: [t[a:b] for _, a, b in X.lex(t)[0]]
    assert kinds('int x = 1\'000; // a \\\n b\n"s//" /* "q" */ \'"\'') == ["// a \\\n b", '"s//"', '/* "q" */', "'\"'"]
    assert kinds('auto s = R"x(a " // )" )x"; int y;') == ['"x(a " // )" )x"']
    assert X.printed(X.STRING, r'"Despu\u00e9s\n\"x\" \x41\303\251"') == 'Después\n"x" Aé'
    assert X.printed("R", '"x(a\\n)x"') == "a\\n"


# --- P3

DOC = "Moves the queue one step ahead and repairs it."


def names(text):
    return [d[0] for d in documented.documented(text)]


@pytest.mark.parametrize(
    "text,expected",
    [
        (f"// {DOC}\nint f(int a) {{ return a; }}", ["f"]),
        (f"/** {DOC} */\ntemplate <typename T>\nT g(T a)\n{{\n}}", ["g"]),
        (f"// {DOC}\n\nint f() {{}}", []),
        (f"// {DOC}\nint f();", []),
        (f"// {DOC}\nstruct S {{ int x; }};", []),
        (f"struct S {{\n  public:\n  /* {DOC} */\n  int m(int a) const {{ return a; }}\n}};", ["m"]),
        (f"namespace n {{\n// {DOC}\nint A::m() {{ return 1; }}\n}}", ["m"]),
        (f"// {DOC}\nint x = 5; int f() {{}}", []),
        ("// TODO\nint f() {}", []),
        ("// f\nint f() {}", []),
        ("/** @param a\n * @param b\n */\nint f(int a, int b) {}", []),
        ("// int y = 5; for (int i = 0; i < n; i++) y += i;\nint f() {}", []),
        ("// 这个函数把最小的元素放在最前面。\nint f() {}", ["f"]),
        (f"// {DOC}\nS::S(int a) : x(a), y{{a}} {{}}", ["S"]),
        (f"// {DOC}\nbool operator<(A a, B b) {{ return 1; }}", ["operator<"]),
        (f"int f() {{\n  struct L {{\n    // {DOC}\n    int g() {{ return 1; }}\n  }};\n}}", ["g"]),
        (f"int f() {{\n  // {DOC}\n  if (x) {{ }}\n}}", []),
        (f"int x;  // {DOC}\nint f() {{}}", []),
        (f"// {DOC}\r\nint main()\r\n{{\r\n}}\r\n", ["main"]),
        (f"// @brief {DOC}\nint f() {{ char c = '{{'; const char* s = \"}}\"; }}\nint g() {{}}", ["f"]),
        ("", []),
        ("}}}{{{((", []),
    ],
)
def test_documented(text, expected):
    assert names(text) == expected


def test_documented_in_branches_and_after_labels():
    text = f"#ifdef A\nvoid f(int) {{\n#else\nvoid f(long) {{\n#endif\n  g();\n}}\n// {DOC}\nint sum() {{ return 1; }}\n"
    assert [n for n, *_ in documented.documented(text)] == ["sum"]
    both = f"#if X\n// {DOC}\nvoid f() {{}}\n#else\n// {DOC}\nvoid g() {{}}\n#endif\n"
    assert [n for n, *_ in documented.documented(both)] == ["f", "g"]
    assert [n for n, *_ in documented.documented(f"class A {{\n// {DOC}\npublic: int sum() {{ return 1; }}\n}};")] == ["sum"]
    assert documented.documented("// compute the sum of all values of this function\nint computeSumOfAllValues() { return 1; }") == []
    assert documented.documented("#if 1\n#if 0\n{\n#endif\n" + f"// {DOC}\nint a() {{}}\n#endif\n// #if {{\n")[0][0] == "a"


def test_documented_ranges(spark):
    text = f"int a;\n// {DOC}\nint f() {{ return 1; }}\nint b;"
    rows = documented.documented_functions(table(spark, [("p", text), ("q", None), (None, text), ("e", "")], "id string, c string"), "id", "c").collect()
    assert [(r.k, r.name, r.description, r.code) for r in rows] == [("p", "f", DOC, f"// {DOC}\nint f() {{ return 1; }}")]


# --- P6

GOOD_CPP = [
    "",
    "#include <vector>\nusing namespace std;\ntemplate <class T, int N = 3> struct A { T x[N]; A() : x{} {} ~A() = default; T operator[](int i) const { return x[i]; } };\nint main() { vector<vector<int>> v(3, vector<int>(2)); for (auto& r : v) for (int& c : r) c = (int)1.5 + sizeof(int); return 0; }",
    "#define REP(i, n) for (int i = 0; i < (n); ++i)\nint main() { REP(i, 3) { if (i < 2 && i > 0) continue; } }",
    "#if 0\nthis is { not code \"\n#endif\n#ifdef X\nint f( {\n#else\nint f() { return 1; }\n#endif",
    "enum class E : int { a, b = 2, };\nstruct B : public A, virtual C { enum { x }; union { int i; float f; }; int b : 3; friend class D; using T = int; };",
    "auto f = [&, x = 1](auto a, int b = 2) mutable -> int { return a < b ? a : b; };\nint (*p)(int, char) = nullptr;\nint g(int (&a)[3], void (*h)());",
    "int main() { int a, b; a < b; f<int>(a); std::pair<int, int> p{1, 2}; auto [x, y] = p; switch (a) { case 1: case 'x': { break; } default: ; } do { a--; } while (a > 0); try { throw 1; } catch (const E& e) { } catch (...) { } goto end; end: return a ? b : 0; }",
    'extern "C" { int f(int); }\nconst char* s = R"(a " b)" "c" u8"d";\nlong long n = 1\'000\'000LL;\nint q = 0x1Fu, r = 0b11;',
    "namespace a::b { template <typename... T> void f(T&&... t) { (g(t), ...); h(t...); } template <> struct X<int> {}; }\nstatic_assert(sizeof(int) == 4, \"x\");",
    "int x = (a) - b; int y = (T)z; auto w = new int[5]; int* u = new (p) T(1); void f() { delete[] w; }",
    "template <typename T> enable_if_t<(sizeof(T) > 1) && is_a<T>::value, int> f(T t) { return static_cast<int>(t) >> 1; }",
]
BAD_CPP = ["int main() {", "int f( { }", "int x = 5 int y;", "int main() { cout << ; }", "<<<<<<< HEAD\nint a;\n=======\nint b;\n>>>>>>> x", "def f(x):\n    return x\n", "int main() { return 0; } }", "int main() { \"abc }", "/* open", "1  int a;", "+int a;", "#if 1\nint a;", "sort(a.begin(), a.end());", "int main() { else x; }", "int main() { int a[3; }", "void f(vector<int>& switch);", "int a；"]


@pytest.mark.parametrize("text", GOOD_CPP)
def test_valid_cpp(text):
    assert cpp_parser.parse_errors(text) == []


@pytest.mark.parametrize("text", BAD_CPP)
def test_invalid_cpp(text):
    assert cpp_parser.parse_errors(text)


def test_preprocessor_has_no_limits():
    many = "#define A(x) x x x x x x x x x x\n#define B(x) A(A(A(x)))\n"
    assert cpp_parser.parse_errors(many + "int main() { A(A(B({ f(); }))) return 0; }") == []
    assert cpp_parser.parse_errors("#if " + " || ".join(["0"] * 500) + " || 1\nint a;\n#else\nint a {{;\n#endif") == []
    assert cpp_parser.parse_errors("#ifdef __cplusplus\nint f( {\n#endif")
    assert cpp_parser.parse_errors('#ifndef __cplusplus\nint f( {\n#endif\n#if __cplusplus >= 201703L && __GNUC__ && defined(__linux__)\nconst char* s = "a" __FILE__;\n#else\n{\n#endif') == []


def test_chains_of_comparisons_are_tried_once():
    chain = " && ".join(f"a{i} < b{i}" for i in range(60))
    assert cpp_parser.parse_errors(f"int main() {{ if ({chain}) return 1; }}") == []
    assert cpp_parser.parse_errors("int int x;") and not cpp_parser.parse_errors("unsigned long long int x;")


def test_recovery_finds_later_errors():
    assert [line for line, _ in cpp_parser.parse_errors("int f() {\n  int a = ;\n  a++;\n  b = );\n}\nint g(int a {\n}\nint h() { return 1; }")] == [2, 4, 6]


PY = ["", "x = 1", "def f(a, /, b=1, *c, d, **e) -> int:\n    return a\n", "class A(B, m=1):\n    @p\n    async def f(self):\n        await x\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': b, **c} | A(d=1): pass\n    case _: pass\n", "try:\n    a\nexcept* E as e:\n    b\nfinally: c\n", "with (a as b, c): pass\n", "x: int = 3; y += 1", "f'{a!r:>{w}} {b[\"c\"]}'", "print('a' if b else c, *d, **e)", "lambda *a, b=1: (yield)", "[i for i in x if i]", "if x:\n\ty\n", "a = b = c, *d = e", "if (n := 1): pass", "del a[1], b.c", "x = 1if y else 2", "match = 1\nmatch(x)", "import a.b as c, d\nfrom . import (e, f,)\n"]
PY_BAD = ["print 'x'", "x = (1]", "def f(:\n  pass", "if x\n  y", "  x", "x = 'a", "'''a", "f(a=1, b)", "a + 1 = b", "x++", "01", "5LL", "for in x: pass", "if x:\npass", "if x:\n    a\n  b\n", "else: x", "<<<<<<< HEAD", "f'{a'", "f'{}'", "def f(a=1, b): pass", "try:\n  a\n", "class: pass", "x = $", "import", "return return", "from a import", "f(x for x in y, 1)", "f'{a[\"b\"]}' f\"{'\\n'}\""]


@pytest.mark.parametrize("text", PY)
def test_valid_python(text):
    ast.parse(text)
    assert py_parser.parse_errors(text) == []


@pytest.mark.parametrize("text", PY_BAD)
def test_invalid_python(text):
    assert py_parser.parse_errors(text)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(PY), st.integers(0, 80), st.sampled_from(["", "(", ")", ":", "\n", " ", "=", "'", ",", "*"]), st.booleans())
def test_python_agrees_with_the_interpreter(text, at, put, drop):
    at = min(at, len(text))
    changed = text[:at] + put + text[at + drop :]
    if "f'" in changed:
        return  # rules that changed in newer versions
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(changed, feature_version=(3, 11))
            good = True
        except (SyntaxError, ValueError):
            good = False
    assert (py_parser.parse_errors(changed) == []) == good, changed


def test_syntax_queries(spark):
    rows = [("/a/x.cpp", "R", "int a;"), ("/a/y.CC", "R", "int a"), ("/a/z.py", "R", "def f(: pass"), ("/a/e.py", None, ""), ("/a/n.cpp", "R", None), (None, "R", "int"), ("/a/o.txt", "R", "((("), ("/a/deep.cpp", "R", "int x = " + "(" * 900 + "1" + ")" * 900 + ";")]
    df = table(spark, rows, "path string, repo string, text string")
    assert {r.path for r in syntax.found(df, "path", "text").collect()} == {"/a/y.CC", "/a/z.py"}
    reports = spark.createDataFrame([("/a/x.cpp", 0, 0), ("/a/x.cpp", None, 1), ("/a/y.CC", 1, 1)], "OriginalPath string, ErrorCount int, ReturnCode int")
    got = {(r.repository, r.language): r for r in syntax.rates(df, "path", "text", "repo", reports).collect()}
    assert (got["R", "cpp"].files, got["R", "cpp"].failing, got["R", "cpp"].compiler_failing, got["R", "cpp"].agreeing) == (3, 1, 2, 1)
    assert got["unknown", "python"].rate == 0.0
    assert syntax.found(df.limit(0), "path", "text").count() == 0


# --- P7

SENTENCES = {
    "en": "If the market is empty there is nothing to do and the tile stays as it was.",
    "de": "Ist der Hafen leer, gibt es nichts zu tun und der Stapel bleibt unverändert.",
    "fr": "Si le puits est vide, il n'y a rien à faire et le marché reste tel quel.",
    "es": "Aquí recorremos la lista hacia atrás hasta la posición y corregimos el túnel.",
    "ru": "Если рынок пуст, делать ничего не нужно, и список остаётся прежним.",
    "zh": "如果窗口是空的，就什么都不用做，灯塔保持不变。",
    "ja": "港が空なら何もしないで、格子はそのまま残しておく。",
}


def trained():
    return language.Model.train([(s, lang) for lang, s in SENTENCES.items() for _ in range(3)] + [("Guardamos o menor barril na frente para que cada mercado seja lido uma única vez.", "pt")] * 3)


def test_model_separates():
    m = trained()
    assert all(m.label(s) == lang for lang, s in SENTENCES.items())
    assert language.Model.train([]).label("x y z") is None


def test_words_of_a_program():
    text = "/*\n * Author: ann lee\n * Created: 2020\n */\n// int x = f(3);\n// " + SENTENCES["de"] + "\nint main() {\n  // TODO\n  puts(\"Si le puits est vide, il n'y a \"\n       \"rien \\u00e0 faire et le march\\u00e9 reste tel quel.\\n\");\n  /** @param x\n   * " + SENTENCES["zh"] + " */\n}"
    got = language.count_words(trained(), text)
    assert set(got) == {"de", "fr", "zh"} and got["de"] == 14 and got["zh"] == 20


def test_language_tables(spark):
    docs = table(spark, [(i, s, lang) for i, (lang, s) in enumerate(SENTENCES.items()) if lang != "ja"] + [(90, None, "en"), (91, "x", None)], "doc_id long, text string, lang string")
    rows = [(f"p{i}", f"// {s}\n// {s}\nint x;\n") for i, s in enumerate(SENTENCES.values())] + [("none", "int x;"), ("null", None), ("long", ("// " + SENTENCES["de"] + "\n") * 40)]
    programs = table(spark, rows, "id string, c string")
    model = language.fit(programs, "id", "c", docs, "doc_id", "text", "lang")
    whole = {(r.k, r.lang): r.n for r in language.language_words(programs, "id", "c", model).collect()}
    assert {k for k, _ in whole} == {f"p{i}" for i in range(7)} | {"long"}
    assert {lang for k, lang in whole if k != "long"} == set(SENTENCES)
    cut = {(r.k, r.lang): r.n for r in language.language_words(programs, "id", "c", model, chunk_chars=200).collect()}
    assert cut == whole
    assert all(abs(r.share - 1.0) < 1e-9 for r in language.shares(programs, "id", "c", model).collect())
    assert language.language_words(programs.limit(0), "id", "c", language.Model.train([])).count() == 0


def test_chunks_keep_open_literals(spark):
    """Raw and spliced strings, and comments, that cross chunk borders give the prose of the whole file."""
    prose = [SENTENCES[x] for x in ("de", "fr", "zh", "es")]
    raw = 'auto s = u8R"x(\n' + "\n".join(p + ' "q" ' for p in prose * 4) + '\n)x" ;\n'
    spliced = 'auto t = "' + " \\\n".join(prose * 4) + '";\n'
    block = "/* " + "\n * ".join(prose * 4) + " */\nint x;\n"
    lines = "\n".join("// " + w for p in prose * 4 for w in p.split()) + "\nint y = 1'000;\n"
    beside = "puts(" + "\n".join(f'"{w} "' for p in prose * 4 for w in p.split()) + ");\n"
    texts = [raw, spliced, block, lines, beside, "int z;\n" * 60 + raw + lines + spliced + beside + block + raw, raw[:-9]]
    rows = [(f"r{i}", t) for i, t in enumerate(texts)] + [("r0", spliced)]
    df = table(spark, rows, "id string, c string")
    model = trained()
    words = lambda n: {(r.k, r.lang): r.n for r in language.language_words(df, "id", "c", model, chunk_chars=n).collect()}
    assert words(40) == words(200) == words(1_000_000)
    pieces = language.closed_pieces(df.selectExpr("id as k", "c as t"), 200).where("k = 'r5'").collect()
    assert len(pieces) > 3 and all(texts[5][r.at : r.at + len(r.t)] == r.t for r in pieces)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['"', "'", "\\", "\n", "\n", "//", "/*", "*/", 'R"x(', ')x"', " ein gutes Wort hier.", " ", ";"]), max_size=40).map("".join), st.integers(1, 12))
def test_borders_cut_no_paragraph(text, size):
    pieces = X.chunks(text, size)
    states = X.entry_states([X.transitions(p, set(X.RAW_DELIMITERS.findall(text))) for p in pieces])
    closed, held = [], ""
    for p, s in zip(pieces, states):
        h, t = language.borders(p, s)
        if h < 0:
            held += p
        else:
            closed += [held + p[:h], p[h:t]]
            held = p[t:]
    closed.append(held)
    assert "".join(closed) == text
    assert [p for c in closed for p in language.paragraphs(c)] == list(language.paragraphs(text))


def test_prose_and_its_share_of_the_file(spark):
    text = "int a;\n" * 100 + "// " + SENTENCES["de"] + "\n" + 'auto s = R"(' + SENTENCES["fr"] + ')";\n' + "int b;\n" * 100
    df = table(spark, [("p", text), ("none", "int x;")], "id string, c string")
    for chunk in (200, 1_000_000):
        rows = {r.lang: r for r in language.prose(df, "id", "c", trained(), chunk).collect()}
        assert set(rows) == {"de", "fr"} and all(r.sentence == SENTENCES[lang] for lang, r in rows.items())
        assert text[rows["de"].start : rows["de"].end] == "// " + SENTENCES["de"]
        assert text[rows["fr"].start : rows["fr"].end] == '"(' + SENTENCES["fr"] + ')"'
        got = {r.lang: r for r in language.shares(df, "id", "c", trained(), chunk_chars=chunk).collect()}
        assert abs(sum(r.share for r in got.values()) - 1) < 1e-9
        assert all(abs(got[x].file_share - len(SENTENCES[x]) / len(text)) < 1e-9 for x in ("de", "fr"))


# --- P10


@pytest.mark.parametrize(
    "text,expected",
    [
        ("write to ann.lee+x@mail.example.org, please", [("email", "ann.lee+x@mail.example.org")]),
        ("<ann @ uni-x.example>", [("email", "ann @ uni-x.example")]),
        ("ann (at) mail [dot] example", [("email", "ann (at) mail [dot] example")]),
        ("ann AT mail DOT example DOT org.", [("email", "ann AT mail DOT example DOT org")]),
        ("git@host.example:a/b.git", []),
        ("https://ann@host.example/r", []),
        ("Call (476) 555-0182 now", [("phone", "(476) 555-0182")]),
        ("Tel.: +49 30 23125 530", [("phone", "+49 30 23125 530")]),
        ("phone=07700 900347\n", [("phone", "07700 900347")]),
        ("Job 434-164-2346a ended", []),
        ("Version 3.186.5404 of it", []),
        ("SSN 944-31-5319;ok", [("id_number", "944-31-5319")]),
        ("DNI 00001935-W and C45/114197/79, XZ4418464", [("id_number", "00001935-W"), ("id_number", "C45/114197/79"), ("id_number", "XZ4418464")]),
        ("at 260 Oberington Street, Varnholt", [("address", "260 Oberington Street")]),
        ("addr: Rua Haskquist, 328, second", [("address", "Rua Haskquist, 328")]),
        ("Hiddenfieldstraße 78b, second", [("address", "Hiddenfieldstraße 78b")]),
        ("at ул. Ульмаская, д. 265, second", [("address", "ул. Ульмаская, д. 265")]),
        ("ul. Tormarsh 123; open", [("address", "ul. Tormarsh 123")]),
        ("272 rue Dranovic\nWe keep", [("address", "272 rue Dranovic")]),
        ("217 rue Fennington Logs go to; 5 rue Victor Hugo, Paris", [("address", "217 rue Fennington"), ("address", "5 rue Victor Hugo")]),
        ("", []),
        (f"<{'x' * 200}.y@mail.example.org>", [("email", "x" * 200 + ".y@mail.example.org")]),
        ("john at example\tdot\tcom", [("email", "john at example\tdot\tcom")]),
        (f"https://{'u' * 90}:pw@host.example", []),
        (f"at 12 {' '.join(['Ab' * 30] * 3)} Street, ok", [("address", f"12 {' '.join(['Ab' * 30] * 3)} Street")]),
    ],
)
def test_fixed_forms(text, expected):
    found = [(kind, text[a:b]) for kind, a, b, sure in sorted(pii.fixed_forms(text), key=lambda x: x[1]) if sure]
    assert found == expected


def letters(spark):
    people = [("Oskora", "Fennvenk"), ("Nadlis", "Wexovic"), ("Dalith", "Quillovic"), ("Kalvin", "Vascell"), ("Briora", "Kardovic"), ("Torane", "Kardell")]
    rows = [(i, f"Reviewed by {a} {b}, {b.lower()}@mail.example.org today.") for i, (a, b) in enumerate(people)]
    rows += [(10 + i, f"Thanks to {a} {b} for the smaller test case.") for i, (a, b) in enumerate(people)]
    rows += [
        (30, "Thanks to Nadlis Kardovic for the smaller test case."),
        (31, "thanks to KARDELL, Oskora for the smaller test case. briora wexovic wrote it."),
        (32, "We follow the Wexovic–Fennvenk sweep. Twin Lattice tool. Calle Wexovic 21."),
        (33, "Thanks to Zelda Unheard for the smaller test case."),
        (34, "tax id 00 370 465 767 out and modulus 998244353"),
        *[(60 + i, f"tax id 944-31-53{i}9 out") for i in range(1, 4)],
        (35, None),
        (36, ""),
        (37, "Call (476) 555-0182. Call (476) 555-0182."),
    ]
    return table(spark, rows, "doc_id long, text string")


def test_bootstrapping_finds_names(spark):
    got = {(r.k, r.type, r.item) for r in pii.found(letters(spark), "doc_id", "text").collect()}
    people = {(k, item) for k, kind, item in got if kind == "person"}
    assert {(30, "Nadlis Kardovic"), (31, "KARDELL, Oskora"), (31, "briora wexovic"), (33, "Zelda Unheard"), (0, "Oskora Fennvenk"), (10, "Oskora Fennvenk")} <= people
    assert {k for k, _ in people} == {*range(6), *range(10, 16), 30, 31, 33}
    assert (32, "address", "Calle Wexovic 21") in got and (34, "id_number", "00 370 465 767") in got
    assert not any("998244353" in item for _, _, item in got)
    assert (37, "phone", "(476) 555-0182") in got


def test_numbers_and_addresses_are_learnt(spark):
    """Labels and street words that no list has: from what stands around the seeds."""
    rows = [(i, f"The row held a real looking DNI 0000{1000 + i}-{c} in column two.") for i, c in enumerate("ABCDEF")]
    rows += [(10 + i, f"The row held a real looking fiscal code 00 370 465 70{i} in column two.") for i in range(3)]
    rows += [(20, "Her fiscal code 00 370 465 709 is gone, and modulus 998244353 stays."), (21, "order 00 999 888 777 was shipped")]
    rows += [(100 + i, f"Ship the board to: {n} Oberington Street, please.") for i, n in enumerate(range(5, 325, 20))]
    rows += [(40, "Ship the board to: 12 Elm Bypass, please."), (41, "Ship the board to: 98 Oak Bypass, please."), (42, "Ship the board to: Keizersgracht 12, please."), (43, "Ship the board to: Herengracht 7b, please."), (44, "Ship the board to: Carrer de Mallorca 401, please."), (45, "Ship the board to: Carrer Nou 4, please.")]
    rows += [(50, "We met at 7 Elder Bypass."), (51, "See Prinsengracht 33 for that."), (52, "Round 3 of Figure 2; In Carrer Vell 9 there is one."), (53, "Take 12 Figs home.")]
    got = {(r.k, r.type, r.item) for r in pii.found(table(spark, rows, "doc_id long, text string"), "doc_id", "text").collect()}
    numbers = {(k, item) for k, kind, item in got if kind == "id_number"}
    assert {(10, "00 370 465 700"), (20, "00 370 465 709"), (0, "00001000-A")} <= numbers and not {k for k, _ in numbers} & {21} and (20, "998244353") not in numbers
    streets = {(k, item) for k, kind, item in got if kind == "address"}
    assert {(40, "12 Elm Bypass"), (42, "Keizersgracht 12"), (43, "Herengracht 7b"), (44, "Carrer de Mallorca 401"), (50, "7 Elder Bypass"), (51, "Prinsengracht 33"), (52, "Carrer Vell 9")} <= streets
    assert not {k for k, _ in streets} & {53} and not any("Round" in x or "Figure" in x for _, x in streets)


def test_redaction_keeps_the_rest(spark):
    got = {r.k: (r.text, r.n_items) for r in pii.redacted(letters(spark), "doc_id", "text").collect()}
    assert got[0] == ("Reviewed by [PERSON], [EMAIL] today.", 2)
    assert got[37] == ("Call [PHONE]. Call [PHONE].", 2) and got[36] == ("", 0) and 35 not in got
    assert pii.found(letters(spark).limit(0), "doc_id", "text").count() == 0


def test_bloom_filter(spark):
    names = [f"name{i}" for i in range(2000)]
    bits = pii.bloom(names)
    assert all(pii.in_bloom(bits, n) for n in names)
    assert sum(pii.in_bloom(bits, f"other{i}") for i in range(2000)) < 20
    assert (pii.built_bloom(table(spark, [(n,) for n in names], "part string").select("part").repartition(5), 2000) == bits).all()
    # Words of one length have unrelated places.
    assert len({(b - a) % (1 << 20) for a, b, *_ in (pii.positions(f"w{i:04d}", 1 << 20) for i in range(500))}) > 490
