"""The lexer against a plain one, and rules by cases of their own."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import classify, lexing, text
from tallyspark.operators import filters, parsers, scoring


def plain_blank(src):
    """One character at a time, without regular expressions over the rest."""
    out, i, n = [], 0, len(src)

    def hide(to):
        nonlocal i
        while i < min(to, n):
            out.append("\n" if src[i] == "\n" else " ")
            i += 1

    while i < n:
        raw = re.match(r'b?r(#*)"', src[i:])
        char = re.match(r"'(\\.[^']*|[^'\\])'", src[i:], re.DOTALL)
        if src.startswith("//", i):
            hide(src.index("\n", i) if "\n" in src[i:] else n)
        elif src.startswith("/*", i):
            depth, j = 1, i + 2
            while j < n and depth:
                step = {"/*": 1, "*/": -1}.get(src[j : j + 2], 0)
                depth, j = depth + step, j + (2 if step else 1)
            hide(j)
        elif raw:
            close = '"' + raw[1]
            at = src.find(close, i + raw.end())
            hide(n if at < 0 else at + len(close))
        elif src[i] == '"':
            j = i + 1
            while j < n and src[j] != '"':
                j += 2 if src[j] == "\\" else 1
            hide(j + 1)
        elif char:
            hide(i + char.end())
        else:
            out.append(src[i])
            i += 1
    return "".join(out)


def test_lexer_equals_plain_lexer():
    rng = random.Random(4)
    signs = ["//", "/*", "*/", '"', "'", "\\", "{", "}", "\n", "r", "#", "b", "a", " ", "'a", "'{'", 'r#"', '"#', "é", "'\\''", "'\\u{1}'"]
    for _ in range(3000):
        src = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert lexing.blanked(src) == plain_blank(src), src


@pytest.mark.parametrize("src", ['"' + "x" * 1_000_000 + '"', '"' + "\\\"" * 500_000 + '"', "/*" * 300_000 + "*/" * 300_000, 'r#"' + '{"' * 400_000 + '"#', '"' + "{" * 1_000_000, "'" * 1_000_000])
def test_long_literals_take_linear_time(src):
    began = time.time()
    out = lexing.blanked("{" + src + "\n}")
    assert time.time() - began < 3 and len(out) == len(src) + 3 and out[0] == "{"


@pytest.mark.parametrize(
    "src, ok",
    [("", True), ("'{'", True), ("/* { /* } */ { */", True), ('r"{"', True), ("}{", False), ("fn f<'a>(x: &'a str) { }", True), ("( [", False), ('"\\"{"', True), ("{", False)],
)
def test_balance(src, ok):
    assert lexing.is_balanced(src) is ok


MODEL = 'fn a() {\n  1\n}\n#[test]\nfn t() {\n  assert!(true); // weak }\n}\nuse x;\n#[cfg(test)]\nmod tests {\n  fn b() {}\n}\n'
BASE = '#[test]\nfn t() {\n  assert_eq!(a(), "}");\n}\nfn old() {}\n#[tokio::test]\nasync fn u() {\n}\n'


def test_tests_of_the_base_come_back(spark):
    want = 'fn a() {\n  1\n}\nuse x;\n\n#[test]\nfn t() {\n  assert_eq!(a(), "}");\n}\n#[tokio::test]\nasync fn u() {\n}\n'
    assert lexing.with_tests_of(MODEL, BASE) == want
    assert lexing.with_tests_of(MODEL, "fn no() {}") == MODEL
    assert lexing.with_tests_of(MODEL + "{", BASE) == MODEL + "{"
    model = spark.createDataFrame([(1, MODEL), (2, None), (3, ""), (4, MODEL)], "doc long, text string")
    base = spark.createDataFrame([(1, BASE), (2, BASE), (3, BASE), (4, None)], "doc long, text string")
    got = {r.doc: r.text for r in parsers.restored_sources(model, base).collect()}
    assert got[1] == want and got[2] is None and got[3].endswith("async fn u() {\n}\n") and got[4] == MODEL
    rows = parsers.balanced(spark.createDataFrame([(1, '"' + "x{" * 200_000 + '"'), (2, "{"), (3, None), (4, "")], "doc long, text string")).collect()
    assert {r.doc: r.ok for r in rows} == {1: True, 2: False, 3: None, 4: True}


def test_items_join_to_the_source():
    rng = random.Random(8)
    lines = ["#[test]", "// x {", "fn a() {", "}", "", "let s = \"{\";", "mod m { }", "/* {", "*/", "  x"]
    for _ in range(500):
        src = "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))
        assert "\n".join(t for t, _ in lexing.items(src)) == src


def ask(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "log, name",
    [
        ("[==========] 3 tests\n[doctest]", "gtest"), ("x [  PASSED  ] 2", "gtest"), ("[doctest] test cases: 3 | assertions: 1", "doctest"), ("test cases: 1\nassertions: 2", "catch2"),
        ("All tests passed!", "unknown"), ("*** Errors were detected in X", "boost_test"), ("Running 2 test cases...\n*** No errors detected ***", "boost_test"),
        ("Test project /x", "ctest"), ("97% tests passed, 1", "ctest"), ("", "unknown"),
    ],
)
def test_frameworks(spark, log, name):
    assert ask(spark, classify.framework, log) == name


def test_compiler_lines(spark):
    log = "A.java:1: error: ';' expected\nA.java:2: error: unexpected\nnote: 2 errors\nnew errorHandler(); // expected\r\nB:3: error: package q\nB:4: error: Illegal Start Of Type: cannot find symbol"
    assert tuple(ask(spark, classify.compiler_counts, log)) == (2, 1, 1)


def test_prose(spark):
    page = "Crate tally\n1.4.2 (now) ·\nCounts things of many\nkinds.\nfn main() { x; }\na::b c::d e.\n- - - ok.\n,;\nBroken off without any end and longer than six words\nA Short Heading\nModules\nMore prose follows here.\nRe-exports\nNothing of this stays.\n"
    want = "Counts things of many kinds.\n\nA Short Heading More prose follows here."
    got = ask(spark, lambda c: text.clean_prose(c, 1000), page.replace("Broken off without any end and longer than six words\n", "Broken off without any end and longer than six words\n\n"))
    assert got == want
    assert ask(spark, lambda c: text.clean_prose(c, 30), page).startswith("Counts things of many kinds.") and ask(spark, lambda c: text.clean_prose(c, 5), page) == ""
    readme = "Search\nModules are fine\nimpl x for y.\n7\nlet x = 1;"
    assert ask(spark, lambda c: text.clean_prose(c, 1000, rust=False), readme) == "Modules are fine impl x for y.\n\n7 let x = 1;"


@pytest.mark.parametrize(
    "chunks, seen",
    [
        (['"type":"respo', "ns", 'e.completed"'], True), (list('\nevent: response.failed'), True), (["event: response.incomplete"], True), (["say event: response.completed"], False),
        (['"type": "response.completed', "", None, '"'], True), (['"type":"response.completed' + "x" * 64, '"'], False), ([], False), ([None], False),
    ],
)
def test_markers(spark, chunks, seen):
    rows = [(1, k, c) for k, c in enumerate(chunks)] + [(2, 0, "none")]
    got = {r.stream: r.seen for r in parsers.marker_seen(spark.createDataFrame(rows, "stream long, pos long, chunk string"), parsers.terminal_markers()).collect()}
    assert got.get(1, False) is seen and got[2] is False


def test_means_leave_out_what_a_language_does(spark):
    runs = [
        ("java", "a", "TESTS_RAN", 0, 4, 4, 0, False), ("java", "crashed", None, 1, 0, 0, 0, False),
        ("js", "a", "TESTS_RAN", 0, 1, 2, 0, False), ("js", "infra", "TESTS_RAN", 1, 0, 2, 0, True), ("go", "infra", "TESTS_RAN", 1, 0, 2, 0, True),
        ("cpp", "model", "COMPILE_FAILED_MODEL", 0, 5, 9, 0, None), ("cpp", "ok", "TESTS_RAN", 0, 9, 9, 0, None), ("rust", "model", "COMPILE_FAILED_MODEL", 0, 1, 2, 0, None),
    ]
    policy = spark.createDataFrame(scoring.LANG_POLICY, scoring.POLICY_SCHEMA)
    df = spark.createDataFrame(runs, "lang string, repo string, status string, exit_code int, num_passed int, num_tests int, compile_errors int, infra_failed boolean")
    got = {r.lang: (r["mean"], r.scored, r.excluded) for r in scoring.policy_means(scoring.run_outcomes(df, policy), policy).collect()}
    assert got == {"java": (1.0, 1, 1), "js": (0.5, 1, 1), "go": (0.0, 1, 0), "cpp": (0.5, 2, 0), "rust": (0.5, 1, 0)}


def test_gate_of_patches_equals_its_reasons(spark):
    rng = random.Random(4)
    parts = ["src", "tests", "TEST", "Test_x.py", "a.spec.ts", "conftest.py", ".", "", "x.pth", "src/test", "src/androidTest", "m.rs", "GO.MOD", "jest.config.js", "__tests__", "y_test.go", "testdata", "a b"]
    paths = ["/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = [(k, f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n" if k % 3 else f"+++ {p}\n@@ -1 +1 @@\n") for k, p in enumerate(paths)] + [(-1, None), (-2, " "), (-3, "no patch")]
    df = spark.createDataFrame(rows, "k int, patch string")
    slow = F.exists(filters.patched_paths(F.coalesce("patch", F.lit(""))), lambda p: filters.cheat_reason(p).isNotNull())
    got = df.select("k", filters.touches_protected(F.col("patch")).alias("fast"), slow.alias("slow")).collect()
    assert [r.k for r in got if r.fast != r.slow] == [] and {r.fast for r in got} == {True, False}


def test_missing_pages_by_title_and_heading(spark):
    signs = ["<title>404 | Site</title>", "<TITLE lang='en'>\n Page  Not\tFound - Docs</TITLE>", "<title>Not found: x</title>", "<title>Project not found — y</title>", "<h1 class='a'> 404 </h1>", "<title>Home</title><h1>Not Found</h1>"]
    others = ["<title>404 ways</title>", "<title>Handling not found errors</title>", "<h1>404 and more</h1>", "<title></title>", "<titles>404</titles>"]
    df = spark.createDataFrame([(s, s in signs) for s in signs + others], "html string, want boolean")
    text = F.lit("x" * 600)
    assert [r.html for r in df.select("html", "want", filters.page_flags(F.col("html"), text)["soft_404"].alias("got")).collect() if r.got != r.want] == []


def test_candidate_flags_and_issues(spark):
    rows = [(50, "maven", "17", "MIT"), (49, "ant", "8", ""), (None, None, None, None)]
    df = spark.createDataFrame(rows, "t int, b string, j string, l string")
    got = df.select(*filters.candidate_flags(*map(F.col, "tbjl")).values()).collect()
    assert [tuple(r) for r in got] == [(True,) * 5, (False,) * 4 + (True,), (False,) * 4 + (True,)]
    assert [r[0] for r in df.select(filters.issues({"few": F.col("t") < 50, "old": F.col("j") == "8"})).collect()] == [[], ["few", "old"], []]
