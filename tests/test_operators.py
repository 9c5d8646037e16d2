"""Operators that need files, random cases or a plain version."""

import bz2
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.operators import joins as J
from tallyspark.operators import parsers as P
from tallyspark.operators import summaries as S
from tallyspark.operators import windows as W
from tallyspark.sources import readers, writers
from tallyspark.streaming import turns as T


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chunks_equal_a_plain_loop(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\n é") for _ in range(rng.randint(0, 120))) for _ in range(60)]

    def plain(text, size):
        out = []
        while text:
            cut = min(size, len(text))
            if len(text) > size:
                at = text.rfind("\n", size - size // 5, size)
                cut = at + 1 if at >= 0 and at + 1 > size - size // 5 else size
            out.append(text[:cut])
            text = text[cut:]
        return out

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.chunks(F.col("t"), 20).alias("c")).collect()
    assert {r.k: r.c for r in rows} == {k: plain(t, 20) for k, t in enumerate(texts)}


def test_clamp_equals_the_sequential_fold(spark):
    rng = random.Random(2)
    times = [rng.choice([None, rng.randint(0, 30)]) for _ in range(60)]
    df = spark.createDataFrame([(0, k, t) for k, t in enumerate(times)], "g int, k int, micros long").select("g", "k", F.timestamp_micros("micros").alias("t"))
    want, last = [], None
    for t in times:
        if t is not None:
            last = t if last is None else max(t, last + 1)
        want.append(None if t is None else last)
    assert [r.clamped for r in W.clamp_timestamps(df, ["g"], ["k"], "t").orderBy("k").collect()] == want


def test_shares_add_up(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, rng.randint(0, 50)]), 97 * g % 200) for g in range(40) for i in range(rng.randint(1, 6))]
    out = W.apportion(spark.createDataFrame(rows, "g int, i int, w int, t int"), ["g"], ["i"], "w", "t").groupBy("g").agg(F.sum("share").alias("s"), F.first("t").alias("t")).collect()
    assert all(r.s == r.t for r in out)


def test_sources_and_sinks(spark, tmp_path):
    entry = {"instance_id": "i", "repo": "o/r", "setup": {"a": "b"}, "test": {}}
    for name, body in (("a.json", [entry]), ("b.json", {"data": [entry, entry]}), ("c.json", entry)):
        (tmp_path / name).write_text(json.dumps(body))
    assert readers.dataset(spark, str(tmp_path / "*.json")).count() == 4

    (tmp_path / "inv").mkdir()
    (tmp_path / "inv/r1.bz2").write_bytes(bz2.compress(b"t::a\n\nt::b\n"))
    (tmp_path / "inv/r2#fail_to_pass.bz2").write_bytes(bz2.compress(b"t::c\n"))
    got = {(r.key, r.kind, r.test_id) for r in readers.inventory(spark, str(tmp_path / "inv")).collect()}
    assert got == {("r1", "all", "t::a"), ("r1", "all", "t::b"), ("r2", "fail_to_pass", "t::c")}

    writers.write_inventory(spark.createDataFrame([("k", "b"), ("k", "a")], "key string, test_id string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out/key=k")).collect()] == ["a", "b"]

    records = spark.createDataFrame([(1, False), (2, True), (3, None)], "k int, capture_mismatch boolean")
    for _ in range(2):
        writers.append_jsonl(records, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log/output")).count() == 4 and spark.read.json(str(tmp_path / "log/audit")).count() == 2

    for suffix in ("csv", "json", "md"):
        writers.write_report(records.select("k"), str(tmp_path / f"rep.{suffix}"))
    assert spark.read.csv(str(tmp_path / "rep.csv"), header=True).count() == spark.read.json(str(tmp_path / "rep.json")).count() == spark.read.text(str(tmp_path / "rep.md")).count() == 3
    writers.write_packages(spark.createDataFrame([("t", "m", 1)], "task string, model string, n int"), str(tmp_path / "pkg"), ["task", "model"])
    assert (tmp_path / "pkg/task=t/model=m").is_dir()

    (tmp_path / "TEST-a.xml").write_text('<testsuite><testcase classname="C" name="a"/><testcase classname="C" name="b"><failure>x</failure></testcase></testsuite>')
    assert {(r.test_id, r.status) for r in readers.surefire(spark, str(tmp_path / "TEST-a.xml")).collect()} == {("C#a", "PASSED"), ("C#b", "FAILED")}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/x.log").write_text("hello")
    (tmp_path / "logs/big.log").write_text("x" * 100)
    got = {r.path.rsplit("/", 1)[1]: (r.state, r.text) for r in readers.logs(spark, str(tmp_path / "logs"), file_cap=50).collect()}
    assert got == {"x.log": ("read", "hello"), "big.log": ("too_large", None)}
    (tmp_path / "c.csv").write_text("library,url\na,https://github.com/o/a\nb,https://example.com/o/b\n")
    assert [r.repo for r in readers.candidates_csv(spark, str(tmp_path / "c.csv")).collect()] == ["a"]


def test_turn_sink_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "turns"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.json").write_text(json.dumps({"module": "m", "turn": k, "role": "user", "tokens": 1, "timestamp": "2024-01-01T00:00:00Z"}))
        T.sink(T.turn_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.turn for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]


@pytest.mark.parametrize("missing", ["tallyspark.llm", "corpus_pipeline"])
def test_entry_without_the_corpus_operators(missing, monkeypatch):
    import importlib
    import sys

    # an earlier import of the pipeline must not stand in for a new one
    for name in [n for n in sys.modules if n == missing or n.startswith(missing + ".") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    import __spark_entry__ as entry

    monkeypatch.delitem(sys.modules, "__spark_entry__")
    entry = importlib.import_module("__spark_entry__")
    assert "pass_rate_by_repo" in entry.queries()
    assert ("pipeline" in entry.queries()) is (missing not in ("tallyspark.llm", "corpus_pipeline"))


@pytest.mark.parametrize("most_chars", [0, J.NEEDLE_CHARS])
def test_needles_of_any_length_are_found(spark, most_chars):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.choice((rng.randint(0, 200), 3000)))) for _ in range(30)] + ["fixed by 3f9c2ab81d07 upstream", None]
    needles = ["3f9c2ab81d07", "0" * 12, "", None, texts[0], "a"] + [t[k : k + n] for t in texts[:20] for k, n in ((rng.randint(0, 60), rng.randint(1, 40)),)]
    left = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    right = spark.createDataFrame(list(enumerate(needles)), "needle_id int, needle string")
    want = {(i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if t and n and n in t}
    assert (30, 0) in want
    got = [tuple(r) for r in J.leaked_needles(left, right, most_chars).select("text_id", "needle_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_static_names_nest_and_unescape(spark):
    source = "describe('a', () => {\n  describe(`b`, () => {\n    it('it\\'s', f);\n  });\n  test(\"x\", f);\n  test(\"x\", g);\n});\n// it('gone')\nit('top', f);\nitem('no');"
    rows = spark.createDataFrame([(1, source), (2, None), (3, "")], "doc int, text string")
    got = sorted((r.doc, r.name) for r in P.static_tests(rows).collect())
    assert got == [(1, "a > b > it's"), (1, "a > x"), (1, "top")]


def test_log_files_stop_behind_the_cap_in_the_order_of_a_walk(spark, tmp_path):
    sizes = {"a/b/x.log": 30, "a/c.log": 30, "a-b/y.log": 30, "b/z.txt": 30, "b/no.bin": 5, "c.log": 0}
    for name, n in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * n)
    got = {r.path.split(tmp_path.name + "/", 1)[1]: r.state for r in readers.log_files(spark, str(tmp_path), total_cap=60).collect()}
    assert got == {"a/b/x.log": "read", "a/c.log": "read", "a-b/y.log": "after_cap", "b/z.txt": "after_cap"}


def _js_plain(text):
    """Blocks of failures line by line."""
    out, inside = [], False
    for line in text.split("\n"):
        if line.startswith(("FAIL ", "● ")):
            inside = True
        elif inside and (line.startswith(("PASS ", "Test Suites:")) or line.strip() == "" and out and out[-1].strip() == ""):
            inside = False
        if inside:
            out.append(line)
    return "\n".join(out) if out else text


def test_blocks_of_failures_equal_a_plain_loop(spark):
    rng = random.Random(8)
    logs = ["\n".join(rng.choice(["FAIL a", "PASS b", "", " ", "x", "● y"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [""]
    rows = spark.createDataFrame(list(enumerate(logs)), "doc int, text string")
    got = {r.doc: r.t for r in rows.select("doc", S.js_sections(F.col("text"), "ts").alias("t")).collect()}
    # a block of empty lines alone is no section
    assert got == {k: _js_plain(t) for k, t in enumerate(logs)}


def test_sections_keep_their_most_and_start_before_counts(spark):
    log = "\n".join(["early"] * 9 + [f"n{k}" for k in range(6)] + ["test cases: 2"] + [f"CHECK({k})" for k in range(60)] + [f"x.cc: error: {k}" for k in range(40)])
    rows = spark.createDataFrame([(1, log), (2, None), (3, ""), (4, "nothing here")], "doc int, text string")
    got = {r.doc: r.text for r in S.sections(rows, "cpp").collect()}
    assert got[1].split("\n\n") == ["test cases: 2", "\n".join(f"CHECK({k})" for k in range(50)), "\n".join(f"x.cc: error: {k}" for k in range(30))]
    assert (got[2], got[3], got[4]) == ("", "", "nothing here")
    assert {r.doc: r.tier for r in S.summaries(rows, "cpp", most=500, side=100).collect()} == {1: 3, 2: 0, 3: 0, 4: 0}


def test_stubs_of_c(spark):
    source = "static int f(int a) {\n  STUB_PANIC;\n  STUB_PANIC;\n}\nint g(void);\nvoid *h(char *c)\n{\n  STUB_PANIC;\n}"
    rows = spark.createDataFrame([(1, source), (2, None)], "doc int, text string")
    assert sorted((r.name, r.line) for r in S.stubs(rows, "c").collect()) == [("f", 1), ("h", 6)]


def test_apportion_deals_groups_to_more_tasks_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS", 10)
    rows = spark.range(1_000).selectExpr("id % 300 as g", "cast(id as int) as i", "1 as w", "5 as t")
    out = W.apportion(rows, ["g"], ["i"], "w", "t", place="n")
    assert out.rdd.getNumPartitions() == 100
    assert out.groupBy("g").agg(F.sum("share").alias("s"), F.max("n").alias("n"), F.count("*").alias("c")).filter("s = 5 and n = c").count() == 300


def test_sections_of_cpp_keep_all_lines_when_asked(spark):
    log = "\n".join([f"CHECK({k})" for k in range(60)] + [f"x.cc: error: {k}" for k in range(40)])
    rows = spark.createDataFrame([(1, log)], "doc int, text string")
    whole = "\n".join(f"CHECK({k})" for k in range(60)) + "\n\n" + "\n".join(f"x.cc: error: {k}" for k in range(40))
    assert S.sections(rows, "cpp", checks=None, errors=None).first().text == whole
    assert S.summaries(rows, "cpp", most=1_000, side=100, checks=None, errors=None).first().text.endswith(whole[-100:])


def test_cargo_log_without_sections_is_whole(spark):
    rows = spark.createDataFrame([(1, "note 1\nrunning 15 tests")], "doc int, text string")
    assert S.summaries(rows, "cargo", most=600, side=280).first()[:] == (1, 0, "note 1\nrunning 15 tests")
