"""Text to rows: outputs of test runners, diffs, logs and model answers.

Inputs are DataFrames (doc, text); lines get an explicit position, so results do
not depend on how Spark moves rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from tallyspark.functions import lexing
from tallyspark.functions.rows import rows_of
from tallyspark.shipping import ship

#: Status words of runners.
GO_STATUS = {"pass": "PASSED", "fail": "FAILED", "skip": "SKIPPED"}
JEST_STATUS = {"passed": "PASSED", "failed": "FAILED", "pending": "SKIPPED", "skipped": "SKIPPED", "todo": "SKIPPED", "disabled": "SKIPPED"}


def lines(docs: DataFrame) -> DataFrame:
    """(doc, pos, line) of every line."""
    return docs.select("doc", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line"))


def _word(mapping: dict[str, str], column, default: str | None):
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, column), F.lit(default))


def go_json(docs: DataFrame) -> DataFrame:
    """(doc, test_id, status, duration) of ``go test -json``: a failure always holds, a pass outlives
    a skip, a test that never ends is an error; lines that are no JSON are passed over."""
    schema = "Action string, Package string, Test string, Elapsed double"
    e = lines(docs).select("doc", "pos", F.from_json("line", schema).alias("e")).select("doc", "pos", "e.*")
    tests = e.filter("Test is not null").withColumn("test_id", F.concat_ws("/", F.coalesce("Package", F.lit("")), "Test"))
    ends = tests.filter(F.col("Action").isin(*GO_STATUS)).withColumn("status", _word(GO_STATUS, F.col("Action"), None))
    rank = F.struct(F.when(F.col("status") == "FAILED", 2).when(F.col("status") == "PASSED", 1).otherwise(0), "pos")
    best = ends.groupBy("doc", "test_id").agg(F.max_by(F.struct("status", "Elapsed"), rank).alias("r"))
    started = tests.filter("Action = 'run'").select("doc", "test_id").distinct().join(best, ["doc", "test_id"], "left_anti")
    done = best.select("doc", "test_id", "r.status", F.col("r.Elapsed").alias("duration"))
    return done.unionByName(started.select("doc", "test_id", F.lit("ERROR").alias("status"), F.lit(None).cast("double").alias("duration")))


def go_plain(docs: DataFrame) -> DataFrame:
    """(doc, test_id, status) of ``go test -v``: the last package line above names the package."""
    w = Window.partitionBy("doc").orderBy("pos")
    at = lines(docs).withColumn("pkg", F.last(F.nullif(F.regexp_extract("line", r"^(?:ok|FAIL)\s+(\S+)\s", 1), F.lit("")), ignorenulls=True).over(w))
    hit = at.withColumn("word", F.regexp_extract("line", r"^\s*--- (PASS|FAIL|SKIP): (\S+)", 1)).filter("word <> ''")
    name = F.regexp_extract("line", r"^\s*--- (PASS|FAIL|SKIP): (\S+)", 2)
    status = F.when(F.col("word") == "PASS", "PASSED").when(F.col("word") == "FAIL", "FAILED").otherwise("SKIPPED")
    rows = hit.select("doc", "pos", F.concat_ws("/", "pkg", name).alias("test_id"), status.alias("status"))
    return rows.groupBy("doc", "test_id").agg(F.max_by("status", F.struct(F.col("status") == "FAILED", F.col("status") == "PASSED", "pos")).alias("status"))


def libtest(docs: DataFrame) -> DataFrame:
    """(doc, pos, name, status) of libtest text, doc tests left out, adjacent repeats collapsed."""
    pattern = r"^test (.+?) \.\.\. (ok|FAILED|ignored)"
    rows = lines(docs).select("doc", "pos", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("word")).filter("word <> ''")
    rows = rows.filter(~F.col("name").rlike(r"\.rs - .*\(line \d+\)")).withColumn("status", F.when(F.col("word") == "ok", "PASSED").when(F.col("word") == "FAILED", "FAILED").otherwise("SKIPPED"))
    before = F.lag(F.struct("name", "status")).over(Window.partitionBy("doc").orderBy("pos"))
    return rows.withColumn("b", before).filter(~F.struct("name", "status").eqNullSafe(F.col("b"))).select("doc", "pos", "name", "status")


def nextest(docs: DataFrame) -> DataFrame:
    """(doc, pos, name, status) of nextest's JSON lines."""
    e = lines(docs).select("doc", "pos", F.from_json("line", "type string, event string, name string").alias("e")).select("doc", "pos", "e.*")
    status = F.when(F.col("event") == "ok", "PASSED").when(F.col("event") == "failed", "FAILED").when(F.col("event") == "ignored", "SKIPPED")
    return e.filter("type = 'test'").select("doc", "pos", "name", status.alias("status")).filter("status is not null")


def rust_tests(docs: DataFrame) -> DataFrame:
    """Rows of whichever form a document has; text where the JSON gives nothing."""
    a = nextest(docs)
    return a.unionByName(libtest(docs).join(a.select("doc").distinct(), "doc", "left_anti"))


JEST = "testResults array<struct<name:string,message:string,failureMessage:string,assertionResults:array<struct<ancestorTitles:array<string>,fullName:string,title:string,status:string,duration:double>>>>"


def jest(docs: DataFrame) -> DataFrame:
    """(doc, key, status, seconds) of Jest and Vitest reports; unnamed tests by their place; an
    unknown status is a failure; a report cut short gives its status words by a pattern."""
    parsed = docs.select("doc", "text", F.from_json("text", JEST).alias("j"))
    suites = parsed.filter("j.testResults is not null").select("doc", F.posexplode("j.testResults").alias("s", "suite"))
    tests = suites.select("doc", "s", "suite.name", F.posexplode("suite.assertionResults").alias("k", "t"))
    key = F.concat(F.coalesce("name", F.lit("")), F.lit("::"), F.coalesce(F.nullif("t.fullName", F.lit("")), F.nullif("t.title", F.lit("")), F.concat(F.lit("#"), F.col("k").cast("string"))))
    rows = tests.select("doc", key.alias("key"), _word(JEST_STATUS, F.col("t.status"), "FAILED").alias("status"), (F.coalesce("t.duration", F.lit(0.0)) / 1000).alias("seconds"))
    cut = parsed.filter("j.testResults is null").select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(r'"status"\s*:\s*"(passed|failed|pending|skipped|todo)"'), F.lit(1))).alias("k", "word"))
    rest = cut.select("doc", F.concat(F.lit("<regex-"), F.col("k").cast("string"), F.lit(">")).alias("key"), _word(JEST_STATUS, F.col("word"), "FAILED").alias("status"), F.lit(0.0).alias("seconds"))
    return rows.unionByName(rest)


def jest_crashed(docs: DataFrame) -> DataFrame:
    """(doc, crashed): no suite, or one without tests that has a failure message."""
    j = docs.select("doc", F.from_json("text", JEST).alias("j"))
    bad = F.exists("j.testResults", lambda s: (F.size(s["assertionResults"]) == 0) & (F.coalesce(s["failureMessage"], s["message"], F.lit("")) != ""))
    return j.select("doc", (F.coalesce(F.size("j.testResults") <= 0, F.lit(True)) | F.coalesce(bad, F.lit(False))).alias("crashed"))


def mocha(docs: DataFrame) -> DataFrame:
    """(doc, name, status) of a Mocha report: a failure holds, anything replaces a skip, else the first."""
    item = "array<struct<fullTitle:string>>"
    j = docs.select("doc", F.from_json("text", f"passes {item}, failures {item}, pending {item}").alias("j"))
    part = lambda name, status, order: j.select("doc", F.posexplode(f"j.{name}").alias("k", "t")).select("doc", F.col("t.fullTitle").alias("name"), F.lit(status).alias("status"), (F.lit(order * 1_000_000) + F.col("k")).alias("pos"))
    rows = part("passes", "PASSED", 0).unionByName(part("failures", "FAILED", 1)).unionByName(part("pending", "SKIPPED", 2))
    rank = F.struct(F.when(F.col("status") == "FAILED", 0).when(F.col("status") == "SKIPPED", 2).otherwise(1), "pos")
    return rows.groupBy("doc", "name").agg(F.min_by("status", rank).alias("status"))


@udtf(returnType="name string, status string, seconds double")
class TapRows:
    """Rows of a TAP text: subtests nest by indentation, names join with ' > '."""

    def eval(self, text: str) -> Iterator[tuple]:
        import re

        path: dict[int, str] = {}
        held, block = None, False
        for line in (text or "").split("\n"):
            depth = (len(line) - len(line.lstrip(" "))) // 4
            body = line.strip()
            if held is not None:
                if body == "---":
                    block = True
                    continue
                if block:
                    if m := re.match(r"duration_ms:\s*([0-9.]+)", body):
                        held[2] = float(m[1]) / 1000
                    if body != "...":
                        continue
                    block = False
                    continue
                yield tuple(held)
                held = None
            if body.startswith("Bail out!"):
                break
            if body.startswith("# Subtest: "):
                path = {k: v for k, v in path.items() if k < depth} | {depth: body[11:]}
            elif m := re.match(r"(not )?ok\b\s*\d*\s*-?\s*(.*?)(?:\s+#\s*(SKIP|TODO)\b.*)?$", body, re.I):
                names = [path[k] for k in sorted(path) if k < depth] + [m[2]]
                held = [" > ".join(n for n in names if n), "SKIPPED" if m[3] else "FAILED" if m[1] else "PASSED", 0.0]
        if held is not None:
            yield tuple(held)


def tap(docs: DataFrame) -> DataFrame:
    """(doc, name, status, seconds) of TAP texts, a stack machine over each whole text."""
    return docs.lateralJoin(TapRows(F.col("text").outer())).select("doc", "name", "status", "seconds")


def gtest(docs: DataFrame) -> DataFrame:
    """(doc, name, status, seconds) of GoogleTest output, also where CTest puts ``N: `` before each line."""
    pattern = r"^(?:\d+: )?\[ {2,7}(OK|FAILED) {1,2}\] (.+?)(?:\s+\((\d+)\s*ms\))?$"
    ends = lines(docs).select("doc", F.regexp_extract("line", pattern, 1).alias("w"), F.trim(F.regexp_extract("line", pattern, 2)).alias("name"), F.regexp_extract("line", pattern, 3).alias("ms")).filter("w <> ''")
    return ends.select("doc", "name", F.when(F.col("w") == "OK", "PASSED").otherwise("FAILED").alias("status"), (F.coalesce(F.col("ms").try_cast("double"), F.lit(0.0)) / 1000).alias("seconds"))


def _counted(docs: DataFrame, prefix: str, passed, failed) -> DataFrame:
    """(doc, name, status): as many made names of each outcome as a summary counts."""
    part = lambda n, word, status: F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.concat(F.lit(f"{prefix}_{word}_"), k.cast("string")).alias("name"), F.lit(status).alias("status")))
    none = F.array().cast("array<struct<name:string,status:string>>")
    rows = F.concat(F.when(passed > 0, part(passed, "test", "PASSED")).otherwise(none), F.when(failed > 0, part(failed, "failed", "FAILED")).otherwise(none))
    return docs.select("doc", F.explode(rows).alias("t")).select("doc", "t.*")


def _number(pattern: str, group: int = 1):
    return F.regexp_extract("text", pattern, group).try_cast("int")


def catch2(docs: DataFrame) -> DataFrame:
    """(doc, name, status) of a Catch2 summary, which counts cases without naming those that pass."""
    table = r"test cases:\s*(\d+)\s*\|\s*(\d+)\s*passed\s*\|\s*(\d+)\s*failed"
    all_passed = F.contains("text", F.lit("All tests passed"))
    total, failed = _number(r"(\d+)\s+test cases?\s*(?:passed|:)"), _number(r"(\d+)\s+test cases?\s+failed")
    good = F.when(all_passed, _number(r"(\d+)\s+test case")).otherwise(F.coalesce(_number(table, 2), total - F.coalesce(failed, F.lit(0))))
    bad = F.when(~all_passed, F.coalesce(_number(table, 3), failed))
    return _counted(docs, "catch2", F.coalesce(good, F.lit(0)), F.coalesce(bad, F.lit(0)))


def doctest(docs: DataFrame) -> DataFrame:
    """(doc, name, status) of a doctest summary."""
    head = r"\[doctest\]\s*test cases:\s*(\d+)"
    table = head + r"\s*\|\s*(\d+)\s*passed\s*\|\s*(\d+)\s*failed"
    return _counted(docs, "doctest", F.coalesce(_number(table, 2), _number(head), F.lit(0)), F.coalesce(_number(table, 3), F.lit(0)))


def boost(docs: DataFrame) -> DataFrame:
    """(doc, name, status) of a Boost.Test summary; without a count an errorless run is one test."""
    total, clean = _number(r"Running\s+(\d+)\s+test case"), F.contains("text", F.lit("*** No errors detected ***"))
    broken = F.contains("text", F.lit("*** Errors were detected")) | F.contains(F.lower("text"), F.lit("*** failures"))
    failed = F.when(broken & ~clean, F.coalesce(_number(r"(\d+)\s+failure"), F.lit(0))).otherwise(0)
    return _counted(docs, "boost", F.greatest(F.lit(0), F.coalesce(total, F.when(clean, 1), F.lit(0)) - failed), failed)


def go_list(docs: DataFrame, module: str = "") -> DataFrame:
    """(doc, pos, test_id) of ``go test -list``: names precede the line of their package; names
    that see none belong to ``module``, or to nothing where that is empty."""
    at = lines(docs).withColumn("line", F.trim("line"))
    package = F.nullif(F.regexp_extract("line", r"^(?:ok|FAIL|\?)\s+(\S+)", 1), F.lit(""))
    after = Window.partitionBy("doc").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    named = at.withColumn("pkg", F.coalesce(F.first(package, ignorenulls=True).over(after), F.nullif(F.lit(module), F.lit(""))))
    name = F.regexp_extract("line", r"^((?:Test|Example|Fuzz)\w\S*)", 1)
    return named.filter((name != "") & F.col("pkg").isNotNull()).select("doc", "pos", F.concat_ws("/", "pkg", name).alias("test_id"))


def cargo_list(docs: DataFrame) -> DataFrame:
    """(doc, pos, test_id) of ``cargo test -- --list``: lines that end in ``: test``."""
    status = r"^(Running|Compiling|Finished|Downloading|Downloaded|Fresh) |^[Ww]arning:|^error[:\[]"
    at = lines(docs).withColumn("line", F.trim("line")).filter(F.col("line").endswith(": test") & ~F.col("line").rlike(status))
    return at.select("doc", "pos", F.rtrim(F.regexp_replace("line", ": test$", "")).alias("test_id"))


def gtest_list(docs: DataFrame) -> DataFrame:
    """(doc, pos, test_id) of a GoogleTest binary's listing: tests are indented below their suite."""
    at = lines(docs).filter(F.trim("line") != "")
    indented = F.col("line").rlike(r"^[ \t]")
    above = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    suite = F.last(F.when(~indented, F.regexp_replace(F.trim("line"), r"\.+$", "")), ignorenulls=True).over(above)
    name = F.trim(F.get(F.split("line", "#"), F.lit(0)))
    return at.withColumn("suite", suite).filter(indented & (name != "") & (F.col("suite") != "")).select("doc", "pos", F.concat_ws(".", "suite", name).alias("test_id"))


@udtf(returnType="name string")
class StaticTests:
    """Names of test calls in JavaScript sources: describe blocks nest by indentation."""

    def eval(self, text: str) -> Iterator[tuple]:
        import re

        call = re.compile(r"([ \t]*)(describe|it|test)\s*\(\s*(['\"`])((?:\\.|(?!\3).)*?)\3")
        blocks: list[tuple[int, str]] = []
        seen: set[str] = set()
        for line in (text or "").splitlines():
            m = call.match(line)
            if m is None:
                continue
            depth, name = len(m[1].expandtabs(4)), m[4].replace("\\'", "'").replace('\\"', '"')
            blocks = [b for b in blocks if b[0] < depth]
            if m[2] == "describe":
                blocks.append((depth, name))
            elif (full := " > ".join([*(n for _, n in blocks), name])) not in seen:
                seen.add(full)
                yield (full,)


def static_tests(docs: DataFrame) -> DataFrame:
    """(doc, name) of the tests that sources declare, the first of each name."""
    return docs.lateralJoin(StaticTests(F.col("text").outer())).select("doc", "name")


def ctest(docs: DataFrame) -> DataFrame:
    """(doc, name, status, seconds) of CTest's console lines."""
    pattern = r"^\s*\d+/\d+ Test\s+#\d+: (\S+) \.*\s*\**\s*(Passed|Failed|Skipped|Not Run|Disabled|Timeout|\(Failed\)|\(Not Run\))\s*(?:.*?([0-9.]+) sec)?"
    rows = lines(docs).select("doc", *[F.regexp_extract("line", pattern, k).alias(n) for k, n in ((1, "name"), (2, "word"), (3, "took"))]).filter("word <> ''")
    status = F.when(F.col("word") == "Passed", "PASSED").when(F.col("word").rlike("Skipped|Not Run|Disabled"), "SKIPPED").otherwise("FAILED")
    return rows.select("doc", "name", status.alias("status"), F.coalesce(F.col("took").try_cast("double"), F.lit(0.0)).alias("seconds"))


def junit(docs: DataFrame) -> DataFrame:
    """(doc, test_id, status) of JUnit XML, whole or cut short: failure, error, skipped, else passed."""
    cases = docs.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(<testcase\b.*?(?:/>|</testcase>|(?=<testcase\b)|$))"), F.lit(1))).alias("c"))
    attr = lambda name: F.regexp_extract("c", rf'^<testcase\b[^>]*\b{name}="([^"]*)"', 1)
    status = F.when(F.col("c").rlike("<failure"), "FAILED").when(F.col("c").rlike("<error"), "ERROR").when(F.col("c").rlike("<skipped"), "SKIPPED").otherwise("PASSED")
    return cases.select("doc", F.concat_ws("#", F.nullif(attr("classname"), F.lit("")), attr("name")).alias("test_id"), status.alias("status"))


def pytest_ids(docs: DataFrame, test_dir: str) -> DataFrame:
    """(doc, test_id) that a quiet collection lists, up to the summary banner, under ``test_dir``."""
    at = lines(docs)
    banner = at.filter(F.col("line").rlike(r"^=+ |^\d+ tests? collected|^no tests")).groupBy("doc").agg(F.min("pos").alias("end"))
    ids = at.join(banner, "doc", "left").filter("end is null or pos < end").filter(F.col("line").rlike(r"^\S+\.py::\S"))
    whole = F.when(F.col("line").startswith(test_dir.rstrip("/") + "/"), F.col("line")).otherwise(F.concat(F.lit(test_dir.rstrip("/") + "/"), "line"))
    return ids.select("doc", whole.alias("test_id")).distinct()


def indent_tree(docs: DataFrame) -> DataFrame:
    """(doc, node) of an indented collection tree: the ancestors of each function by running depth.

    A node's parent at depth d is the last line above at depth d; the path is read
    from one running value for each depth up to four.
    """
    pattern = r"^( *)<(\w+) ([^>]+)>"
    at = lines(docs).select("doc", "pos", F.length(F.regexp_extract("line", pattern, 1)).alias("indent"), F.regexp_extract("line", pattern, 2).alias("kind"), F.regexp_extract("line", pattern, 3).alias("name")).filter("kind <> ''").withColumn("depth", (F.col("indent") / 2).cast("int"))
    w = Window.partitionBy("doc").orderBy("pos")
    for d in range(5):
        at = at.withColumn(f"a{d}", F.last(F.when(F.col("depth") == d, F.struct("name", "kind")), ignorenulls=True).over(w))
    parts = F.array_compact(F.array(*[F.when((F.col("depth") >= d) & F.col(f"a{d}.kind").isin("Module", "Class", "Function"), F.col(f"a{d}.name")) for d in range(5)]))
    return at.filter("kind = 'Function'").select("doc", F.array_join(parts, "::").alias("node"))


def eval_lines(docs: DataFrame) -> DataFrame:
    """(doc, name, runtime, passed, tests, status) of an evaluation's output lines and markers."""
    plain = r"^([\w.-]+),([0-9.]+),(\d+)/(\d+)$"
    mark = r"^INVENTORY_MISMATCH,([\w.-]+),(\d+),(\d+),(\d+)$"
    at = lines(docs)
    a = at.filter(F.col("line").rlike(plain)).select("doc", F.regexp_extract("line", plain, 1).alias("name"), F.regexp_extract("line", plain, 2).cast("double").alias("runtime"), F.regexp_extract("line", plain, 3).cast("long").alias("passed"), F.regexp_extract("line", plain, 4).cast("long").alias("tests"), F.lit("OK").alias("status"))
    b = at.filter(F.col("line").rlike(mark)).select("doc", F.regexp_extract("line", mark, 1).alias("name"), F.lit(0.0).alias("runtime"), F.lit(None).cast("long").alias("passed"), F.regexp_extract("line", mark, 2).cast("long").alias("tests"), F.lit("INVENTORY_MISMATCH").alias("status"))
    return a.unionByName(b)


def sections(docs: DataFrame) -> DataFrame:
    """(doc, section, body) of Markdown, the text below each heading."""
    w = Window.partitionBy("doc").orderBy("pos")
    head = F.nullif(F.lower(F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*#*$", 1))), F.lit(""))
    at = lines(docs).withColumn("head", head).withColumn("n", F.count("head").over(w)).filter("n > 0")
    grouped = at.groupBy("doc", "n").agg(F.max("head").alias("section"), F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("pos", "line")))).alias("body"))
    return grouped.select("doc", "section", F.trim(F.array_join(F.transform("body", lambda b: b["line"]), "\n")).alias("body"))


def verdicts(docs: DataFrame, known: list[str]) -> DataFrame:
    """(doc, id, passed) of the first JSON list in a model's answer; unknown ids are dropped."""
    found = F.from_json(F.regexp_extract("text", r"(?s)(\[.*\])", 1), "array<struct<id:string,passed:boolean,pos:long>>")
    return docs.select("doc", F.explode(found).alias("v")).select("doc", "v.id", F.coalesce("v.passed", F.lit(False)).alias("passed"), "v.pos").filter(F.col("id").isin(*known))


EDIT = r"(?s)(?m)^([^\n`]+)\n(`{3,})[^\n]*\n<{5,9} SEARCH\n(.*?)={5,9}\n(.*?)>{5,9} REPLACE\n\2"


def edit_blocks(docs: DataFrame) -> DataFrame:
    """(doc, k, path, old, new) of search-and-replace blocks, fences matched by length."""
    group = lambda k: F.regexp_extract_all("text", F.lit(EDIT), F.lit(k))
    return docs.select("doc", F.posexplode(F.arrays_zip(group(1).alias("path"), group(3).alias("old"), group(4).alias("new"))).alias("k", "e")).select("doc", "k", F.trim("e.path").alias("path"), "e.old", "e.new")


def think_blocks(docs: DataFrame) -> DataFrame:
    """(doc, k, body) of thinking blocks that are not blank."""
    return docs.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<think(?:ing)?>(.*?)</think(?:ing)?>"), F.lit(1))).alias("k", "b")).select("doc", "k", F.trim("b").alias("body")).filter("body <> ''")


def code_blocks(docs: DataFrame) -> DataFrame:
    """(doc, k, body) of fenced Python."""
    return docs.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)```python\n(.*?)```"), F.lit(1))).alias("k", "body"))


def error_counts(docs: DataFrame) -> DataFrame:
    """(doc, file, n) of ``file:line:col: error`` lines."""
    return lines(docs).select("doc", F.regexp_extract("line", r"^([^\s:]+):\d+(?::\d+)?: (?:fatal )?error", 1).alias("file")).filter("file <> ''").groupBy("doc", "file").agg(F.count("*").alias("n"))


def more_errors(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files with more errors after than before."""
    return after.join(before.select("doc", "file", F.col("n").alias("was")), ["doc", "file"], "left").filter("n > coalesce(was, 0)").select("doc", "file", (F.col("n") - F.coalesce("was", F.lit(0))).alias("more"))


def pytest_summary(docs: DataFrame) -> DataFrame:
    """(doc, passed, failed, errors, skipped, status) of the last line's counts."""
    n = lambda word: F.coalesce(F.regexp_extract("text", rf"(\d+) {word}", 1).try_cast("long"), F.lit(0)).cast("long")
    rows = docs.select("doc", "exit_code", n("passed").alias("passed"), n("failed").alias("failed"), n("errors?").alias("errors"), n("skipped").alias("skipped"), F.contains("text", F.lit("ERROR collecting")).alias("broken"))
    total = F.col("passed") + F.col("failed") + F.col("errors") + F.col("skipped")
    return rows.select("doc", "passed", "failed", "errors", "skipped", F.when(F.col("broken"), "COLLECTION_ERROR").when((F.col("exit_code") == 5) | (total == 0), "NO_TESTS").otherwise("OK").alias("status"))


def warnings(docs: DataFrame) -> DataFrame:
    """(name, n): dynamic warning names in logs."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"WARN\[(\w+)\]"), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def history_events(docs: DataFrame) -> DataFrame:
    """(doc, pos, kind, tool, call_id, text) of polymorphic event lists, content as text or as parts."""
    v = docs.select("doc", F.try_parse_json("text").alias("v"))
    e = v.select("doc", F.posexplode(F.expr("cast(v as array<variant>)")).alias("pos", "e"))
    get = lambda path: F.try_variant_get("e", path, "string")
    kind = get("$.kind")
    text = F.coalesce(F.when(F.expr("schema_of_variant(try_variant_get(e, '$.content', 'variant')) = 'STRING'"), get("$.content")), get("$.content[0].text"), F.lit(""))
    call = F.coalesce(get("$.tool_call_id"), get("$.action_id"))
    return e.select("doc", "pos", kind.alias("kind"), get("$.tool").alias("tool"), call.alias("call_id"), text.alias("text"))


def turn_events(turns: DataFrame) -> DataFrame:
    """(conv, turn, k, kind, ts): events that a turn becomes, at fixed offsets in milliseconds."""
    event = lambda kind, ms: F.struct(F.lit(kind).alias("kind"), F.lit(ms).alias("ms"))
    kinds = F.when(F.col("role") == "user", F.array(event("MessageEvent", 0))).otherwise(F.array(event("ActionEvent", 10), event("ObservationEvent", 50), event("FinishEvent", 100)))
    return turns.select("conv", "turn", "ts", F.posexplode(kinds).alias("k", "e")).select("conv", "turn", "k", "e.kind", (F.unix_millis("ts") + F.col("e.ms")).alias("ts_ms"))


def balanced(docs: DataFrame) -> DataFrame:
    """(doc, ok): brackets close outside of comments and literals, braces in order."""
    ship(docs.sparkSession)
    return docs.select("doc", lexing.balanced_source(F.col("text")).alias("ok"))


def test_items(docs: DataFrame) -> DataFrame:
    """(doc, pos, item, is_test): the items at the top of each source."""
    fields = {"pos": (T.IntegerType(), pa.int32()), "item": (T.StringType(), pa.string()), "is_test": (T.BooleanType(), pa.bool_())}
    return rows_of(docs, "doc", "text", fields, lambda s: () if s is None else ((k, *item) for k, item in enumerate(lexing.items(s))))


def restored_sources(model: DataFrame, base: DataFrame) -> DataFrame:
    """(doc, text): each model's source with the tests of the base's source of the same doc."""
    ship(model.sparkSession)
    both = model.join(base.select("doc", F.col("text").alias("base")), "doc", "left")
    return both.select("doc", lexing.restored_tests(F.col("text"), F.col("base")).alias("text"))


def sse_streams(events: DataFrame) -> DataFrame:
    """(stream, text, outcome) of server-sent data lines: failed, complete or truncated."""
    data = events.filter(F.col("line").startswith("data:")).withColumn("body", F.trim(F.substring("line", F.lit(6), F.length("line"))))
    j = data.withColumn("e", F.from_json(F.when(F.col("body") != "[DONE]", F.col("body")), "type string, delta string"))
    kind = F.col("e.type")
    out = j.groupBy("stream").agg(
        F.array_sort(F.collect_list(F.when(kind == "response.output_text.delta", F.struct("pos", "e.delta")))).alias("parts"),
        F.bool_or(F.coalesce(kind == "response.completed", F.lit(False))).alias("complete"),
        F.bool_or(F.coalesce(kind.isin("response.failed", "error"), F.lit(False))).alias("failed"),
    )
    return out.select("stream", F.array_join(F.transform("parts", lambda p: p["delta"]), "").alias("text"), F.when(F.col("failed"), "failed").when(F.col("complete"), "complete").otherwise("truncated").alias("outcome"))


#: Events that end a stream.
TERMINAL = ["response.completed", "response.incomplete", "response.failed"]


def terminal_markers(types: list[str] = TERMINAL) -> list[str]:
    """How an event is told: its JSON type, compact or spaced, or an event line."""
    return [form.format(t) for t in types for form in ('"type":"{}"', '"type": "{}"', "\nevent: {}")]


def marker_seen(chunks: DataFrame, markers: list[str], carry: int = 64) -> DataFrame:
    """(stream, seen): one of the markers in the chunks of a stream, over any number of chunks.

    Each chunk is read after the last ``carry`` characters before it, at least the
    longest marker; a stream begins as after a line end. Empty and null chunks add nothing.
    """
    if carry < max(map(len, markers)):
        raise ValueError("carry is shorter than a marker")
    # chunks that are not empty hold a character each, so so many of them hold the carry
    w = Window.partitionBy("stream").orderBy("pos").rowsBetween(-carry, -1)
    held = chunks.withColumn("chunk", F.coalesce("chunk", F.lit(""))).filter("chunk <> ''").withColumn("end", F.right("chunk", F.lit(carry)))
    before = F.right(F.concat(F.lit("\n"), F.array_join(F.collect_list("end").over(w), "")), F.lit(carry))
    whole = held.withColumn("whole", F.concat(before, "chunk"))
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains("whole", F.lit(m))
    seen = whole.withColumn("hit", hit).groupBy("stream").agg(F.bool_or("hit").alias("seen"))
    return chunks.select("stream").distinct().join(seen, "stream", "left").select("stream", F.coalesce("seen", F.lit(False)).alias("seen"))
