"""Runner output cut to what matters: sections of each runner, budgets, and stubs in sources.

Every function takes (doc, text), one row a document, and gives one row a document
(``stubs``: one a stub). A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.arrays import let, running
from tallyspark.functions.text import strip_ansi
from tallyspark.operators.windows import repeated_errors

#: How the runners word their totals, in the order of the sections.
CPP_TOTALS = (r"\[ *==+ *\] *[0-9]+ tests? from\b.*", "test cases:.*", "assertions:.*", r"\b[0-9]+ tests? ran\b.*", "All tests passed.*")
CPP_CHECKS = r"(?i:expected:|actual:)|REQUIRE\(|CHECK\(|EXPECT_|ASSERT_"
#: For each JavaScript runner the lines that open a failure, that end it, that state
#: a comparison, that begin a total, and what identifies an error.
JS_RUNNERS = {
    "js": {
        "opens": r"^\s*(FAIL |● |✗ |× )",
        "ends": r"^\s*(PASS |✓ |Test Suites:|Tests )",
        "checks": r"expect\(|toBe\(|toEqual\(|Expected:|Received:|AssertionError|assert\.strictEqual",
        "totals": r"^\s*(Test Suites:|Tests:|Snapshots:|Time:|Ran all test suites|tests|passing|failing)",
        "error": r"(Error:\s*.{0,500})",
    },
    "ts": {
        "opens": r"^\s*(FAIL |● )",
        "ends": r"^\s*(PASS |Test Suites:)",
        "checks": r"expect\(|toBe\(|toEqual\(|Expected:|Received:|AssertionError",
        "totals": r"^\s*(Test Suites:|Tests:|Snapshots:|Time:|Ran all test suites)",
        "error": r"(TS\d{4}:\s*.+)",
    },
}
#: What a stub holds, and the line that declares a function.
STUBS = {
    "c": ("STUB_PANIC", r"^\s*(?:(?:static|inline|extern)\s+)*[\w\s*]+?\b(\w+)\s*\([^;]*\)\s*\{?\s*$"),
    # a receiver in parentheses, the name, type parameters
    "go": ('"STUB: not implemented"', r"^func[ \t]*(?:\([^()]*\)[ \t]*)?([\pL_][\pL\pN_]*)[ \t]*[(\[]"),
}
#: Comparisons and compiler errors of a C++ log, unless asked otherwise.
CHECKS, ERRORS = 50, 30
CUT = "\n\n... [truncated] ...\n\n"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _matching(lines: Column, pattern: str, most: int | None = None) -> Column:
    """The lines that hold a pattern as one section; null if there are none."""
    found = F.filter(lines, lambda x: x.rlike(pattern))
    found = found if most is None else F.slice(found, 1, most)
    return F.nullif(F.array_join(found, "\n"), F.lit(""))


def _from(lines: Column, start: Column) -> Column:
    """The lines from a place on, counted from 0; all of them for null."""
    return F.slice(lines, F.coalesce(start, F.lit(0)) + 1, F.greatest(F.size(lines), F.lit(1)))


def _first(lines: Column, pattern: str) -> Column:
    """The place of the first line with a pattern, or null."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), F.lit(True))
    return F.when(at > 0, at.cast("int") - 1)


def _joined(sections: list[Column], text: Column) -> Column:
    """Sections with an empty line between, or the text where there are none."""
    return F.coalesce(F.nullif(F.concat_ws("\n\n", *sections), F.lit("")), text)


def cpp_sections(text: Column, checks: int | None = CHECKS, errors: int | None = ERRORS) -> Column:
    """Failures, totals, comparisons and compiler errors of a GTest, Catch2 or Boost log; of the
    last two the first ``checks`` and ``errors``, all of them for None."""

    def start(lines: Column) -> Column:
        ran, counted = _first(lines, r"^(\[\s*=+\s*\]\s*Running|~~~+)"), _first(lines, "(?i)test cases|assertions")
        # counts stand at the end, so some lines before them are kept
        return F.when(ran.isNotNull() & (counted.isNull() | (ran <= counted)), ran).otherwise(F.greatest(counted - 5, F.lit(0)))

    def sections(lines: Column) -> Column:
        whole = F.array_join(lines, "\n")
        totals = [F.transform(F.regexp_extract_all(whole, F.lit(f"(?i)({p})"), F.lit(1)), lambda x: F.trim(x)) for p in CPP_TOTALS]
        return _joined([_matching(lines, r"^\s*\[\s*FAILED\s*\]"), F.concat(*totals), _matching(lines, CPP_CHECKS, checks), _matching(lines, r"^\s*error:|: error:", errors)], whole)

    return let(_lines(text), lambda a: let(_from(a, start(a)), sections))


def cargo_sections(text: Column) -> Column:
    """The list of failures, the first result line and the compiler errors of a cargo log."""

    def sections(lines: Column) -> Column:
        whole = F.array_join(lines, "\n")
        part = lambda p: F.nullif(F.trim(F.regexp_extract(whole, p, 1)), F.lit(""))
        failures = F.nullif(F.regexp_replace(F.regexp_extract(whole, r"(?s)(failures:\s*\n.*?)(?=test result:|\z)", 1), r"^\s+|\s+\z", ""), F.lit(""))
        return _joined([failures, part("(test result: .+)"), _matching(lines, r"^error\[E\d+\]")], whole)

    return let(_lines(text), lambda a: let(_from(a, _first(a, r"^running \d+ test")), sections))


def js_sections(text: Column, runner: str) -> Column:
    """Blocks of failures, comparisons and totals of a Jest, Vitest, Mocha or node:test log, with repeated errors."""
    rules = JS_RUNNERS[runner]

    def blocks(lines: Column) -> Column:
        blank = lambda x: F.trim(x) == ""
        mark = lambda x, k: F.when(x.rlike(rules["opens"]), True).when(x.rlike(rules["ends"]) | (blank(x) & (k > 0) & blank(F.get(lines, k - 1))), False)
        # the last mark up to a line says whether it is in a block
        state = running(F.transform(lines, mark), lambda a, b: F.coalesce(b, a))
        inside = let(state, lambda s: F.filter(lines, lambda x, k: F.coalesce(F.get(s, k), F.lit(False))))
        return F.when(F.size(inside) > 0, F.array_join(inside, "\n"))

    failed = rf"{rules['totals']}|^(?=.*failed)(?=.*(?i:test|suite))"
    return let(_lines(text), lambda a: _joined([blocks(a), _matching(a, rules["checks"]), _matching(a, failed)], F.array_join(a, "\n")))


def _without_repeats(texts: DataFrame, error: str) -> DataFrame:
    """Texts whose repeated errors are gone, with a closing line that counts them."""
    key = F.trim(F.regexp_extract("text", error, 1))
    lines = texts.select("doc", F.posexplode(_lines(F.col("text"))).alias("pos", "text")).withColumn("key", F.nullif(key, F.lit("")))
    kept = repeated_errors(lines, ["doc"], "pos", "key").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("kept"))
    counts = lines.groupBy("doc").agg(F.count("key").alias("errors"), F.countDistinct("key").alias("kinds"))
    body = F.array_join(F.transform("kept", lambda x: x["text"]), "\n")
    note = F.when(F.col("errors") > F.col("kinds"), F.format_string("\n\n[%d duplicate error(s) removed. %d unique error(s) remain.]", F.col("errors") - F.col("kinds"), "kinds")).otherwise("")
    return kept.join(counts, "doc").select("doc", F.concat(body, note).alias("text"))


def sections(docs: DataFrame, runner: str, checks: int | None = CHECKS, errors: int | None = ERRORS) -> DataFrame:
    """(doc, text): the parts of each log that tell what failed; the whole log where nothing does.

    ``runner`` is cpp, cargo, js or ts; ``checks`` and ``errors`` are those of cpp. Ids must not repeat.
    """
    text = F.coalesce("text", F.lit(""))
    if runner in JS_RUNNERS:
        return _without_repeats(docs.select("doc", js_sections(strip_ansi(text), runner).alias("text")), JS_RUNNERS[runner]["error"])
    return docs.select("doc", (cpp_sections(text, checks, errors) if runner == "cpp" else cargo_sections(text)).alias("text"))


def summaries(docs: DataFrame, runner: str, most: int = 15_000, side: int = 2_000, checks: int | None = CHECKS, errors: int | None = ERRORS) -> DataFrame:
    """(doc, tier, text): a log within a budget of ``most`` characters is whole (tier 0), else its
    sections (1), else the ends of the sections (3). Four characters count as a token; tier 2
    would ask a model."""
    text = F.coalesce("text", F.lit(""))
    raw = docs.select("doc", (strip_ansi(text) if runner in JS_RUNNERS else text).alias("raw"))
    fits = lambda c: F.floor(F.length(c) / 4) <= most // 4
    short = F.concat(F.substring("text", 1, side), F.lit(CUT), F.right("text", F.lit(side))) if most >= 2 * side + 40 else F.substring("text", 1, most)
    return raw.join(sections(docs, runner, checks, errors), "doc").select(
        "doc",
        F.when(fits("raw"), 0).when(fits("text"), 1).otherwise(3).alias("tier"),
        F.when(fits("raw"), F.col("raw")).when(fits("text"), F.col("text")).otherwise(short).alias("text"),
    )


def stubs(docs: DataFrame, language: str) -> DataFrame:
    """(doc, name, line, signature): functions that hold a stub, each once; lines count from 1.

    A stub belongs to the nearest declaration above; one without any is passed over.
    """
    marker, declared = STUBS[language]
    w = Window.partitionBy("doc").orderBy("line")
    rows = docs.select("doc", F.posexplode(_lines(F.col("text"))).alias("at", "code")).withColumn("line", F.col("at") + 1)
    own = F.when(F.col("code").rlike(declared), F.struct(F.regexp_extract("code", declared, 1).alias("name"), "line", F.rtrim("code").alias("signature")))
    found = rows.withColumn("own", F.last(own, ignorenulls=True).over(w)).filter(F.col("code").contains(marker) & F.col("own").isNotNull())
    return found.select("doc", "own.*").distinct()
