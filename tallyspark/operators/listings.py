"""Names of tests from what runners and test binaries list; inputs are (doc, text)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tallyspark.functions.text import strip_ansi, strip_prefix
from tallyspark.operators.parsers import lines

#: Endings of test files.
JS_TEST_ENDINGS = [f".{kind}.{end}" for kind in ("test", "spec") for end in ("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts")]


def _named(docs: DataFrame, skipped) -> DataFrame:
    low = F.lower("name")
    rows = lines(docs).withColumn("name", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).filter("name <> ''")
    return rows.filter(~skipped(F.col("name"), low)).select("doc", "pos", F.col("name").alias("test_id"))


def doctest_list(docs: DataFrame) -> DataFrame:
    """(doc, pos, test_id) of ``--list-test-cases``: all lines but the frame."""
    return _named(docs, lambda name, low: low.startswith("[doctest]") | low.startswith("===") | F.contains(low, F.lit("listing")) | name.startswith("-") | name.startswith("test cases:"))


def catch2_list(docs: DataFrame) -> DataFrame:
    """(doc, pos, test_id) of ``--list-tests``: all lines but the frame, the tags and the count."""
    return _named(docs, lambda name, low: low.rlike("^(all available|matching)") | name.rlike(r"^[=\-\[]") | F.contains(low, F.lit("test cases")) & F.contains(name, F.lit(":")))


@udtf(returnType="pos int, test_id string")
class BoostTests:
    """Tests of a Boost listing: four blanks a level, a star after what can be run."""

    def eval(self, text: str) -> Iterator[tuple]:
        suites: list[str] = []
        for pos, line in enumerate((text or "").splitlines()):
            name = line.strip().rstrip("*").strip()
            if not name:
                continue
            del suites[(len(line) - len(line.lstrip())) // 4 :]
            if line.rstrip().endswith("*"):
                yield pos, "/".join([*suites, name])
            else:
                suites.append(name)


def boost_list(docs: DataFrame) -> DataFrame:
    """(doc, pos, test_id) of ``--list_content``: suites and the test below them, joined by slashes."""
    return docs.lateralJoin(BoostTests(F.col("text").outer())).select("doc", "pos", "test_id")


def jest_list(docs: DataFrame, root: str) -> DataFrame:
    """(doc, pos, test_id) of ``--listTests``: files as lines or as a JSON array, below ``root``."""
    plain = docs.select("doc", F.regexp_replace(strip_ansi(F.col("text")), r"^\s+|\s+$", "").alias("text"))
    listed = F.when(F.col("text").startswith("["), F.from_json("text", "array<string>"))
    whole = listed.isNotNull() & ~F.exists(F.coalesce(listed, F.array().cast("array<string>")), lambda p: p.isNull())
    rows = plain.withColumn("listed", F.when(whole, listed))
    path = lambda c: strip_prefix(F.col(c), root).alias("test_id")
    array = rows.filter("listed is not null").select("doc", F.posexplode("listed").alias("pos", "p")).select("doc", "pos", path("p"))
    each = lines(rows.filter("listed is null")).withColumn("p", F.trim("line"))
    ends = F.lit(False)
    for ending in JS_TEST_ENDINGS:
        ends = ends | F.col("p").endswith(ending)
    kept = (F.col("p") != "") & ~F.col("p").rlike("^(Determining|PASS|FAIL) ") & (ends | F.contains("p", F.lit("/")) & ~F.contains("p", F.lit(" ")))
    return array.unionByName(each.filter(kept).select("doc", "pos", path("p")))


def vitest_list(docs: DataFrame, root: str) -> DataFrame:
    """(doc, pos, test_id) of ``list --json``: file and name, whatever stands around the array."""
    array = F.regexp_extract(strip_ansi(F.col("text")), r"(?s)\[.*\]", 0)
    rows = docs.select("doc", F.posexplode(F.from_json(array, "array<struct<name:string,file:string>>")).alias("pos", "e"))
    return rows.filter("e.name <> '' and e.file <> ''").select("doc", "pos", F.concat_ws(" > ", strip_prefix(F.col("e.file"), root), "e.name").alias("test_id"))


def ctest_list(docs: DataFrame) -> DataFrame:
    """(doc, pos, test_id) of ``--show-only=json-v1``."""
    rows = docs.select("doc", F.posexplode(F.from_json("text", "tests array<struct<name:string>>")["tests"]).alias("pos", "e"))
    return rows.filter("e.name <> ''").select("doc", "pos", F.col("e.name").alias("test_id"))
