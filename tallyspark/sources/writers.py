"""Sinks: appended JSON lines with an audit side, inventories, reports, packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import toml_escape


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append records; those with a capture mismatch go to an audit folder."""
    bad = F.coalesce(F.col("capture_mismatch"), F.lit(False))
    rows.filter(~bad).write.mode("append").json(f"{path}/output")
    rows.filter(bad).write.mode("append").json(f"{path}/audit")


def write_inventory(ids: DataFrame, path: str) -> None:
    """Sorted ids of each key as bz2 text."""
    ids.repartition("key").sortWithinPartitions("key", "test_id").select("key", "test_id").write.mode("overwrite").option("compression", "bzip2").partitionBy("key").text(path)


def markdown_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(value): rows as lines of a Markdown table, without its head."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("value"))


def write_report(rows: DataFrame, path: str) -> None:
    """One report, the form chosen by the suffix: .csv, .json or .md."""
    if path.endswith(".csv"):
        rows.write.mode("overwrite").csv(path, header=True)
    elif path.endswith(".json"):
        rows.write.mode("overwrite").json(path)
    else:
        markdown_table(rows, rows.columns).write.mode("overwrite").text(path)


def flattened(entries: DataFrame) -> DataFrame:
    """Entries with their maps as JSON strings and an id where one is missing."""
    return entries.withColumns({"setup": F.to_json("setup"), "test": F.to_json("test"), "instance_id": F.coalesce("instance_id", F.sha2(F.concat_ws("/", "repo", "base_commit"), 256))})


def toml_lines(rows: DataFrame) -> DataFrame:
    """(key, value): TOML assignments of a table's string columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in rows.columns if c != "task"])
    return rows.select("task", F.explode(pairs).alias("p")).filter("p.v is not null").select("task", F.concat(F.col("p.k"), F.lit(' = "'), toml_escape(F.col("p.v")), F.lit('"')).alias("value"))


def split_constants(entries: DataFrame) -> DataFrame:
    """(split, line): the sorted list of names of each split, as source text."""
    names = F.array_join(F.transform(F.array_sort(F.collect_set("name")), lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ", ")
    return entries.groupBy("split").agg(names.alias("names")).select("split", F.concat(F.upper("split"), F.lit(" = ["), "names", F.lit("]")).alias("line"))


def write_packages(rows: DataFrame, path: str, keys: list[str]) -> None:
    """One folder of JSON for each combination of keys."""
    rows.write.mode("overwrite").partitionBy(*keys).json(path)
