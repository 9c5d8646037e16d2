"""Distinct, winners, version order and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of each key in arrival order."""
    w = Window.partitionBy(*keys).orderBy(pos)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_then_top(rows: DataFrame, keys: list[str], pos: str, score: str, n: int) -> DataFrame:
    """Distinct rows in arrival order, then the n of highest score (ties in arrival order)."""
    return keep_first(rows, keys, pos).orderBy(F.desc(score), pos).limit(n)


def fuzzy_key(name: Column) -> Column:
    """Names alike but for case and separators share a key."""
    return F.btrim(F.regexp_replace(F.lower(name), "[-_./]+", "-"), F.lit("-"))


def duplicate_groups(folders: DataFrame) -> DataFrame:
    """(key, loser, winner): of folders with one fuzzy key the one with most files, then a hyphen, then
    the greatest name wins; one row for each other row of the key."""
    rank = F.struct("files", F.contains("name", F.lit("-")).alias("hyphen"), "name")
    rows = folders.select(fuzzy_key(F.col("name")).alias("key"), "name", rank.alias("rank"))
    # equal rows are counted, so that a key's many copies meet in one row before any window
    counted = rows.groupBy("key", "name", "rank").agg(F.count("*").alias("n"))
    best = counted.groupBy("key").agg(F.max("rank").alias("best"))
    both = counted.join(best, "key").withColumn("times", F.col("n") - (F.col("rank") == F.col("best")).cast("int")).filter("times > 0")
    return both.select("key", F.col("name").alias("loser"), F.col("best.name").alias("winner"), F.explode(F.sequence(F.lit(1), "times")).alias("k")).drop("k")


def distinct_patches(patches: DataFrame) -> DataFrame:
    """(digest, first_pos, n): patches distinct by content, at their first place."""
    return patches.groupBy(F.sha2("patch", 256).alias("digest")).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


def version_key(version: Column) -> Column:
    """Numeric parts of a version as an array, which orders as versions do."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^\d+", 0).try_cast("int"), F.lit(0)))


def alias_keys(rows: DataFrame) -> DataFrame:
    """(alias, pos): every name by which a row is known, at its first place."""
    names = F.array_distinct(F.array_compact(F.array("instance_id", "repo", "original_repo", F.element_at(F.split("repo", "/"), -1))))
    return rows.select("pos", F.explode(names).alias("alias")).groupBy("alias").agg(F.min("pos").alias("pos"))


def narrowed(a: Column, b: Column, c: Column) -> Column:
    """a, narrowed to b and then to c wherever that leaves something."""
    ab = F.when(F.size(F.array_intersect(a, b)) > 0, F.array_intersect(a, b)).otherwise(a)
    return F.when(F.size(F.array_intersect(ab, c)) > 0, F.array_intersect(ab, c)).otherwise(ab)
