"""Connected components of an undirected edge table, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.shared import Scratch


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root: the smallest node it reaches.

    Alternates large-star and small-star steps. A step takes the minimum per node
    with a partially aggregated ``groupBy`` and joins it back, so a hub with most
    of the edges is never gathered in one task. Nulls, self-loops and repeated
    edges are ignored; an empty table gives an empty one. Rounds are written to ``scratch``.
    """
    named = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = scratch.saved(named.filter("u is not null and v is not null and u <> v").distinct())
    seen = _digest(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.saved(small)
        last, seen = seen, _digest(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
