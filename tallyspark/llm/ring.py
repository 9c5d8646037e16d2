"""Operator 6: sharding on a consistent-hash ring with bounded loads.

Texts hash to places on a ring of SLOTS slots, virtual nodes of the shards stand
on it, and a text goes to the next virtual node clockwise whose shard still has
room. Room is the bound: with the slack 0 the counts differ by one at most.
Equal texts share a place, so they fill neighbouring shards together.

Spark counts the rows of each slot; the bounded table of slots is dealt to shards
on the driver, as ranges of ranks; ranks in a slot come from windows over at most
about the square root of the slot's rows.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of the ring and virtual nodes of a shard: they bound what the driver holds.
SLOTS, VIRTUAL = 4096, 40


def virtual_nodes(shards: int, slots: int = SLOTS, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, clockwise."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()) % slots, s) for s in range(shards) for v in range(virtual))


def room(rows: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may take: at slack 0 exactly all rows fit, counts at most one apart."""
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def deal(counts: dict[int, int], shards: int, slack: float = 0.0, slots: int = SLOTS) -> list[tuple[int, int, int, int, int]]:
    """(slot, low, high, shard, base): the ranks low to high - 1 of a slot go to the
    shard, from its place ``base`` on. Full shards are passed over clockwise."""
    nodes = virtual_nodes(shards, slots)
    left, filled = room(sum(counts.values()), shards, slack), [0] * shards
    plan, first = [], 0
    for slot in range(slots):
        while first < len(nodes) and nodes[first][0] < slot:
            first += 1
        low, at, n = 0, first, counts.get(slot, 0)
        while low < n:
            shard = nodes[at % len(nodes)][1]
            if take := min(left[shard], n - low):
                plan.append((slot, low, low + take, shard, filled[shard]))
                left[shard] -= take
                filled[shard] += take
                low += take
            at += 1
    return plan


def place(text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(slots)).cast("int")


def shard_rows(df: DataFrame, key_col: str, place_col: Column, shards: int = 24, slack: float = 0.0) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (a gapless long from 0 in the shard).

    ``place_col`` is the ring slot of a row; rows of one slot are dealt in the
    order of a hash of ``key_col``. Null keys and repeated rows are rows like any
    other; an empty table gives an empty one; columns named shard or slot are
    replaced, others pass whatever their names.
    """
    spark = df.sparkSession
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    # all columns of a row in one, so that no work column can clash
    rows = df.select(F.struct(*others).alias("row"), place_col.alias("ring"), F.xxhash64(F.col(f"`{key_col}`")).alias("h"))
    counts = {r["ring"]: r["count"] for r in rows.groupBy("ring").count().collect()}
    # both tables are bounded by SLOTS and the shards
    plan = spark.createDataFrame(deal(counts, shards, slack), "ring int, low long, high long, shard int, base long")
    buckets = spark.createDataFrame([(s, math.isqrt(n - 1) + 1) for s, n in counts.items()], "ring int, buckets int")

    rows = rows.join(F.broadcast(buckets), "ring").withColumn("bucket", F.pmod("h", "buckets").cast("int"))
    sizes = rows.groupBy("ring", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("ring").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("ring", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("ring", "bucket").orderBy("row")) - 1
    ranked = rows.withColumn("inside", inside).join(starts, ["ring", "bucket"]).withColumn("rank", F.col("start") + F.col("inside"))
    out = ranked.join(F.broadcast(plan), "ring").filter("rank >= low and rank < high")
    return out.select("row.*", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The contract under the law ``rows``: counts of the shards are at most one apart."""
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        place(text).alias("ring"),
    )
    out = shard_rows(rows, "doc_id", F.col("ring"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
