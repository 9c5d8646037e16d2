"""Operator 5: document fingerprints as bottom-k sketches of shingle hashes.

A sketch holds the SKETCH smallest distinct hashes of the word shingles of a
text. Sketches of parts merge into that of the whole and estimate resemblance,
containment and the number of distinct shingles. Only DataFrame functions run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyspark.llm.lambdas import let, shingle_hashes, words

#: Hashes in a sketch and words in a shingle.
SKETCH, WIDTH = 128, 5

#: Bound of the ranges that rows are put in order in, and keys sampled for each.
PARTS, SAMPLE = 16_384, 16


def sketch(text: Column, k: int = SKETCH, width: int = WIDTH) -> Column:
    """Sorted array of the k smallest distinct shingle hashes; null and wordless texts give []."""
    hashes = shingle_hashes(words(F.coalesce(text, F.lit(""))), width)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard likeness: the share of the k smallest hashes of both that both
    hold. Exact when neither sketch is full; two empty sketches are alike (1.0)."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    top = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of a's shingles that b holds; 1.0 for an empty a."""
    both = distinct_shingles(merge(a, b, k), k) * resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    """A sketch as text: base64 of its hashes, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def ranges(keys: DataFrame, most: int = PARTS) -> list[int]:
    """Bounds that cut the distinct ``key`` arrays into about equal ranges, one after the other.

    About the square root of the rows, ``most`` at most; they come from a sample of
    about SAMPLE keys a range, which is all that reaches the driver.
    """
    rows = keys.count()
    parts = max(1, min(most, math.isqrt(rows)))
    share = min(1.0, SAMPLE * parts / max(1, rows))
    picked = keys.filter(F.shiftrightunsigned(F.xxhash64("key", F.lit("sample")), 24) < int(share * 2**40)).select("key").distinct()
    found = sorted(r["key"] for r in picked.collect())
    cuts = sorted({len(found) * i // parts for i in range(1, parts)} - {0})
    return [x for i in cuts for x in found[i]]


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds up to a key, by binary search."""
    n = len(bounds) // 3
    if not n:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        below = (acc["lo"] < acc["hi"]) & (F.slice(table, mid * 3 + 1, F.lit(3)) <= key)
        return F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, step, lambda acc: acc["lo"])


def with_next(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """Rows (doc_id, text, key, part, guard) and the window in which each one's next document follows.

    Rows stand in the order of their ids, nulls first, and of one id in that of a
    hash of the text. They are dealt to ranges of about equal size; behind the last
    row of a range stands, as a guard row, a copy of the first of the next range (of
    the last range: of the first), so each text crosses one shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.array(F.col("doc_id").isNotNull().cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(text))
    texts = docs.select("doc_id", text.alias("text"), key.alias("key"))
    rows = texts.withColumn("part", range_of(F.col("key"), ranges(texts.select("key"))))
    by_part = Window.orderBy("part")
    firsts = rows.groupBy("part").agg(F.min("key").alias("first"))
    everywhere = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("part", F.coalesce(F.lead("first").over(by_part), F.first("first").over(everywhere)).alias("key"))
    # PARTS rows at most, of three numbers each
    guards = texts.join(F.broadcast(following), "key").dropDuplicates(["part"]).select("doc_id", "text", "key", "part", F.lit(1).alias("guard"))
    return rows.withColumn("guard", F.lit(0)).unionByName(guards), Window.partitionBy("part").orderBy("guard", "key")


def fingerprints(docs: DataFrame, k: int = SKETCH, width: int = WIDTH) -> DataFrame:
    """The contract: fingerprints of each text and of its edited text, one row for each row.

    Null texts count as empty. Null ids stand before all others; rows of one id
    follow each other in the order of a hash of the text, so of rows that repeat all
    but the last have their own text next. An empty table gives an empty one; only
    doc_id and text are read.
    """
    rows, w = with_next(docs)
    # the window is the same twice: the sketches are made behind the only shuffle
    rows = rows.withColumn("n", F.length("text")).withColumn("after", F.lead("text").over(w))
    rows = rows.withColumn("own", sketch(F.col("text"), k, width)).withColumn("next", F.lead("own").over(w)).filter("guard = 0")
    edited = F.expr("concat(substring(text, 1, n - n div 4), substring(after, 1, n div 4))")
    both = rows.select("doc_id", "n", "own", "next", edited.alias("edited"))
    both = both.select("doc_id", "n", F.sha2("edited", 256).alias("edited_sha256"), "own", "next", sketch(F.col("edited"), k, width).alias("after"))
    return both.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("after")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("after"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("n_shingles"),
    )
