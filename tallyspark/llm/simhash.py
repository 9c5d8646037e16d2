"""Operator 12: SimHash near-dedup with multi-index hashing.

A fingerprint of 64 bits is cut into segments. Two fingerprints of at most RADIUS
differing bits are close in one segment at least, by the pigeonhole principle: so a
table of segment values is looked up with every value of the small Hamming ball
around a segment, and the matches are verified over all 64 bits.

Equal fingerprints are one node. Each segment value's most frequent fingerprint is
compared with the others first, which joins most copies; after that only matches in
different components are kept, so a group of many copies costs few links.
Values that many fingerprints share are looked up with a second segment as well.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import with_arrow
from tallyspark.llm.components import components
from tallyspark.sources.shared import Scratch

#: Words of a shingle, seed of its hash, and differing bits of a link.
WIDTH, SEED, RADIUS = 4, 42, 4

#: The segments, as (first bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))

#: A segment value of more fingerprints is looked up together with a second segment. Both ways are exact.
CROWD = 1024

#: Shingles whose bits are counted at once.
COUNT_AT_ONCE = 32_768


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each WIDTH-word shingle of a text, repeats included; of none an empty array."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(words)
    if len(words) <= WIDTH:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -WIDTH] + 1]).tolist()
    of = xxhash.xxh64_intdigest
    return np.array([of(whole[a:b], SEED) for a, b in zip(starts, ends[WIDTH - 1 :].tolist())], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have, as a signed 64-bit number; of no hash 0."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNT_AT_ONCE):
        part = hashes[at : at + COUNT_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """Add the fingerprint of each whole text as a signed 64-bit number; null, empty and wordless texts give 0."""

    def make():
        return lambda texts: [pa.array([simhash(shingle_hashes(t)) for t in texts.to_pylist()], type=pa.int64())]

    return with_arrow(docs, text_col, [T.StructField(out_col, T.LongType())], make, keep)


def ball(bits: int, radius: int) -> list[int]:
    """Every pattern of at most ``radius`` ones in ``bits`` bits."""
    return [sum(1 << i for i in at) for k in range(radius + 1) for at in itertools.combinations(range(bits), k)]


def radii(segments: int, radius: int) -> list[int]:
    """How far to look in each segment: of r = q * segments + a differing bits, one of the
    first a + 1 segments has at most q or one of the others at most q - 1 (-1: do not look)."""
    q, a = divmod(radius, segments)
    return [q if i <= a else q - 1 for i in range(segments)]


def value(fp: Column, segment: tuple[int, int]) -> Column:
    first, bits = segment
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _tagged(tag: int, values: Column) -> Column:
    """A segment value with the segment's number above its bits."""
    return values.bitwiseOR(F.lit(tag << 32))


def _around(fp: Column, tag: int, segment: tuple[int, int], radius: int) -> Column:
    """The tagged values within ``radius`` of a segment."""
    patterns = F.array(*[F.lit(p).cast("long") for p in ball(segment[1], radius)]) if radius >= 0 else F.array().cast("array<bigint>")
    at = _tagged(tag, value(fp, segment))
    return F.transform(patterns, lambda p: at.bitwiseXOR(p))


def _second(fp: Column, key: Column, segments: tuple, radius: int | None) -> Column:
    """Values of the other segments beside the one that ``key`` is tagged with: the own
    ones (``radius`` None) or those near enough once the first segment is."""

    def of(first: int) -> Column:
        others = [i for i in range(len(segments)) if i != first]
        if radius is None:
            return F.array(*[_tagged(i, value(fp, segments[i])) for i in others])
        return F.concat(*[_around(fp, i, segments[i], r) for i, r in zip(others, radii(len(others), radius))])

    tag = F.shiftrightunsigned(key, 32)
    chosen = F.when(tag == 0, of(0))
    for i in range(1, len(segments)):
        chosen = chosen.when(tag == i, of(i))
    return chosen


def tables(nodes: DataFrame, segments: tuple = SEGMENTS) -> DataFrame:
    """(key, fp, docs): each fingerprint under its own value of every segment."""
    own = F.array(*[_tagged(i, value(F.col("fp"), s)) for i, s in enumerate(segments)])
    return nodes.select("fp", "docs", F.explode(own).alias("key"))


def hub_links(table: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of the fingerprints of a segment value with that of most documents there."""
    hubs = table.groupBy("key").agg(F.max(F.struct("docs", "fp")).alias("top"), F.count("*").alias("c")).filter("c > 1").select("key", F.col("top.fp").alias("v"))
    near = table.join(hubs, "key").filter(F.col("fp") != F.col("v")).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= radius)
    return near.select(F.col("fp").alias("u"), "v").distinct()


def ball_links(nodes: DataFrame, table: DataFrame, radius: int, segments: tuple = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) between fingerprints of different ``root`` that are at most ``radius`` apart.

    ``nodes`` and ``table`` carry root. Keys of more than ``crowd`` fingerprints are
    narrowed by a second segment, in which the rest of the differing bits must be few.
    """
    fp = F.col("fp")
    near = [_around(fp, i, s, r) for i, (s, r) in enumerate(zip(segments, radii(len(segments), radius)))]
    looked = nodes.select("fp", "root", F.explode(F.concat(*near)).alias("key"))
    # a key whose fingerprints all are in one component may still meet the balls of others, so none is left out
    crowded = table.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > crowd).select("key", F.lit(True).alias("many"))

    def narrowed(rows: DataFrame, second: Column) -> DataFrame:
        plain = F.array(F.lit(-1).cast("long"))
        return rows.join(crowded, "key", "left").withColumn("key2", F.explode(F.when(F.col("many"), second).otherwise(plain)))

    # bits that differ in the first segment already are spent
    def second_of(left: int) -> Column:
        return _second(fp, F.col("key"), segments, left)

    own = F.when(F.shiftrightunsigned("key", 32) == 0, value(fp, segments[0]))
    for i in range(1, len(segments)):
        own = own.when(F.shiftrightunsigned("key", 32) == i, value(fp, segments[i]))
    spent = F.bit_count(own.bitwiseXOR(F.col("key").bitwiseAND(F.lit((1 << 32) - 1))))
    exact = second_of(radius)
    for k in range(max(radii(len(segments), radius)), 0, -1):
        exact = F.when(spent == k, second_of(radius - k)).otherwise(exact)
    queries = narrowed(looked, exact).select("key", "key2", fp.alias("u"), F.col("root").alias("root_u"))
    stored = narrowed(table, _second(fp, F.col("key"), segments, None)).select("key", "key2", fp.alias("v"), F.col("root").alias("root_v"))
    met = queries.join(stored, ["key", "key2"]).filter((F.col("root_u") != F.col("root_v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: the id, fingerprint (signed 64-bit) and component_id,
    the smallest id reachable over links of at most ``radius`` differing bits.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other;
    repeated rows and equal texts share a component. Rows without an id take part, and
    component_id is null only where no member has one. An empty table gives an empty
    one; other columns are not read, whatever their names.
    """
    scratch, lasting = Scratch(docs.sparkSession, "simhash"), Scratch(docs.sparkSession, "simhash-out", lasting=True)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketch = scratch.saved(fingerprints(rows, "text", "fp", keep=["id"]))
    nodes = scratch.saved(sketch.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("docs")))

    links = scratch.saved(hub_links(tables(nodes), radius))
    roots = scratch.saved(components(links, scratch))
    rooted = scratch.saved(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "docs", F.coalesce("root", "fp").alias("root")))
    table = tables(rooted.withColumn("docs", F.struct("docs", "root"))).select("key", "fp", F.col("docs.root").alias("root"))
    links = scratch.saved(links.unionByName(ball_links(rooted, table, radius)))
    roots = scratch.saved(components(links, scratch))

    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    out = sketch.join(placed.join(least, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")
    done = lasting.saved(out)
    scratch.clear()
    return done


def near_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract: fingerprints as 16 lowercase hex digits."""
    return near_components(docs).withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
