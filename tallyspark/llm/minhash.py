"""Operator 3: MinHash near-duplicates with tensored banding.

Two collections of m band hashes, each over a few minhashes, are combined in
pairs: m * m table keys for 2 * m bands, so the minhashes needed are about the
square root of those that independent tables would take. Documents that share a
key are candidates; links are confirmed on full shingle sets.

Equal sets are grouped first and only one of each goes on. In a table key the
members are compared with the key's most connected document, whose links join
most of them; members of different components are then all compared, row by row
or, where they are many, in blocks of bounded size. So a group of n near copies
costs about n compared rows, and no link that joins components is left out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.bpe import list_array
from tallyspark.llm.common import Memo, with_arrow
from tallyspark.llm.components import components
from tallyspark.sources.shared import Scratch

#: Band hashes in each of the two collections, and minhashes in a band hash. At
#: likeness 0.8 a pair shares no key with probability 2 * (1 - 0.8**3)**12 = 0.0004.
BANDS, ROWS = 12, 3

#: Up to so many pairs the outsiders of a component are compared with it row by row;
#: beyond, in blocks of so many documents and shingles a side. Both ways are exact.
SMALL_POOL, BLOCK, BLOCK_SHINGLES = 20_000, 2_000, 1_000_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two multiply and shift steps."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


@lru_cache(maxsize=1)
def word_memo() -> Memo:
    return Memo(word_hash, 50_000)


@lru_cache(maxsize=8)
def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z become lower case; words are what space, tab, LF, VT, FF and CR separate.
    Fewer than ``width`` words make one shingle, no word an empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if n < width:
        return np.array([word_hash(b" ".join(words))], dtype=np.uint64)
    h = np.fromiter(map(word_memo().__getitem__, words), dtype=np.uint64, count=n)
    k = multipliers(width, 5)
    total = h[: n - width + 1] * k[0]
    for j in range(1, width):
        total = total + mix(h[j : n - width + 1 + j]) * k[j]
    return np.unique(mix(total))


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """The 2 * BANDS band hashes of a set: first the one collection, then the other."""
    n = 2 * BANDS * ROWS
    a, b = multipliers(n, 11), multipliers(n, 12)
    low = np.full(n, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[None, at : at + 2048] * a[:, None] + b[:, None]).min(axis=1))
    low = mix(low).reshape(2 * BANDS, ROWS)
    return mix((low * multipliers(ROWS, 13)[None, :]).sum(axis=1, dtype=np.uint64) + multipliers(2 * BANDS, 14))


def sketches(docs: DataFrame, keep: list[str], text_col: str, width: int) -> DataFrame:
    """Columns ``keep``, n_shingles, set_key, bands: set_key is equal for equal sets only (128 bits)."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            sets = [shingle_set(t, width) for t in texts.to_pylist()]
            return [
                pa.array([len(s) for s in sets], type=pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], type=pa.binary()),
                list_array([band_hashes(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets], pa.int64()),
            ]

        return work

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return with_arrow(docs, text_col, fields, make, keep=keep)


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, shingles): the full set of each document as 64-bit hashes."""

    def make():
        return lambda texts: [list_array([shingle_set(t, width).view(np.int64) for t in texts.to_pylist()], pa.int64())]

    return with_arrow(docs, text_col, [T.StructField("shingles", T.ArrayType(T.LongType()))], make, keep=[id_col])


def table_keys(sketch: DataFrame) -> DataFrame:
    """(node, n, key): every pair of a band hash of one collection and one of the other."""
    first, second = F.slice("bands", 1, BANDS), F.slice("bands", BANDS + 1, BANDS)
    keys = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a, b))))
    return sketch.select("node", "n", F.explode(keys).alias("key"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` (u, v, distinct) whose full sets are alike enough.

    v may be a hub with very many pairs: the first join, on v, moves only ids on
    that side; the sets then travel by u.
    """
    left = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v")), "v")
    both = left.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u")), "u")
    shared = F.size(F.array_intersect("set_u", "set_v"))
    return both.filter(100 * shared >= percent * (F.size("set_u") + F.size("set_v") - shared)).select("u", "v")


def _close(percent: int):
    """Set sizes that likeness ``percent`` does not rule out (exact)."""
    return F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")


def links_between(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two lists of sets that are alike enough, by exact counts of shared elements."""
    a, b = (np.array([len(s) for s in side], dtype=np.int64) for side in (left, right))
    # sets come in the order of unsigned numbers
    left, right = ([np.sort(s) for s in side] for side in (left, right))
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    count = np.zeros((len(left), len(right)), dtype=np.float32)
    # in slabs of elements and of rows, so that no array is larger than the counts are
    for at in range(0, len(common), 2048):
        part = common[at : at + 2048]
        sides = []
        for side in (left, right):
            grid = np.zeros((len(side), len(part)), dtype=np.float32)
            for i, s in enumerate(side):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                k = np.searchsorted(part, s)
                grid[i, k[part[k] == s]] = 1
            sides.append(grid)
        for at_row in range(0, len(left), 256):
            count[at_row : at_row + 256] += sides[0][at_row : at_row + 256] @ sides[1].T
    rows, cols = [], []
    for at in range(0, len(left), 256):
        shared = count[at : at + 256].astype(np.int64)
        i, j = np.nonzero(100 * shared >= percent * (a[at : at + 256, None] + b[None, :] - shared))
        rows.append(i + at)
        cols.append(j)
    return np.concatenate(rows), np.concatenate(cols)


def _in_blocks(queries: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of the ``queries`` with the ``members`` of the same pool, other roots only.

    Both sides are (pool, node, root, n); they are cut into blocks of about BLOCK
    documents and BLOCK_SHINGLES shingles at most, each pair of blocks one group.
    """

    def cuts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("pool").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias(name))

    grid = cuts(queries, "rows").join(cuts(members, "cols"), "pool")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = queries.join(grid, "pool").withColumn("row", place("rows")).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    right = members.join(grid, "pool").withColumn("col", place("cols")).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))

    def side(df: DataFrame):
        # fresh column ids: both sides come from the same tables
        whole = df.select("pool", "row", "col", "node", "root").join(sets, "node")
        return whole.select(*[F.col(c).alias(c) for c in whole.columns]).groupBy("pool", "row", "col")

    def compare(a, b):
        if not len(a) or not len(b):
            return a.iloc[:0][["node"]].rename(columns={"node": "u"}).assign(v=0)
        i, j = links_between(list(a["shingles"]), list(b["shingles"]), percent)
        u, v, other = a["node"].to_numpy()[i], b["node"].to_numpy()[j], a["root"].to_numpy()[i] != b["root"].to_numpy()[j]
        return type(a)({"u": u[other], "v": v[other]})

    return side(left).cogroup(side(right)).applyInPandas(compare, "u long, v long")


def _classes(sketch: DataFrame) -> DataFrame:
    """(node, rep, set_key, n, bands): the distinct sets of ``sketch``, numbered.

    ``rep`` is (no_id, id, h) of a set's first row, h being a hash of its text; the
    numbers rise with it, so the least number of a component is that of its least id.
    """
    found = sketch.filter("n > 0").groupBy("set_key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # a range comes before the next one, and monotonic numbers follow the ranges
    return found.repartitionByRange("rep", "set_key").sortWithinPartitions("rep", "set_key").select(F.monotonically_increasing_id().alias("node"), "rep", "set_key", "n", "bands")


def _late_links(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) between documents that share a key and are in different components so far.

    In each key all components but the largest one are outsiders; an outsider is
    compared with all members of its keys. Few pairs go row by row. The many of one
    largest component go in blocks: of each key by itself, or, where its keys hold
    the same documents again and again, of the component and all its outsiders.
    """
    linked = members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    per_key = linked.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = per_key.groupBy("key").agg(F.max(F.struct("size", (-F.col("root")).alias("back"))).alias("most"), F.count("*").alias("roots"), F.sum("size").alias("all"))
    counts = largest.filter("roots > 1").select("key", (-F.col("most.back")).alias("major"), "all", (F.col("all") - F.col("most.size")).alias("out"))
    mixed = scratch.saved(linked.join(counts, "key"))
    attached = scratch.saved(mixed.filter("root <> major").select("node", "n", "root", "major").distinct())
    inside = roots.groupBy(F.col("root").alias("major")).agg(F.count("*").alias("inside"))
    pools = attached.groupBy("major").agg(F.count("*").alias("outside")).join(inside, "major", "left")
    pools = pools.join(mixed.select("key", "major", "all", "out").distinct().groupBy("major").agg(F.sum(F.col("all") * F.col("out")).alias("by_keys")), "major")
    as_one = F.col("outside") * (F.coalesce("inside", F.lit(1)) + F.col("outside"))
    large = scratch.saved(pools.select("major", (F.col("by_keys") < as_one).alias("split"), F.least("by_keys", as_one).alias("pairs")).filter(F.col("pairs") > SMALL_POOL).select("major", "split"))

    few = mixed.join(large.select("major"), "major", "left_anti")
    ours = few.filter("root <> major").select("key", F.col("node").alias("u"), "n", F.col("root").alias("root_u"))
    theirs = few.select("key", F.col("node").alias("v"), F.col("n").alias("m"), F.col("root").alias("root_v"))
    left = ours.join(theirs, "key").filter("root_u <> root_v").filter(_close(percent))
    left = left.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    columns = ["pool", "node", "root", "n"]
    split, whole = large.filter("split").select("major"), large.filter("not split").select("major")
    by_key = mixed.join(split, "major").withColumn("pool", F.col("key"))
    outsiders = attached.join(whole, "major").withColumn("pool", F.col("major")).select(*columns)
    # all of the component; one without any link is in no row of ``roots``
    sizes = members.groupBy("node").agg(F.max("n").alias("n"))
    inner = sizes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(whole, F.col("root") == F.col("major")).withColumn("pool", F.col("major")).select(*columns)
    queries = outsiders.unionByName(by_key.filter("root <> major").select(*columns))
    pool = inner.unionByName(outsiders).unionByName(by_key.select(*columns))
    return verified(left, sets, percent).unionByName(_in_blocks(queries, pool, sets, percent))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept, text_hash, first_of_group.

    Documents are linked when 100 * intersection >= percent * union of their sets
    of distinct ``width``-word shingles; component_id is the smallest id reachable,
    kept marks it. first_of_group marks the rows of one (id, text_hash) of each
    component, text_hash being xxhash64 of the text (null: empty).

    Null, empty and wordless texts have n_shingles 0 and stand alone; repeated rows
    and equal texts share a component; an empty table gives an empty one; other
    columns are not read. Ids may repeat with different texts, which are documents
    of their own. Rows without an id come last: component_id is null where no member
    has one, and kept then marks them all.
    """
    scratch, lasting = Scratch(docs.sparkSession, "near"), Scratch(docs.sparkSession, "near-out", lasting=True)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketch = scratch.saved(sketches(texts, ["id", "h"], "text", width).withColumnRenamed("n_shingles", "n"))
    distinct = scratch.saved(_classes(sketch))

    keys = table_keys(distinct)
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    # members of the keys that are shared; degree: how often a document meets others
    members = scratch.saved(keys.join(shared, "key").select("key", "node", "n", "c"))
    degrees = members.groupBy("node").agg(F.sum("c").alias("degree"))
    members = scratch.saved(members.join(degrees, "node").select("key", "node", "n", "degree"))
    wanted = distinct.join(degrees.select("node"), "node", "left_semi").select("node", F.col("rep.id").alias("id"), F.col("rep.h").alias("h"))
    same = texts["h"].eqNullSafe(wanted["h"]) & texts["id"].eqNullSafe(wanted["id"])
    sets = scratch.saved(full_sets(texts.join(wanted, same).select("node", "text"), "node", "text", width).dropDuplicates(["node"]))

    rank = F.struct("degree", (-F.col("node")).alias("back"))
    hubs = members.groupBy("key").agg(F.max(rank).alias("top"), F.max_by("n", rank).alias("m")).select("key", (-F.col("top.back")).alias("v"), "m")
    pairs = members.join(hubs, "key").filter("node <> v").filter(_close(percent)).select(F.col("node").alias("u"), "v").distinct()
    edges = scratch.saved(verified(pairs, sets, percent))
    roots = scratch.saved(components(edges, scratch))
    edges = scratch.saved(edges.unionByName(_late_links(members, roots, sets, percent, scratch)))
    roots = scratch.saved(components(edges, scratch))

    by_class = distinct.join(roots, "node", "left").select("set_key", "node", F.coalesce("root", "node").alias("root"))
    ids = distinct.select(F.col("node").alias("root"), F.col("rep.id").alias("component"), F.col("rep.h").alias("root_h"))
    by_class = by_class.join(ids, "root").withColumn("head", F.col("node") == F.col("root")).select("set_key", "component", "root_h", "head")
    out = sketch.select("id", "h", "n", "set_key").join(by_class, "set_key", "left")
    alone = F.col("n") == 0
    out = out.withColumn("component_id", F.when(alone, F.col("id")).otherwise(F.col("component")))
    first = alone | F.col("head") & F.col("id").eqNullSafe(F.col("component")) & (F.col("h") == F.col("root_h"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("h").alias("text_hash"), first.alias("first_of_group"))
    done = lasting.saved(out)
    scratch.clear()
    return done


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of least id.

    Rows equal in id and text count as one document, and one of them stays; texts
    without a word are linked with nothing and stay, an empty one also beside a null
    one. All columns pass.
    """
    handle = "_hash"
    while handle in docs.columns or handle + "_null" in docs.columns:
        handle = "_" + handle
    firsts = near_components(docs, id_col, text_col, width, percent).filter("first_of_group").select(F.col(f"`{id_col}`").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    rows = docs.withColumn(handle, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    same = rows[id_col].eqNullSafe(firsts["_id"]) & (rows[handle] == firsts["_h"])
    kept = rows.join(firsts, same, "left_semi").withColumn(handle + "_null", F.col(f"`{text_col}`").isNull())
    return kept.dropDuplicates([id_col, handle, handle + "_null"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The contract: pairs of words, 80 in 100."""
    return near_components(docs, width=2, percent=80).drop("text_hash", "first_of_group")
