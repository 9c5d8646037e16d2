"""Operator 13: a Merkle manifest of a dataset, with a proof for every row.

Rows are digested to leaves, and the leaves are put in order by ranges of (group,
id). The driver learns of each partition its size and its first and last group, no
more, and answers with the place of its first leaf in its group. With that each
partition builds every complete aligned subtree of its own rows. Only ragged
boundary nodes are shuffled, by their coordinate (group, level, index); the upper
levels are finished there and sent to the partitions that need them as siblings.

The same steps over the groups' roots give the root of all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.lambdas import let
from tallyspark.shipping import ship
from tallyspark.sources.shared import Scratch

#: Nodes that become one node of the next level.
ARITY = 16

#: Leaves of a range: what one task holds, about 100 bytes each.
RANGE_ROWS = 250_000

NODE = "part int, grp string, level int, idx long, total long, digest string"
PROOF = "array<struct<before:string, after:string>>"


def field(c: Column) -> Column:
    """A value in a leaf: its length in bytes, a colon and its text; `-` for null."""
    return let(c.cast("string"), lambda s: F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def sha(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(total: int, level: int) -> int:
    """Nodes on a level of a tree of ``total`` leaves."""
    return -(-total // ARITY**level)


class Segment:
    """The leaves ``start`` to ``start + len(leaves) - 1`` of a group of ``total`` and what stands on them.

    ``levels[l]`` is (first index, digests) of the nodes whose leaves are all here.
    """

    def __init__(self, group: str, start: int, total: int, leaves: list[str]) -> None:
        self.group, self.total, self.levels = group, total, [(start, leaves)]
        while self.levels[-1][1] and width(total, len(self.levels) - 1) > 1:
            self.levels.append(self._above(*self.levels[-1]))

    def _above(self, first: int, nodes: list[str]) -> tuple[int, list[str]]:
        end, whole = first + len(nodes), width(self.total, len(self.levels) - 1)
        low = -(-first // ARITY)
        high = -(-end // ARITY) if end == whole else end // ARITY
        return low, [sha(nodes[ARITY * j - first : ARITY * (j + 1) - first]) for j in range(low, high)]

    def boundary(self) -> Iterator[tuple[int, int, str]]:
        """(level, index, digest) of the nodes under no node built here; the group's root among them."""
        for level, (first, nodes) in enumerate(self.levels):
            low, above = self.levels[level + 1] if level + 1 < len(self.levels) else (0, [])
            for i, node in enumerate(nodes, first):
                if not low <= i // ARITY < low + len(above):
                    yield level, i, node

    def wanted(self) -> set[tuple[int, int]]:
        """(level, run) of every run on the way to the root that is not all here."""
        found = set()
        for level in range(64):
            if width(self.total, level) <= 1:
                break
            first, nodes = self.levels[0]
            ends = first // ARITY**level, (first + len(nodes) - 1) // ARITY**level
            low, above = self.levels[level + 1] if level + 1 < len(self.levels) else (0, [])
            # runs between the two ends are complete
            found |= {(level, i // ARITY) for i in ends if not low <= i // ARITY < low + len(above)}
        return found

    def paths(self, sent: dict[tuple[int, int], str]) -> Iterator[tuple[int, list[tuple[str, str]]]]:
        """(place of the leaf in the segment, the siblings before and after it on each level)."""

        def run(level: int, j: int) -> list[str]:
            first, nodes = self.levels[level] if level < len(self.levels) else (0, [])
            members = range(ARITY * j, min(ARITY * (j + 1), width(self.total, level)))
            return [nodes[i - first] if first <= i < first + len(nodes) else sent[level, i] for i in members]

        def step(level: int, i: int) -> tuple[str, str]:
            members, at = run(level, i // ARITY), i % ARITY
            return "".join(members[:at]), "".join(members[at + 1 :])

        start, leaves = self.levels[0]
        height = next(level for level in range(64) if width(self.total, level) <= 1)
        upper, of = [], -1
        for at in range(len(leaves)):
            i = start + at
            if i // ARITY != of:
                of = i // ARITY
                upper = [step(level, i // ARITY**level) for level in range(1, height)]
            yield at, [step(0, i), *upper] if height else []


def _summary(part: int, rows: Iterator) -> Iterator[tuple]:
    """(partition, first group, its leaves, last group, its leaves, largest group)."""
    first = last = None
    head = here = most = 0
    for r in rows:
        if first is None:
            first = last = r["grp"]
        if r["grp"] != last:
            last, here = r["grp"], 0
        here += 1
        head += last == first
        most = max(most, here)
    if first is not None:
        yield part, first, head, last, here, most


def offsets(summaries: list[tuple]) -> dict[int, tuple[int, int]]:
    """Of each partition: leaves of its first group before it, and of its last group after it."""
    before, after, ordered = {}, {}, sorted(summaries)
    for rows, into, own, other in ((ordered, before, 1, 3), (reversed(ordered), after, 3, 1)):
        group, carried = None, 0
        for s in rows:
            into[s[0]] = carried if s[own] == group else 0
            # a group that fills the partition goes on
            carried = into[s[0]] + s[own + 1] if s[1] == s[3] else s[other + 1]
            group = s[other]
    return {p: (before[p], after[p]) for p in before}


def _segments(place: tuple[int, int], rows: list) -> Iterator[tuple[int, Segment]]:
    """(position of its first row, segment) of a partition's rows, group by group."""
    before, after = place
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end]["grp"] == rows[at]["grp"]:
            end += 1
        start = before if at == 0 else 0
        total = start + end - at + (after if end == len(rows) else 0)
        yield at, Segment(rows[at]["grp"], start, total, [r["digest"] for r in rows[at:end]])
        at = end


def _upper_levels(nodes: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """``nodes`` and all nodes above them, each run hashed where its coordinate is."""
    found = scratch.saved(nodes.select("grp", "level", "idx", "total", "digest"))
    for level in range(64):
        if width(most, level) <= 1:
            break
        runs = found.filter((F.col("level") == level) & (F.col("total") > ARITY**level)).withColumn("run", F.floor(F.col("idx") / ARITY).cast("long"))
        members = F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        made = runs.groupBy("grp", "total", "run").agg(F.sha2(F.array_join(members, ""), 256).alias("digest"))
        made = scratch.saved(made.select("grp", F.lit(level + 1).alias("level"), F.col("run").alias("idx"), "total", "digest"))
        found = found.unionByName(made)
    return found


class Forest:
    """A tree of each group of ``leaves``: (grp, digest, ...), ordered by ``order`` with grp's rows together."""

    def __init__(self, leaves: DataFrame, order: list[str], scratch: Scratch) -> None:
        self.spark, self.scratch, self.names = leaves.sparkSession, scratch, leaves.columns
        ship(self.spark)
        self.schema = leaves.schema
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(leaves.count() / RANGE_ROWS))
        # one RDD for all passes: its sorted ranges are shuffled once, and made again alike when lost
        self.rows = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).rdd
        summaries = self.rows.mapPartitionsWithIndex(_summary).collect()  # one row a partition
        self.places = offsets(summaries)
        places = self.places

        def boundary(part: int, rows: Iterator) -> Iterator[tuple]:
            for _, s in _segments(places.get(part, (0, 0)), list(rows)):
                for level, i, digest in s.boundary():
                    yield part, s.group, level, i, s.total, digest

        def wanted(part: int, rows: Iterator) -> Iterator[tuple]:
            for _, s in _segments(places.get(part, (0, 0)), list(rows)):
                yield part, s.group, -1, -1
                for level, run in s.wanted():
                    yield part, s.group, level, run

        most = max([s[5] for s in summaries] + [s[2] + places[s[0]][0] for s in summaries] + [s[4] + sum(places[s[0]]) for s in summaries], default=0)
        self.most = most
        nodes = self.spark.createDataFrame(self.rows.mapPartitionsWithIndex(boundary), NODE)
        self.nodes = _upper_levels(nodes, most, scratch)
        self.wanted = self.spark.createDataFrame(self.rows.mapPartitionsWithIndex(wanted), "part int, grp string, level int, run long")

    def roots(self) -> DataFrame:
        """(grp, total, digest) of each group."""
        level = F.lit(0)
        for k in range(64):
            if width(self.most, k) <= 1:
                break
            level = level + (F.col("total") > ARITY**k).cast("int")
        return self.nodes.filter(F.col("level") == level).select("grp", "total", "digest")

    def proven(self, tops: DataFrame) -> DataFrame:
        """The leaves with root, top and proof: the siblings before and after on each level,
        then those of ``tops`` (grp, root, top, path), what stands above each group."""
        runs = self.nodes.withColumn("run", F.floor(F.col("idx") / ARITY).cast("long"))
        siblings = self.wanted.filter("run >= 0").join(runs, ["grp", "level", "run"]).select("part", "grp", "level", "idx", "digest", F.lit(None).cast("string").alias("top"), F.lit(None).cast(PROOF).alias("path"))
        above = self.wanted.filter("run < 0").join(tops, "grp").select("part", "grp", F.lit(-1).alias("level"), F.lit(-1).cast("long").alias("idx"), F.col("root").alias("digest"), "top", "path")
        parts, places, names = self.rows.getNumPartitions(), self.places, self.names
        sent = siblings.unionByName(above).rdd.map(lambda r: (r["part"], r)).partitionBy(parts, int)

        def prove(pairs: Iterator) -> Iterator[tuple]:
            for (part, rows), given in pairs:
                known, tops = {}, {}
                for _, r in given:
                    if r["level"] < 0:
                        tops[r["grp"]] = r
                    else:
                        known.setdefault(r["grp"], {})[r["level"], r["idx"]] = r["digest"]
                for at, s in _segments(places.get(part, (0, 0)), rows):
                    top = tops[s.group]
                    rest = [tuple(p) for p in top["path"]]
                    for k, path in s.paths(known.get(s.group, {})):
                        yield *[rows[at + k][c] for c in names], top["digest"], top["top"], path + rest

        # each partition of both sides is one element, so the leaves do not move again
        own = self.rows.mapPartitionsWithIndex(lambda p, it: [(p, list(it))])
        if more := sent.getNumPartitions() - parts:  # few keys make few ranges, and a session may deal more widely
            own = own.union(self.spark.sparkContext.parallelize([(parts + k, []) for k in range(more)], more))
        both = own.zip(sent.mapPartitions(lambda it: [list(it)]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        return self.spark.createDataFrame(both.mapPartitions(prove), f"{columns}, root string, top string, proof {PROOF}")


def manifest(rows: DataFrame, group_col: str, id_col: str, leaf_col: str, keep: list[str] | None = None) -> DataFrame:
    """(group, id, leaf, ``keep``, subroot, root, proof) of each row of ``rows``.

    In a group the leaves ascend by id, nulls first, then by digest; groups ascend
    bytewise, null first. ``proof`` holds for each level, up to the root of all, the
    sibling digests before and after the node, joined. Rows alike in group, id and leaf
    each have a leaf and a proof; an empty table gives an empty one.
    """
    spark, keep = rows.sparkSession, keep or []
    scratch = Scratch(spark, "merkle", lasting=True)
    chosen = [F.col(f"`{group_col}`").alias("g"), F.col(f"`{id_col}`").alias("i"), F.col(f"`{leaf_col}`").alias("digest")]
    kept = [F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)]
    # grp: a group's name that null does not share
    leaves = scratch.saved(rows.select(field(F.col(f"`{group_col}`")).alias("grp"), *chosen, *kept))
    trees = Forest(leaves, ["g", "i", "digest"], scratch)
    names = leaves.groupBy("grp").agg(F.first("g").alias("g"))
    groups = scratch.saved(trees.roots().join(names, "grp").select(F.lit("").alias("grp"), "g", F.col("grp").alias("own"), "digest"))
    forest = Forest(groups, ["g", "digest"], scratch)
    whole = forest.roots().select("grp", F.col("digest").alias("root"), F.col("digest").alias("top"), F.array().cast(PROOF).alias("path"))
    tops = scratch.saved(forest.proven(whole).select(F.col("own").alias("grp"), F.col("digest").alias("root"), "top", F.col("proof").alias("path")))
    done = trees.proven(tops)
    outs = [F.col("g").alias(group_col), F.col("i").alias(id_col), F.col("digest").alias(leaf_col)]
    return done.select(*outs, *[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], F.col("root").alias("subroot"), F.col("top").alias("root"), "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def verified_rows(docs: DataFrame) -> DataFrame:
    """The contract: leaves of the documents by source, proofs, and what tampered texts give."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    touched = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf(*values).alias("leaf"), F.when(touched, leaf(*values[:4], lowered)).alias("tampered"))
    done = manifest(leaves, "source", "doc_id", "leaf", keep=["tampered"])
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), "")
    out = done.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """The same rows by a recursive query over (source, level, index)."""
    crc = "list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({s}, ''), lambda c: ord(c)::ubigint)), lambda c, b: xor(c >> 8, table_of.t[(xor(c, b) & 255)::int + 1]))"
    fields = "|| ".join(f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    of = lambda t: f"sha256({fields} || coalesce(octet_length(encode({t}))::varchar || ':' || {t}, '-'))"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n::ubigint, range(8)::ubigint[]), lambda c, b: case when c & 1 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end))"
    levels = lambda name, base, grp: f"""{name} as (
      select {grp}, 0 as level, idx, digest, count(*) over (partition by {grp}) as width from {base}
      union all
      select {grp}, level + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (any_value(width) + 15) // 16
      from {name} where width > 1 group by {grp}, level, idx // 16
    )"""  # noqa: E731
    # what stands beside a leaf's node on every level, and the proof folded level by level
    steps = lambda name, base, tree, grp: f"""{name} as (
      select b.id, n.level, string_agg(n.digest, '' order by n.idx) filter (n.idx < b.idx >> (4 * n.level)) as before,
        string_agg(n.digest, '' order by n.idx) filter (n.idx > b.idx >> (4 * n.level)) as after
      from {base} b join {tree} n on n.{grp} is not distinct from b.{grp} and n.width > 1 and n.idx // 16 = b.idx >> (4 * n.level + 4)
      group by b.id, n.level
    )"""  # noqa: E731
    return f"""
    with recursive table_of as (select {table} as t), leaves as (
      select row_number() over () as id, doc_id, source, {of("text")} as digest,
        case when xor({crc.format(s="doc_id::varchar")}, 4294967295::ubigint) % 5 = 0 then {of(lowered)} else {of("text")} end as changed
      from documents, table_of
    ), placed as (
      select *, row_number() over (partition by source order by doc_id nulls first, digest) - 1 as idx from leaves
    ), {levels("nodes", "placed", "source")}, subroots as (
      select source, digest, source as own, 0 as one, row_number() over (order by source nulls first) as id, row_number() over (order by source nulls first) - 1 as idx from nodes where width = 1
    ), {levels("tops", "subroots", "one")}, whole as (select digest as root from tops where width = 1),
    {steps("low", "placed", "nodes", "source")}, {steps("high", "subroots", "tops", "one")}, path as (
      select id, level, coalesce(before, '') as before, coalesce(after, '') as after from low
      union all
      select p.id, 100 + h.level, coalesce(h.before, ''), coalesce(h.after, '') from placed p join subroots s on s.source is not distinct from p.source join high h on h.id = s.id
    ), proofs as (
      select id, list({{'before': before, 'after': after}} order by level) as proof from path group by id
    ), folded as (
      select p.doc_id, p.digest as leaf, s.digest as subroot, w.root, coalesce(f.proof, []) as proof,
        list_reduce(list_prepend({{'before': '', 'after': p.changed}}, coalesce(f.proof, [])), lambda a, b: {{'before': '', 'after': sha256(b.before || a.after || b.after)}}).after as folded_root
      from placed p join subroots s on s.source is not distinct from p.source cross join whole w left join proofs f on f.id = p.id
    )
    select doc_id, leaf, subroot, root, sha256(list_reduce(list_prepend('', list_transform(proof, lambda x: x.before || x.after)), lambda a, b: a || b)) as proof_sha256,
      folded_root, folded_root = root as verified
    from folded
    """
