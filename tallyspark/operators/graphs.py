"""Import order of a graph with cycles, for graphs of any size.

Chains are followed by doubling and leaves are stripped in turn, so a chain or a tree
takes about the logarithm of its length in rounds; only where most nodes import
several others that lie behind each other are the rounds as many as these layers.
Each round is written to the shared folder, until what is left is small.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.shared import Scratch

#: What is left of a graph at so many edges is finished in one step. Both ways are exact.
FINISH = 100_000


def _shuffled(df: DataFrame) -> DataFrame:
    """The right side of a join that is shuffled whatever its size: small tables of every round add up at the driver."""
    return df.hint("merge")


def chase(pointers: DataFrame, compose: Callable[[str, str], list[Column]], scratch: Scratch) -> DataFrame:
    """Follow each pointer (v, to, ...) as far as pointers lead, by doubling.

    ``compose(p, q)`` gives the other columns of p followed by q. A pointer that ends
    on a cycle of pointers stays on it, at least as many steps on as there are pointers.
    """
    others = pointers.columns[2:]
    for _ in range(max(1, math.ceil(math.log2(pointers.count() + 1)))):
        ahead = pointers.select(F.col("v").alias("to"), F.col("to").alias("to_2"), F.struct(*others).alias("q"))
        both = pointers.select("v", "to", F.struct(*others).alias("p")).join(_shuffled(ahead), "to", "left")
        moved = F.col("to_2").isNotNull()
        cells = [F.when(moved, new).otherwise(F.col(f"p.{c}")).alias(c) for c, new in zip(others, compose("p", "q"))]
        pointers = scratch.saved(both.select("v", F.coalesce("to_2", "to").alias("to"), *cells, moved.alias("moved")))
        if pointers.filter("moved").isEmpty():
            return pointers.drop("moved")
        pointers = pointers.drop("moved")
    return pointers


def _singles(edges: DataFrame) -> DataFrame:
    """The nodes with one edge, to another node."""
    return edges.groupBy("u").agg(F.count("*").alias("n"), F.max("v").alias("to")).filter("n = 1 and u <> to").select(F.col("u").alias("v"))


def _kernel(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(edges, found): what is left of ``edges`` (u, v, least) once nodes that are on no
    cycle are stripped and nodes of one edge are passed over, and the least node of each
    cycle that consisted of such nodes alone.

    ``least`` is the least node passed over on the way from u to v.
    """
    found = None
    while True:
        edges = edges.groupBy("u", "v").agg(F.min("least").alias("least"))
        size = edges.count()
        inner = edges.join(_shuffled(edges.select(F.col("v").alias("u")).distinct()), "u", "left_semi")
        inner = scratch.saved(inner.join(_shuffled(edges.select(F.col("u").alias("v")).distinct()), "v", "left_semi").select("u", "v", "least"))
        singles = scratch.saved(_singles(inner))
        if singles.isEmpty():
            if inner.count() == size:
                return inner, found
            edges = inner
            continue
        pointers = inner.join(_shuffled(singles), inner["u"] == singles["v"], "left_semi").select(F.col("u").alias("v"), F.col("v").alias("to"), "least")
        ends = chase(pointers, lambda p, q: [F.least(f"{p}.least", "to", f"{q}.least")], scratch)
        looped = ends.join(_shuffled(singles.withColumnRenamed("v", "to")), "to", "left_semi")
        # a permutation of the nodes of such cycles: each of them is the end of one of its own
        on_cycle = looped.join(_shuffled(looped.select(F.col("to").alias("v")).distinct()), "v", "left_semi")
        least = scratch.saved(on_cycle.filter(F.col("v") == F.least("v", "least")).select(F.col("v").alias("node")))
        found = least if found is None else found.unionByName(least)
        passed = ends.join(_shuffled(looped.select("v")), "v", "left_anti").select("v", F.col("to"), F.col("least").alias("more"))
        rest = inner.join(_shuffled(singles.withColumnRenamed("v", "u")), "u", "left_anti")
        # edges into the cycles found lead nowhere else
        rest = rest.join(_shuffled(looped.select("v")), "v", "left_anti").join(_shuffled(passed), "v", "left")
        over = F.col("to").isNotNull()
        edges = scratch.saved(rest.select("u", F.coalesce("to", "v").alias("v"), F.when(over, F.least("least", "v", "more")).otherwise(F.col("least")).alias("least")))


def _reach(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, f, b): the least node that a node reaches, and the least that reaches it."""
    labels = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().select("node", F.col("node").alias("f"), F.col("node").alias("b"))
    labels = scratch.saved(labels)
    while True:
        ahead = edges.join(_shuffled(labels.select(F.col("node").alias("v"), "f")), "v").groupBy(F.col("u").alias("node")).agg(F.min(F.least("least", "f")).alias("f_2"))
        behind = edges.join(_shuffled(labels.select(F.col("node").alias("u"), "b")), "u").groupBy(F.col("v").alias("node")).agg(F.min(F.least("least", "b")).alias("b_2"))
        new = labels.join(_shuffled(ahead), "node", "left").join(_shuffled(behind), "node", "left")
        f, b = F.least("f", "f_2"), F.least("b", "b_2")
        labels = scratch.saved(new.select("node", f.alias("f"), b.alias("b"), ((f < F.col("f")) | (b < F.col("b"))).alias("moved")))
        still = labels.filter("moved").isEmpty()
        labels = labels.drop("moved")
        if still:
            return labels


def _components(edges: list) -> list[list]:
    """The strongly connected components of rows (u, v, ...), by depth-first search."""
    out: dict = {}
    for e in edges:
        out.setdefault(e.u, []).append(e.v)
    place, low, stack, on, found = {}, {}, [], set(), []
    for start in out:
        if start in place:
            continue
        path = [(start, iter(out[start]))]
        place[start] = low[start] = len(place)
        stack.append(start)
        on.add(start)
        while path:
            node, ahead = path[-1]
            for v in ahead:
                if v not in place:
                    place[v] = low[v] = len(place)
                    stack.append(v)
                    on.add(v)
                    path.append((v, iter(out.get(v, ()))))
                    break
                if v in on:
                    low[node] = min(low[node], place[v])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == place[node]:
                    member, one = None, []
                    while member != node:
                        member = stack.pop()
                        on.discard(member)
                        one.append(member)
                    found.append(one)
    return found


def _heads(edges: list) -> list:
    """The least node of each component with a cycle, nodes passed over on its edges included."""
    of = {n: k for k, c in enumerate(_components(edges)) for n in c}
    least: dict = {}
    for e in edges:
        if of[e.u] == of[e.v]:
            least[of[e.u]] = min(x for x in (least.get(of[e.u]), e.u, e.v, e.least) if x is not None)
    return sorted(least.values())


def _lengths(floors: list[tuple], edges: list) -> list[tuple]:
    """(node, level), in their order, of the pairs (node, floor) and rows (u, v, w) without cycles."""
    level, back, left = dict(floors), {}, {}
    for e in edges:
        back.setdefault(e.v, []).append(e)
        left[e.u] = left.get(e.u, 0) + 1
    ready = [n for n in level if n not in left]
    while ready:
        for e in back.get(v := ready.pop(), ()):
            level[e.u] = max(level[e.u], e.w + level[v])
            left[e.u] -= 1
            if not left[e.u]:
                ready.append(e.u)
    return list(level.items())


def cycle_heads(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node): the least node of each strongly connected component of more than one node."""
    edges = edges.filter("u <> v").select("u", "v", F.lit(None).cast(edges.schema["u"].dataType).alias("least")).distinct()
    found, kind = None, edges.schema["u"].dataType.simpleString()
    while True:
        if edges.count() <= FINISH:
            heads = edges.sparkSession.createDataFrame([(n,) for n in _heads(edges.collect())], f"node {kind}")
            return heads if found is None else found.unionByName(heads).distinct()
        edges, alone = _kernel(edges, scratch)
        found = alone if found is None else found.unionByName(alone) if alone is not None else found
        if edges.isEmpty():
            nodes = edges.select(F.col("u").alias("node"))
            return nodes if found is None else found.distinct()
        labels = _reach(edges, scratch)
        # the node f both reaches and is reached by all with this label: they are one component
        heads = scratch.saved(labels.filter("f = b").select(F.col("f").alias("node")).distinct())
        found = heads if found is None else found.unionByName(heads)
        open_ = labels.filter("f <> b")
        ends = edges.join(_shuffled(open_.select(F.col("node").alias("u"), "f", "b")), "u").join(_shuffled(open_.select(F.col("node").alias("v"), F.col("f").alias("f_2"), F.col("b").alias("b_2"))), "v")
        edges = scratch.saved(ends.filter("f = f_2 and b = b_2").select("u", "v", "least"))


def _layers(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, level) of a graph without cycles: the length of the longest chain of imports."""
    open_ = scratch.saved(nodes.select("node", F.lit(0).cast("long").alias("floor")))
    edges = scratch.saved(edges.select("u", "v", F.lit(1).cast("long").alias("w")))
    done = None
    while True:
        importing = edges.select(F.col("u").alias("node")).distinct()
        settled = scratch.saved(open_.join(_shuffled(importing), "node", "left_anti").select("node", F.col("floor").alias("level")))
        done = settled if done is None else done.unionByName(settled)
        open_ = open_.join(_shuffled(importing), "node", "left_semi")
        if edges.count() <= FINISH:
            # as many nodes at most as the edges have ends
            used = settled.join(_shuffled(edges.select(F.col("v").alias("node")).distinct()), "node", "left_semi").collect()
            above = [(n.node, n.floor) for n in open_.collect()]
            made = _lengths(above + [tuple(n) for n in used], edges.collect())
            kinds = f"node {nodes.schema['node'].dataType.simpleString()}, level long"
            return done.unionByName(edges.sparkSession.createDataFrame(made[: len(above)], kinds))
        # edges to settled nodes become the floor of what imports them
        reached = edges.join(_shuffled(settled.withColumnRenamed("node", "v")), "v", "left")
        floors = reached.groupBy(F.col("u").alias("node")).agg(F.max(F.col("w") + F.col("level")).alias("at_least"))
        open_ = scratch.saved(open_.join(_shuffled(floors), "node", "left").select("node", F.greatest("floor", "at_least").alias("floor")))
        edges = scratch.saved(reached.filter("level is null").groupBy("u", "v").agg(F.max("w").alias("w")))
        singles = _singles(edges)
        pointers = scratch.saved(edges.join(_shuffled(singles), edges["u"] == singles["v"], "left_semi").join(_shuffled(open_.withColumnRenamed("node", "u")), "u").select(F.col("u").alias("v"), F.col("v").alias("to"), "floor", "w"))
        if pointers.isEmpty():
            continue
        # level = max(floor, w + level of the end), and so are two of these one after the other
        ends = chase(pointers, lambda p, q: [F.greatest(F.col(f"{p}.floor"), F.col(f"{p}.w") + F.col(f"{q}.floor")), F.col(f"{p}.w") + F.col(f"{q}.w")], scratch)
        own = ends.select(F.col("v").alias("u"), F.col("to").alias("v"), "w")
        over = ends.select("v", "to", F.col("floor").alias("floor_2"), F.col("w").alias("w_2"))
        rest = scratch.saved(edges.join(_shuffled(ends.select(F.col("v").alias("u"))), "u", "left_anti").join(_shuffled(over), "v", "left").select("u", F.coalesce("to", "v").alias("v"), (F.col("w") + F.coalesce("w_2", F.lit(0))).alias("w"), (F.col("w") + F.col("floor_2")).alias("floor_2")))
        raised = rest.groupBy(F.col("u").alias("node")).agg(F.max("floor_2").alias("at_least")).unionByName(ends.select(F.col("v").alias("node"), F.col("floor").alias("at_least")))
        open_ = scratch.saved(open_.join(_shuffled(raised), "node", "left").select("node", F.greatest("floor", "at_least").alias("floor")))
        edges = scratch.saved(rest.select("u", "v", "w").unionByName(own).groupBy("u", "v").agg(F.max("w").alias("w")))


def import_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, broken) of each distinct node of ``nodes``: level 0 imports nothing, others
    come after all that they import, level k + 1 after one of level k.

    Where imports form cycles, the least node of each strongly connected component
    gives up its imports (``broken``), until no cycle is left. ``edges`` (src imports
    dst); edges with a null or unknown end and those of a node to itself do not count.
    """
    scratch, lasting = Scratch(nodes.sparkSession, "levels"), Scratch(nodes.sparkSession, "levels-out", lasting=True)
    known = scratch.saved(nodes.select("node").filter("node is not null").distinct())
    ends = edges.filter("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    kept = scratch.saved(ends.join(_shuffled(known.withColumnRenamed("node", "u")), "u", "left_semi").join(_shuffled(known.withColumnRenamed("node", "v")), "v", "left_semi").select("u", "v"))
    broken = None
    while True:
        heads = scratch.saved(cycle_heads(kept, scratch))
        broken = heads if broken is None else broken.unionByName(heads)
        if heads.isEmpty():
            break
        kept = scratch.saved(kept.join(_shuffled(heads.withColumnRenamed("node", "u")), "u", "left_anti"))
    layers = _layers(known, kept, scratch)
    marked = broken.distinct().withColumn("broken", F.lit(True))
    done = lasting.saved(layers.join(_shuffled(marked), "node", "left").select("node", "level", F.coalesce("broken", F.lit(False)).alias("broken")))
    scratch.clear()
    return done
