"""Import order with cycles against a plain version of the rule."""

import random

import pytest

from tallyspark.operators import graphs
from tallyspark.sources.shared import Scratch


def plain_levels(nodes, edges):
    """Least node of each strongly connected component gives up its imports, until none is left; by plain reachability."""
    nodes, broken = set(nodes), set()
    out = {n: {d for s, d in edges if s == n and d != n and d in nodes} for n in nodes}

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    while True:
        to = {n: reach(n) for n in nodes}
        heads = {min(m for m in to[n] if n in to[m]) for n in nodes if n in to[n]}
        if not heads:
            break
        broken |= heads
        for n in heads:
            out[n] = set()
    level = {}

    def of(n):
        if n not in level:
            level[n] = 1 + max(map(of, out[n]), default=-1)
        return level[n]

    return {n: (of(n), n in broken) for n in nodes}


def found(spark, nodes, edges):
    df = graphs.import_levels(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long"))
    rows = df.collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: (r.level, r.broken) for r in rows}


def graph(kind, rng):
    if kind == "random":
        return range(1, 25), [(rng.randint(1, 24), rng.randint(1, 24)) for _ in range(40)]
    if kind == "rings":  # pure cycles, tails into them, chords and a bridge
        edges = [(i, i % 7 + 1) for i in range(1, 8)] + [(10 + i, 10 + (i + 1) % 5) for i in range(5)] + [(20, 3), (21, 20), (3, 12), (12, 10), (6, 2), (30, 31), (31, 30)]
        return [*range(1, 8), *range(10, 15), 20, 21, 30, 31, 40], edges
    order = list(range(1, 31))
    rng.shuffle(order)
    edges = [(order[i], order[i // 2]) for i in range(1, 30)] + [(order[i], order[i - 1]) for i in range(1, 30, 3)]
    return order, edges + [(order[0], order[20])] * (kind == "tree with a cycle")


@pytest.mark.parametrize("kind, seed, finish", [("random", 1, 10**5), ("random", 2, 10**5), ("random", 2, 12), ("rings", 3, 10**5), ("tree", 4, 8), ("tree with a cycle", 5, 10**5)])
def test_levels_equal_plain_rule(spark, monkeypatch, kind, seed, finish):
    """Finished at once, and in rounds until few edges are left."""
    monkeypatch.setattr(graphs, "FINISH", finish)
    nodes, edges = graph(kind, random.Random(seed))
    assert found(spark, nodes, edges) == plain_levels(nodes, edges)


def test_awkward_graphs(spark):
    assert found(spark, [1, 1, 2, None], [(1, 1), (1, 2), (1, 2), (1, 99), (None, 1), (2, None)]) == {1: (1, False), 2: (0, False)}
    assert found(spark, [], []) == {}


def test_chain_of_ten_thousand_with_a_cycle_at_its_end(spark, monkeypatch):
    """In rounds only: about the logarithm of the chain."""
    monkeypatch.setattr(graphs, "FINISH", 50)
    rounds, saved = [], Scratch.saved
    monkeypatch.setattr(Scratch, "saved", lambda self, df: rounds.append(1) or saved(self, df))
    n, rng = 10_000, random.Random(9)
    ids = rng.sample(range(1, 10**9), n)
    got = found(spark, ids, [*zip(ids[1:], ids), (ids[0], ids[99])])
    assert len(rounds) < 100
    head = min(ids[:100])
    at = ids.index(head)
    # the cycle of the first hundred is cut at its least node, which comes first
    assert got[head] == (0, True) and sum(b for _, b in got.values()) == 1
    want = {ids[(at + k) % 100]: k for k in range(100)} | {ids[k]: (99 - at) % 100 + k - 99 for k in range(100, n)}
    assert {i: level for i, (level, _) in got.items()} == want


def test_no_join_of_a_round_goes_through_the_driver(spark, monkeypatch):
    plans, saved = [], graphs.Scratch.saved
    monkeypatch.setattr(graphs.Scratch, "saved", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(self, df))
    monkeypatch.setattr(graphs, "FINISH", 0)
    edges = [(k, k // 2) for k in range(1, 12)] + [(20, 21), (21, 20), (5, 20)]
    got = found(spark, {n for e in edges for n in e}, edges)
    assert plans and not [p for p in plans if "Broadcast" in p]
    assert len(got) == 14
