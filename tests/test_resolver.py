"""Versions from signals of three tiers, against a plain loop."""

import random

import pytest

from pyspark.sql import functions as F

from tallyspark.functions import versions
from tallyspark.operators import resolver

SCHEMA = "project long, pos long, tier string, source string, raw string, versions array<string>"


@pytest.mark.parametrize(
    "raw, yes, no",
    [
        (">=3.8,<4,!=3.11.*", "3.10 3.12 3.8", "3.11 4 3.7"), ("~=3.8", "3.8 3.10", "3.7 4.0"), ("~=3.8.1", "3.8.1 3.8.9", "3.8.0 3.9"), ("==3.10", "3.10 3.10.0", "3.11 3.10.1"),
        ("==3.10.*", "3.10 3.10.7", "3.11"), ("^18 || >=20.1", "18 18.9 20.1 22", "17 19 20.0"), ("18.x", "18 18.4", "19"), ("18", "18 18.2.1", "19 17"), ("^0.2.3", "0.2.3 0.2.9", "0.3.0 0.2.2"),
        ("~1.2", "1.2 1.2.9", "1.3 1.1"), ("~1", "1 1.9", "2"), (">= 1.2 < 2", "1.2 1.9.9", "2 1.1"), ("*", "1 99", ""), ("", "1", ""), ("!=1.2", "1.3 1.2.1", "1.2"), ("=1.2.3", "1.2.3", "1.2.4"), (">1.2", "1.2.1 2", "1.2 1.1"), ("<=1.2", "1.2 1.1.9", "1.2.1"),
        ("^1.2.3", "1.2.3 1.9", "2 1.2.2"), ("^0.0.3", "0.0.3", "0.0.4 0.1"), ("v1.2", "1.2.5", "1.3"),
    ],
)
def test_constraints(spark, raw, yes, no):
    asked = [(v, True) for v in yes.split()] + [(v, False) for v in no.split()]
    got = spark.createDataFrame([(v,) for v, _ in asked], "v string").select("v", versions.admits(F.col("v"), F.lit(raw)).alias("ok")).collect()
    assert {(r.v, r.ok) for r in got} == set(asked)


CONSTRAINTS = {">=3.10": lambda m: m >= 10, "<3.12": lambda m: m < 12, "!=3.11.*": lambda m: m != 11, ">=3.11,<3.13": lambda m: 11 <= m < 13, "<3.9 || >=3.12": lambda m: m < 9 or m >= 12, "*": lambda m: True}


def plain(signals, supported, pick):
    """(version, tier, source, conflicting positions) of one project's signals in order."""
    minor = lambda v: int(v.split(".")[1])
    a = [s for s in signals if s[2] == "A" and s[4] is not None]
    b = [s for s in signals if s[2] == "B" and s[5]]
    c = [s for s in signals if s[2] == "C" and s[5]]
    agrees = lambda s, v: CONSTRAINTS[s[4]](minor(v)) if s[2] == "A" else v in s[5]
    left = [v for v in supported if all(agrees(s, v) for s in a)]
    if not left:
        return None, "conflict", "conflict", {s[1] for s in a}, len(a) + len(b) + len(c)
    for tier in (b, c):
        left = [v for v in left if any(agrees(s, v) for s in tier)] or left
    best = (min if pick == "min" else max)(left, key=minor)
    b = [s for s in b if set(s[5]) & set(supported)]
    tier, source = ("A", a[0][3]) if a else ("B", b[0][3]) if b else ("C", c[0][3]) if c else ("default", "default")
    against = {s[1] for s in signals if (s in a or s[2] != "A" and s[5]) and not agrees(s, best)}
    return best, tier, source, against, len(against)


@pytest.mark.parametrize("pick", ["min", "max"])
def test_resolver_equals_plain_loop(spark, pick):
    rng, supported = random.Random(6), ["3.9", "3.12", "3.10", "3.11"]
    rows = []
    for project in range(120):
        for pos in range(rng.randint(1, 6)):
            tier = rng.choice("ABCC")
            raw = rng.choice([*CONSTRAINTS, None]) if tier == "A" else None
            seen = None if tier == "A" else rng.choice([None, [], ["2.7"], rng.sample(["3.8", *supported], rng.randint(1, 3))])
            rows.append((project, pos, tier, f"s{pos}", raw, seen))
    signals = spark.createDataFrame(rows, SCHEMA)
    found = resolver.resolved_versions(signals, supported, pick)
    against = {}
    for r in resolver.version_conflicts(signals, found).collect():
        against.setdefault(r.project, set()).add(r.pos)
    got = {r.project: (r.version, r.tier, r.source, against.get(r.project, set()), r.n_conflicts) for r in found.collect()}
    assert got == {p: plain([r for r in rows if r[0] == p], supported, pick) for p in range(120)}
    assert {x[1] for x in got.values()} == {"A", "B", "C", "conflict", "default"}
    assert resolver.resolved_versions(spark.createDataFrame([], SCHEMA), supported).collect() == []
