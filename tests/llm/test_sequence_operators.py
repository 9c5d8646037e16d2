"""Fill-in-middle, SimHash and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tallyspark.llm import fill_middle, merkle, simhash
from tests.llm.fixtures import LONG, TEXTS, awkward, empty
from tests.llm.test_table_operators import near_copies


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-middle


@pytest.mark.parametrize("text", ["", "a", "é", "日本語 \U0001f600 x", "x" * 5000 + "é" * 700 + "\U0001f600" * 333, LONG])
def test_rank_and_select(text):
    data = text.encode()
    bounds = fill_middle.Boundaries(np.frombuffer(data, dtype=np.uint8))
    assert bounds.total == len(text)
    starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
    for k in sorted({*range(min(len(starts), 70)), *range(0, len(starts), 997), *range(max(0, len(starts) - 70), len(starts))}):
        assert bounds.select(k) == starts[k] and bounds.rank(starts[k]) == k
    assert bounds.select(len(text)) == len(data) and bounds.rank(len(data)) == len(text)


def plain_middle(doc_id, text):
    text = text or ""
    n, h = len(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 20:
        return n, "spm", a, b - a, sha(f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"), sha(text)
    return n, "psm", a, b - a, sha(f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), sha(text)


def test_middles_equal_plain_version(spark):
    odd = [" a<P>b", "<", "<<<S", "<P", "S>", "x<M>", "<p>", "é" * 999 + "<", "\U0001f600<M"]
    texts = TEXTS + [(100 + i, t) for i, t in enumerate(odd * 9)] + [(None, "no id"), (None, None), (5, "one"), (-7, "negative")]
    got = fill_middle.middles(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *plain_middle(i, t))) for i, t in texts)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_middles_of_awkward_tables(spark):
    df = awkward(spark).withColumnRenamed("spans", "form").withColumnRenamed("score", "_drawn").withColumnRenamed("ids", "output")
    out = fill_middle.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "_drawn", "kept", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1 and all(r._drawn == "x" for r in rows)
    for r in rows:
        assert sha(r.output) == plain_middle(r.doc_id, r.text)[4]
    assert fill_middle.middles(empty(spark)).collect() == []


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, radius=4):
    """Row number to the least row number that it reaches, by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    texts = near_copies(60, seed=3) + [(1000 + i, t) for i, t in TEXTS] + [(2000, "a b c d e"), (2001, "A B\tC d  E"), (2002, "a b c d"), (2003, "\x0b\x0c")]
    prints = [plain_fingerprint(t) for _, t in texts]
    want = {i: (f"{p:016x}", texts[r][0]) for (i, _), p, r in zip(texts, prints, plain_roots(prints))}
    got = simhash.near_fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == len(texts) and {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def test_radii_and_balls():
    assert simhash.radii(3, 4) == [1, 1, 0] and simhash.radii(2, 4) == [2, 1] and simhash.radii(4, 2) == [0, 0, 0, -1]
    assert len(simhash.ball(21, 2)) == 1 + 21 + 210 and len(set(simhash.ball(22, 1))) == 23
    assert sum(bits for _, bits in simhash.SEGMENTS) == 64


@pytest.mark.parametrize("crowd", [1, 5, 10_000])
def test_links_equal_brute_force(spark, crowd):
    """Families of fingerprints at every spread of up to six differing bits, each its own root."""
    rng, prints = random.Random(5), set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in range(1, 7) for _ in range(12)}
        low = rng.choice([0, 22, 43])
        prints |= {base ^ sum(1 << b for b in rng.sample(range(low, low + 21), k)) for k in range(1, 7) for _ in range(6)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    nodes = spark.createDataFrame([(p, p, 1) for p in signed], "fp long, root long, docs long")
    table = simhash.tables(nodes).join(nodes.select("fp", "root"), "fp")
    got = {(r.u, r.v) for r in simhash.ball_links(nodes, table, 4, crowd=crowd).collect()}
    assert got == {(u, v) for u in signed for v in signed if u > v and ((u ^ v) & (2**64 - 1)).bit_count() <= 4}


def test_hub_links_are_links(spark):
    nodes = spark.createDataFrame([(0, 9), (1, 1), (3, 1), (31, 1), (1 << 40, 2)], "fp long, docs long")
    got = {(r.u, r.v) for r in simhash.hub_links(simhash.tables(nodes), 4).collect()}
    assert got == {(1, 0), (3, 0), (1 << 40, 0)}


def test_simhash_of_awkward_tables(spark):
    got = {(r.doc_id, r.component_id) for r in simhash.near_fingerprints(awkward(spark)).collect()}
    assert {(2, 2), (3, 2), (4, 2), (1, 1), (8, 1)} <= got
    assert simhash.near_fingerprints(empty(spark)).collect() == []
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (None, "lonely words of one row only here"), (9, None)]
    out = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in out), key=repr) == [(7, 7), (9, 9), (None, 7), (None, None)]


# Merkle manifest


def plain_manifest(docs):
    """doc_id to (leaf, subroot, root, proof_sha256, folded_root, verified); docs: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda row: sha("".join(map(field, row)))

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha("".join(found[-1][i : i + 16])) for i in range(0, len(found[-1]), 16)])
        return found

    def siblings(tree, i):
        out = []
        for level in tree[:-1]:
            run = level[i - i % 16 : i - i % 16 + 16]
            out.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
            i //= 16
        return out

    groups = {}
    for row in docs:
        groups.setdefault(row[1], []).append((row[0], leaf_of(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = levels([x[1] for x in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (doc_id, leaf, row) in enumerate(groups[g]):
            proof = siblings(trees[g], i) + siblings(top, k)
            lowered = row[4] and re.sub("[A-Z]", lambda m: m[0].lower(), row[4])
            touched = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0
            h = leaf_of((*row[:4], lowered)) if touched else leaf
            for before, after in proof:
                h = sha(before + h + after)
            root = top[-1][0]
            out.append((doc_id, leaf, trees[g][-1][0], root, sha("".join(a + b for a, b in proof)), h, h == root))
    return out


def tables_of(seed, sizes):
    rng = random.Random(seed)
    rows, i = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            i += rng.randint(1, 3)
            rows.append((i, name, rng.choice([None, "en", "-"]), rng.choice([None, i]), rng.choice([None, "", f"Text {i} É", "lower"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {None: 1, "": 2, "-": 17},
        {"a": 700, "b": 1, None: 16, "ä": 17, "z": 256, "0:": 257},
        {f"s{i}": 1 + i % 5 for i in range(40)} | {"hot": 900},
    ],
)
@pytest.mark.parametrize("parts", ["2", "13"])
def test_manifest_equals_plain_version(spark, sizes, parts):
    docs = tables_of(7, sizes)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
        got = merkle.verified_rows(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got)) == sorted(plain_manifest(docs))


def test_manifest_of_awkward_tables(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "s", "en", 3, "ABC"), (None, "s", "en", 3, "ABD"), (2, "s", "de", 5, LONG), (2, "s", "de", 5, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "'x' as leaf", "'x' as digest", "'x' as root", "'x' as proof", "'x' as grp")
    got = merkle.verified_rows(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(rows)))
    assert merkle.verified_rows(spark.createDataFrame([], df.schema)).collect() == []


@pytest.mark.parametrize("start, count, total", [(0, 5, 5), (3, 300, 303), (16, 16, 40), (250, 20, 5000), (0, 4096, 4096), (17, 4000, 70_000)])
def test_segments_and_their_boundaries(start, count, total):
    leaves = [sha(str(i)) for i in range(total)]
    whole = [leaves]
    while len(whole[-1]) > 1:
        whole.append([merkle.sha(whole[-1][i : i + 16]) for i in range(0, len(whole[-1]), 16)])
    part = merkle.Segment("g", start, total, leaves[start : start + count])
    shown = list(part.boundary())
    assert all(whole[level][i] == digest for level, i, digest in shown)
    # they cover the leaves once
    covered = sorted(x for level, i, _ in shown for x in range(i * 16**level, min((i + 1) * 16**level, total)))
    assert covered == list(range(start, start + count))
    sent = {(level, i): whole[level][i] for level, run in part.wanted() for i in range(16 * run, min(16 * run + 16, len(whole[level])))}
    for at, path in part.paths(sent):
        h = leaves[start + at]
        for before, after in path:
            h = sha(before + h + after)
        assert h == whole[-1][0]


def test_places_of_partitions():
    summaries = [(0, "a", 5, "a", 5, 5), (2, "a", 3, "b", 4, 4), (3, "b", 6, "b", 6, 6), (4, "c", 1, "c", 1, 1)]
    assert merkle.offsets(summaries) == {0: (0, 3), 2: (5, 6), 3: (4, 0), 4: (0, 0)}
