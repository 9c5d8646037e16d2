"""BPE, page text, language ID, token counts and packing against plain versions."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, html_extract, langid, packing, token_counts
from tests.llm.fixtures import TEXTS, awkward, empty


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_equals_the_library(spark, library):
    rows = bpe.round_trip(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 1
    want = {}
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
    assert bpe.round_trip(empty(spark)).count() == 0


def test_bpe_on_random_unicode(library):
    mine, rng = bpe.load(bpe.vocabulary_path()), random.Random(3)
    by_library = bpe.load(bpe.vocabulary_path(), False)
    signs = [chr(c) for c in itertools.chain(range(32, 0x250), range(0x370, 0x5FF), range(0x2000, 0x2070), range(0x1F600, 0x1F640), [0x301, 0x327, 0x3A3, 0x1D15E])]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.packed(text), "<u4").tolist() == ids == np.frombuffer(by_library.packed(text), "<u4").tolist()
        assert mine.decoded(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_on_capitals_that_fall_beyond_the_plain_range(library):
    mine = bpe.load(bpe.vocabulary_path())
    rising = [chr(c) for c in range(bpe.PLAIN_LIMIT + 1) if max(chr(c).lower()) > chr(bpe.PLAIN_LIMIT)]
    assert "\u018f" in rising
    for text in ["\u018fli", *[f"plain {c}li ba{c} a{c}b {c}" for c in rising]]:
        assert np.frombuffer(mine.packed(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a> <p>Site of many things and the people who are in it with the rest of them all</p></header>
<nav><ul><li><a href="/a">The</a></li><li><a href="/b">and</a></li></ul></nav><div class="cookie-notice">We use cookies for the good of the site and of you, and this is the text of it.</div>
<article><h1>A &amp; B</h1><p><b>First</b> paragraph&nbsp;of the  text,<br>with the words of a story in it and on it.<p>Short.</p>
<aside>An advert of the day for the people</aside><form>Enter <input></form></article>
<section id="comments"><p>I like the story of the day and the night and that it was good for the people of it.</p></section>
<footer>&copy; all of the rights</footer>"""


def test_page_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "<p", "x"), (5, "u", "no markup of the page " * 20, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.page_texts(pages).collect()}
    assert got[1].text == "A & B\nFirst paragraph of the text, with the words of a story in it and on it.\nShort."
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[3].url is None
    assert got[5].text == ("no markup of the page " * 20).strip()
    assert html_extract.page_texts(pages.limit(0)).count() == 0


def test_headings_and_links_outside_articles():
    body = "The river runs by the house of the man and it is not as wide as the sea, but they say that it was so in the old days. " * 2
    page = f"<div><h2>Old days</h2><p>{body}</p><ul><li><a href=x>{body}</a></li></ul><div>Copyright © the site</div></div>"
    assert html_extract.main_text(page) == "Old days\n" + " ".join(body.split())


PROSE = "The river runs by the house of the man and it is not as wide as the sea, but they say that it was so in the old days. " * 2


@pytest.mark.parametrize("wrapper", [
    '<div class="layout has-sidebar">', '<div class="overflow-hidden">', '<div style="overflow:hidden">', '<div class="post-with-comments">',
    '<div id="top">', '<form method="post" action="./page.aspx" id="aspnetForm">', '<div class="notice">', '<section class="search"><div hidden>',
])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_text_survives_its_wrappers(wrapper, tag):
    page = f"<body>{wrapper}<{tag}><h1>Days</h1><p>{PROSE}</p><p><a href=x>See the report</a></p><p>{PROSE}</p></{tag}>"
    want = ["Days", " ".join(PROSE.split()), "See the report", " ".join(PROSE.split())]
    assert html_extract.main_text(page).split("\n") == [w for w in want if tag != "div" or w != "See the report"]


ARTICLE_NAMES = [
    "div class='node node-article node-promoted'", "article class='node--promoted'", "article class='post comments-open'", "div class='comments-closed single-post'", "div class='post replies-off'",
    "article id='related'", "div class='ad-free'", "div class='reply-letter'", "section class='related-work'", "div class='comments'", "div id='related-posts'", "article class='sponsored'",
]


@pytest.mark.parametrize("opening", ARTICLE_NAMES)
def test_articles_survive_their_names(opening):
    prose = " ".join(PROSE.split())
    page = f"<nav><a href=x>Home</a></nav><{opening}><h1>Days of old</h1>" + f"<p>{PROSE}</p>" * 4 + f"</{opening.split()[0]}><footer>Copyright</footer>"
    assert html_extract.main_text(page).split("\n") == ["Days of old"] + [prose] * 4


@pytest.mark.parametrize("name", ["comments", "related", "related-posts", "comment-respond", "reply-form", "promoted", "ad-slot", "post-comments", "sponsored-content"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_parts_beside_an_article_go(tag, name):
    page = f"<{tag}><h1>Days of old</h1><p>{PROSE}</p></{tag}><div class='{name}'>" + f"<p>{PROSE} too</p>" * 30 + "</div>"
    assert "too" not in html_extract.main_text(page) and "river" in html_extract.main_text(page)


def test_linked_paragraphs_and_sources_of_an_article_stay():
    linked = "As <a href=x>the report of the house of the river and of the sea in it says</a> on it, <a href=y>the man</a> is old."
    sources = "<ul><li><a href=a>On rivers of the old days</a>, Press, 2004</li><li><a href=b>On the sea and on its shores</a>, Press, 2010</li></ul>"
    page = f"<article><h1>Days</h1><p>{PROSE}</p><p>{linked}</p><p>{linked}</p><p>{PROSE}</p><h2>Sources</h2>{sources}<h2>Related</h2><ul><li><a href=c>One of it</a></li><li><a href=d>Two of it</a></li></ul></article>"
    got = html_extract.main_text(page).split("\n")
    assert len(got) == 8 and got[5:] == ["Sources", "On rivers of the old days, Press, 2004", "On the sea and on its shores, Press, 2010"]


@pytest.mark.parametrize("part", ["<p title=\"", "<p a=", "<p \"x>\" ", "<p a='\" ", "<", "<!--", "<div>", "<div class='comments'>", "</section>", "<a href=x>", "<p a='<p b=\"", "<svg>", "<title"])
def test_a_megabyte_of_markup_is_read_once(part):
    began = time.time()
    html_extract.main_text("<div>" * 30_000 + part * (1_000_000 // len(part)) + "</section>" * 30_000)
    assert time.time() - began < 6


def test_parts_that_are_no_article_go():
    card = f'<article class="comment"><p>{PROSE}</p></article>'
    page = (
        f"<article><h1>Days</h1><p>{PROSE}</p><svg><p>Short.</p><h2>Related</h2><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>"
        f'<div class="ad-slot">{PROSE}</div></article><div class="comments">{card}<article><p>{PROSE}</p></article></div>'
        f"<aside><article><p>{PROSE}</p></article></aside><div>We use cookies. {PROSE}</div>"
    )
    assert html_extract.main_text(page).split("\n") == ["Days", " ".join(PROSE.split()), "Short."]
    assert html_extract.main_text("<p>Hello there</p>") == "Hello there"
    assert html_extract.main_text("<form>" * 5000 + f"<p>{PROSE}</p>") == " ".join(PROSE.split())


def plain_labels(rows, rules):
    """Both passes over (text, link part, article, mark, heading), by looking at all blocks for each."""
    n = len(rows)
    known, unlinked = [""] * n, [len(t) - k for t, k, *_ in rows]
    marks = [mark for _, _, _, mark, _ in rows]
    free = any(not m and (a or len(t) >= rules.short and k <= rules.links * len(t)) for t, k, a, m, _ in rows)
    for m in {m for m in marks if m and (m[0] == "weak" or m[0] == "named" and not free)}:
        if sum(u for u, x in zip(unlinked, marks, strict=True) if x == m) >= rules.wrapper * sum(unlinked) > 0:
            marks = [None if x == m else x for x in marks]
    linked = [k > rules.links * len(t) for t, k, *_ in rows]
    for i, (t, k, article, _, _) in enumerate(rows):
        words = ["".join(c for c in w if c.isalpha()) for w in t.lower().split()]
        words = [w for w in words if w]
        stop = sum(w in html_extract.STOP_WORDS for w in words) / max(1, len(words))
        if linked[i]:
            beside = any(linked[j] and rows[j][2] == article for j in (i - 1, i + 1) if 0 <= j < n)
            known[i] = "short" if article and not marks[i] and (not beside or k <= rules.linked * len(t)) else "bad"
        elif marks[i] or not article and (len(t) >= rules.short and stop < rules.stop_low or "©" in t and len(t) < rules.long or k and len(t) < rules.short):
            known[i] = "bad"
        elif len(t) >= rules.short and stop >= rules.stop_high and (article or len(t) >= rules.long):
            known[i] = "good"
        else:
            known[i] = "near" if len(t) >= rules.short and stop >= rules.stop_low else "short"
    prose = lambda inside: sum(len(r[0]) for r, x in zip(rows, known, strict=True) if x == "good" and (r[2] or not inside))
    if prose(True) and prose(True) >= rules.article * prose(False):
        known = [x if r[2] else "bad" for r, x in zip(rows, known, strict=True)]
    out = list(known)
    for i, (_, _, article, _, heading) in enumerate(rows):
        if known[i] in ("good", "bad"):
            continue

        def seek(path, i=i, article=article):
            for j in path:
                if article and rows[j][2] != article:
                    return ""
                if known[j] in ("good", "bad"):
                    return known[j]
            return ""

        before, after = seek(range(i - 1, -1, -1)), seek(range(i + 1, n))
        if article and heading > 1:
            under = []
            for j in range(i + 1, n):
                if rows[j][2] != article or rows[j][4] and not marks[j]:
                    break
                under.append(known[j])
            bad = bool(under) and set(under) == {"bad"}
        elif article:
            bad = any(x == "good" and r[2] == article for r, x in zip(rows, known, strict=True)) and before == after == "bad"
        elif "good" not in known:
            bad = False
        elif heading and after:
            bad = after == "bad"
        elif known[i] == "near":
            bad = "good" not in (before, after)
        else:
            bad = {before, after} - {""} != {"good"}
        out[i] = "bad" if bad else "good"
    return out


def random_page(rng):
    """A page and its blocks: (text, link characters, article, mark, heading)."""
    words = ["the", "of", "and", "it", "river", "stone", "haus", "maple", "copper", "lantern", "©"]
    rows, parts, number = [], [], 0
    for k in range(rng.randint(1, 6)):
        kind = rng.choice(["article", "article", "", "", "nav", "notice", "comments"])
        number += kind == "article"
        opening = {"article": "<article>", "": "<div>", "nav": "<nav>", "notice": '<div class="notice">', "comments": '<div class="comments">'}[kind]
        parts.append(opening)
        for _ in range(rng.randint(1, 6)):
            choice, heading = words[: rng.choice([4, 8, 10, 11])], rng.choice([0, 0, 0, 0, 1, 2])
            text = " ".join(rng.choice(choice) for _ in range(rng.choice([2, 4, 14, 25, 60])))
            part = rng.choice([0, 0, 0, 0, 1, 2])
            link = " ".join(text.split()[: len(text.split()) * part // 2]) if part else ""
            tag = f"h{heading}" if heading else "p"
            parts.append(f"<{tag}>" + (f"<a href=x>{link}</a>{text[len(link):]}" if link else text) + f"</{tag}>")
            mark = {"nav": ("strong", k), "comments": ("named", k), "notice": ("weak", k)}.get(kind)
            rows.append((text, len(link), number if kind == "article" else 0, mark, heading))
        parts.append({"article": "</article>", "nav": "</nav>"}.get(kind, "</div>"))
    return "".join(parts), rows


def test_both_passes_equal_a_plain_version():
    rng, seen = random.Random(8), set()
    for _ in range(1500):
        page, rows = random_page(rng)
        got = html_extract.labelled(page)
        assert [(b.text, b.link_chars, b.article > 0, b.heading) for b in got] == [(t, k, a > 0, h) for t, k, a, _, h in rows]
        assert [b.label for b in got] == plain_labels(rows, html_extract.Rules())
        seen |= {(b.label, b.rule) for b in got}
    assert seen == {(x, "neighbours") for x in ("good", "bad")} | {("good", "stop words"), ("bad", "stop words"), ("bad", "links"), ("bad", "mark"), ("bad", "length"), ("bad", "outside"), ("good", "alone")}


def test_most_blocks_are_decided_by_density_and_neighbours(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = {r.rule: r["count"] for r in html_extract.labelled_blocks(pages, keep=["page_id"]).groupBy("rule").count().collect()}
    assert rules["mark"] < 0.25 * sum(rules.values())
    assert min(rules["links"], rules["stop words"], rules["neighbours"]) > 0.1 * sum(rules.values())


def test_languages_learn_and_hold_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held)


def test_languages_on_awkward_rows(spark):
    got = {r.doc_id: r for r in langid.languages(awkward(spark)).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0.0
    assert got[1].lang_pred == "en"
    assert langid.languages(empty(spark)).count() == 0
    unlabelled = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.languages(unlabelled).collect()} == {"und"}


def plain_distance(text, profile):
    grams = {}
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in words:
        padded = f"_{w}_"
        for g in [*w, *(padded[i : i + 2] for i in range(len(padded) - 1)), *(padded[i : i + 3] for i in range(len(padded) - 2))]:
            grams[g] = grams.get(g, 0) + 1
    pack = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    order = sorted(grams, key=lambda g: (-grams[g], pack(g)))[: langid.TOP]
    place = {g: k for k, g in enumerate(profile)}
    return [pack(g) for g in order], sum(abs(place[pack(g)] - k) if pack(g) in place else langid.PROFILE for k, g in enumerate(order))


def test_out_of_place_distance_equals_a_plain_one():
    train = {"a": "the cat and the dog of the house", "b": "der hund und die katze im haus"}
    ranked = {k: plain_distance(t, [])[0] for k, t in train.items()}
    profiles = langid.Profiles.of(ranked)
    for text in ("the house of the dog", "die katze", "zzz", "Ärger über alles, the end"):
        far = {k: plain_distance(text, v)[1] for k, v in ranked.items()}
        best = min(far, key=lambda k: (far[k], k))
        n = len(plain_distance(text, [])[0])
        assert profiles.predict(text) == (best, pytest.approx(1 - far[best] / (langid.PROFILE * n)))


def viterbi(token, trie):
    best = [(0.0, 0)]
    for d in range(1, len(token) + 1):
        c = token[d - 1]
        top = (best[d - 1][0] + trie.unknown, best[d - 1][1] + len(c.encode()))
        for size in range(1, d + 1):
            s = trie.scores.get(token[d - size : d])
            if s is not None and best[d - size][0] + s > top[0]:
                top = (best[d - size][0] + s, best[d - size][1] + 1)
        best.append(top)
    return best[-1][1]


def test_token_counts_equal_plain_forward_scores(spark):
    trie = token_counts.load(bpe.vocabulary_path("piece_bpe_32k.model"))
    rows = token_counts.document_counts(awkward(spark)).collect()
    for r in rows:
        words = token_counts.pretokens(dict(TEXTS)[r.doc_id])
        assert r.n_pretokens == len(words)
        assert r.n_tokens == sum(viterbi(w, trie) for w in words)
    assert token_counts.document_counts(empty(spark)).count() == 0


def test_trie_that_is_cleared_counts_the_same(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_NODES", 10)
    trie = token_counts.Trie({"a": -1.0, "ab": -1.5, "b": -1.2, "c": -3.0}, -9.0)
    words = ["".join(p) for n in range(1, 5) for p in itertools.product("abcx", repeat=n)]
    assert [trie.insert(w) for w in words] == [viterbi(w, trie) for w in words]


def least_cost(place, cost):
    best = {0: 0.0}
    for j in range(1, len(place)):
        best[j] = min(best[i] + packing.padding(int(place[j] - place[i])) + packing.WINDOW + cost[j] for i in range(j) if place[j] - place[i] <= packing.CONTEXT)
    return best[len(place) - 1]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(4)
    for _ in range(8):
        ends = np.cumsum(rng.integers(1, 900, 8))
        sentences = np.unique(rng.integers(1, ends[-1], 60))
        place, cost = packing.candidates(ends, sentences)
        keep = np.unique(np.concatenate([[0, len(place) - 1], rng.integers(0, len(place), 250)]))
        place, cost = place[keep], cost[keep]
        if (np.diff(place) > packing.CONTEXT).any():
            continue
        cuts = packing.best_cuts(place, cost)
        paid = sum(packing.padding(int(place[b] - place[a])) + packing.WINDOW + cost[b] for a, b in itertools.pairwise(cuts))
        assert paid == pytest.approx(least_cost(place, cost))


def test_packing_is_whole(spark, library):
    rows = packing.packed(awkward(spark, repeat=False)).collect()
    stream = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in TEXTS}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.doc_tokens == len(stream[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(stream[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(by_doc) == set(stream)
    for pieces, start, length in [(by_doc, "start", None), (by_sequence, "offset", packing.CONTEXT)]:
        for rows in pieces.values():
            rows.sort(key=lambda r: r[start])
            at = 0
            for r in rows:
                assert r[start] == at and r.length > 0
                at += r.length
            assert at <= length if length else at == rows[0].doc_tokens
    padded = sum(packing.padding(sum(r.length for r in rows)) for rows in by_sequence.values())
    assert padded < 0.02 * sum(map(len, stream.values()))
    assert packing.packed(empty(spark)).count() == 0
    assert packing.packed(awkward(spark)).filter("doc_id = 1").agg(F.sum("length")).first()[0] == 2 * len(stream[1])
