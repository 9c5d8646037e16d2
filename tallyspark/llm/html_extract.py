"""Operator 2: main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels each block by
link density, stop-word density and length; marks of the markup (navigation tags,
names such as ``cookie-notice``) count against a block, standing in an article
counts for it. Blocks that stay open, mostly short ones, then inherit the label of
their nearest decided neighbours. ``labelled_blocks`` gives every block with its
label and the rule that decided it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import with_arrow

#: Tags that end a block, and those of them that hold other blocks.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
HOLDER_TAGS = frozenset("article aside blockquote body button dd details dialog div dl fieldset figure footer form head header html li main menu nav ol search section select table tbody td tfoot th thead tr ul".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS = frozenset(("article", "main"))

#: Tags whose text is never read; an unclosed script or style runs to
#: the end of the page, of the others only the tag itself goes.
RAW_TAGS = frozenset("script style noscript template textarea svg iframe object".split())
ENDLESS_TAGS = frozenset(("script", "style"))

#: Tags and names that mark parts without article text. A strong mark
#: also holds for articles inside (cards, comments); a weak one ends at an article,
#: for whole pages are wrapped in forms and oddly named folders.
STRONG_TAGS = frozenset("aside button footer head menu nav search select".split())
WEAK_TAGS = frozenset("dialog form".split())
STRONG_NAMES = frozenset("comment comments disqus replies recommended sponsored ad ads adv advert adverts advertisement adbox adsense pagination pager breadcrumb breadcrumbs".split())
WEAK_NAMES = frozenset("banner captcha consent cookie cookies disclaimer footer gdpr menu modal nav navbar navigation newsletter notice overlay popup promo promotion share sharing sidebar signup skip social sponsor subscribe subscription toolbar widget".split())
OUTER_NAMES = frozenset("header masthead topbar top login search".split())
#: Words that mark such a part alone or before one of the list words only,
#: as in ``related-posts``; an article may be ``node-promoted`` or of ``related-work``.
LIST_MARKS = frozenset("promoted related reply respond response".split())
LIST_WORDS = frozenset("articles block box content form items links list news pages posts products reading section stories topics widget wrap".split())
#: Words that make a name speak of its neighbours, as in ``has-sidebar``, and
#: last words that make it speak of a state, as in ``comments-closed``.
LINKING_WORDS = frozenset("and has hide is no not show with without".split())
STATE_WORDS = frozenset("closed disabled enabled free off on open".split())

#: Frequent words of the four languages.
STOP_WORDS = frozenset("""
the of and to in a is that it was for on are as with be at by this from or an not have had but which they you he she we his her
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine einer eines als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie
le la les de des et en un une du que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou cette être elle leur nous vous
el los las y que en un una por con no para su al lo como más del se pero sus ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo
""".split())

#: Marks around a block that are told apart; more of them change nothing.
MOST_MARKS = 32

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # outside of quotes a tag ends at the next <, so a page of unclosed tags is read once
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/<>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-z][^<>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TAGS}
ATTRIBUTE = re.compile(r"([a-z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


@dataclass(frozen=True)
class Rules:
    """Thresholds: lengths in characters; densities and shares as parts of one.

    ``article``: an article element decides what stands outside of it when it holds
    such a part of the page's prose. ``wrapper``: a weak mark on such a part of a
    page's text is not believed. ``linked``: what an article may link in a block that
    stands beside another one of links.
    """

    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.25
    links: float = 0.35
    article: float = 0.3
    wrapper: float = 0.8
    linked: float = 0.8


@dataclass
class Block:
    text: str
    link_chars: int
    article: int  # number of the innermost article around it, 0: none
    marks: tuple[tuple[int, int], ...]  # (number, strength) of the marked parts around it, outermost first
    heading: int = 0  # 1 to 6
    label: str = ""
    rule: str = ""

    def settle(self, label: str, rule: str) -> None:
        self.label, self.rule = label, rule


#: Strengths of marks: weak ones, names that also hold for articles inside, and such tags.
WEAK, NAMED, TAG = 1, 2, 3


def strong_name(words: list[str]) -> bool:
    """Whether the words of a name mark a part without article text."""
    if words[0] in LIST_MARKS and LIST_WORDS.issuperset(words[1:]):
        return True
    last = () if LINKING_WORDS.intersection(words) else words[-1:]
    return not (len(words) > 1 and words[-1] in STATE_WORDS) and not STRONG_NAMES.isdisjoint((words[0], *last))


def mark_of(tag: str, rest: str, inside: bool) -> int:
    """The strength with which a tag or its class, id and role mark a part without article text; 0: not."""
    if tag in STRONG_TAGS:
        return TAG
    mark = WEAK if tag in WEAK_TAGS or tag == "header" and not inside else 0
    if not rest or tag in ("html", "body"):
        return mark
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and INVISIBLE.search(value):
            mark = WEAK
        elif key in ("class", "id", "role"):
            for name in value.split():
                words = [w.lower() for w in CAMEL.split(name) if w]
                if not words:
                    continue
                if strong_name(words):
                    return NAMED
                told = {words[0], *([] if LINKING_WORDS.intersection(words) else words[-1:])}
                if told & WEAK_NAMES or not inside and told & OUTER_NAMES:
                    mark = WEAK
    return mark


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with white space and references resolved."""
    found: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    holders: list[tuple[str, int, tuple]] = []  # tag, article, marks
    article, marks, links, heading, number, at = 0, (), 0, 0, 0, 0
    held: Counter = Counter()  # holders that stand open, by tag
    unclosed: set[str] = set()

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, min(len(text), len(" ".join(html.unescape("".join(linked)).split()))), article, marks, heading))
            parts.clear()
            linked.clear()

    while m := TOKEN.match(page, at):
        at = m.end()
        text = m["text"]
        if text is not None:
            parts.append(text)
            if links:
                linked.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag, rest, close = tag.lower(), m["rest"], m["close"]
        if tag in RAW_TAGS:
            if not close and not rest.endswith("/") and tag not in unclosed:
                if end := RAW_END[tag].search(page, at):
                    at = end.end()
                elif tag in ENDLESS_TAGS:
                    at = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if close else 1
        if tag in BLOCK_TAGS:
            flush()
            links, heading = 0, int(tag[1]) if tag in HEADING_TAGS and not close else 0
        if tag not in HOLDER_TAGS:
            continue
        if close:
            if held[tag]:
                last = ""
                while last != tag:
                    last = holders.pop()[0]
                    held[last] -= 1
                _, article, marks = holders[-1] if holders else ("", 0, ())
        elif not rest.endswith("/"):
            mark = mark_of(tag, rest, article > 0)
            if tag in ARTICLE_TAGS and not (mark or any(strength > WEAK for _, strength in marks)):
                number += 1
                article, marks = article or number, ()
            elif mark and len(marks) < MOST_MARKS:
                number += 1
                marks = (*marks, (number, mark))
            holders.append((tag, article, marks))
            held[tag] += 1
    flush()
    return found


def stop_density(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def disbelieve_wrappers(found: list[Block], rules: Rules) -> None:
    """Take away marks around nearly all text of a page that is not links: weak ones, and
    names where no article and no longer text stands outside of them."""
    sizes = [len(b.text) - b.link_chars for b in found]
    total = sum(sizes)
    free = any(not b.marks and (b.article or len(b.text) >= rules.short and b.link_chars <= rules.links * len(b.text)) for b in found)
    while total:
        held: Counter = Counter()
        for b, n in zip(found, sizes, strict=True):
            if b.marks and (b.marks[0][1] == WEAK or b.marks[0][1] == NAMED and not free):
                held[b.marks[0]] += n
        wide = [mark for mark, n in held.items() if n >= rules.wrapper * total]
        if not wide:
            return
        for b in found:
            if b.marks and b.marks[0] == wide[0]:
                b.marks = b.marks[1:]


def first_pass(found: list[Block], rules: Rules) -> None:
    """Label blocks by themselves: good, bad, or near and short for those left open."""
    linked = [b.link_chars > rules.links * len(b.text) for b in found]
    for i, b in enumerate(found):
        n = len(b.text)
        if linked[i]:
            beside = any(linked[j] and found[j].article == b.article for j in (i - 1, i + 1) if 0 <= j < len(found))
            # an article's paragraph, or its list of sources, says something beside its links
            told = b.article and not b.marks and (not beside or b.link_chars <= rules.linked * n)
            b.settle(*(("short", "") if told else ("bad", "links")))
            continue
        stop = stop_density(b.text)
        if n >= rules.short and stop < rules.stop_low and not b.article:
            b.settle("bad", "stop words")
        elif b.marks:
            b.settle("bad", "mark")
        elif not b.article and n < rules.long and ("©" in b.text or b.link_chars and n < rules.short):
            b.settle("bad", "length")
        elif n < rules.short:
            b.label = "short"
        elif stop >= rules.stop_high and (b.article or n >= rules.long):
            b.settle("good", "stop words")
        else:
            b.label = "near" if stop >= rules.stop_low else "short"


def neighbours(found: list[Block]) -> list[tuple[str, str]]:
    """The labels of the nearest decided blocks before and after each; those beyond the
    ends of an article do not count for what stands in it."""
    out: list[list[str]] = [["", ""] for _ in found]
    for side, order in ((0, range(len(found))), (1, range(len(found) - 1, -1, -1))):
        anywhere, within, place = "", "", 0
        for i in order:
            b = found[i]
            if b.article != place:
                within, place = "", b.article
            out[i][side] = within if b.article else anywhere
            if b.label in ("good", "bad"):
                anywhere = within = b.label
    return [(a, b) for a, b in out]


def heads_nothing(found: list[Block], i: int) -> bool:
    """Whether a heading below the first level has only bad blocks under it, and one at least."""
    under = []
    for b in found[i + 1 :]:
        if b.article != found[i].article or b.heading and not b.marks:
            break
        under.append(b.label)
        if b.label != "bad":
            break
    return bool(under) and under[-1] == "bad"


def second_pass(found: list[Block], rules: Rules) -> None:
    """Give open blocks the label of their nearest decided neighbours.

    In an article a block falls only between two bad ones, or as the heading of bad
    ones. Outside, near blocks take one good neighbour, short ones two, headings the
    one that follows; next to an article with most of the prose they fall. Where
    nothing on a page is good, its unmarked open blocks are.
    """
    prose = sum(len(b.text) for b in found if b.label == "good")
    inside = sum(len(b.text) for b in found if b.label == "good" and b.article)
    if inside and inside >= rules.article * prose:
        for b in found:
            if not b.article and b.label != "bad":
                b.settle("bad", "outside")
    any_good = any(b.label == "good" for b in found)
    articles = {b.article for b in found if b.article and b.label == "good"}
    decided = []
    for i, (b, (before, after)) in enumerate(zip(found, neighbours(found), strict=True)):
        if b.label in ("good", "bad"):
            continue
        if b.article:
            if b.heading > 1:
                bad = heads_nothing(found, i)
            else:
                bad = b.article in articles and before == after == "bad"
        elif not any_good:
            bad = False
        elif b.heading and after:
            bad = after == "bad"
        elif b.label == "near":
            bad = "good" not in (before, after)
        else:
            bad = {before, after} - {""} != {"good"}
        decided.append((b, "bad" if bad else "good"))
    for b, label in decided:
        b.settle(label, "neighbours" if any_good or label == "bad" else "alone")


def labelled(page: str | None, rules: Rules = Rules()) -> list[Block]:
    """All blocks of a page, each good or bad, with the rule that decided it."""
    found = blocks(page) if page else []
    disbelieve_wrappers(found, rules)
    first_pass(found, rules)
    second_pass(found, rules)
    return found


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """Main text of one page: good blocks in page order, one a line."""
    return "\n".join(b.text for b in labelled(page, rules) if b.label == "good")


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """Add ``text_col``, the main text of each whole page.

    Null, empty and text-free pages give ''. Rows are independent, so repeated
    rows repeat; other columns pass, one named ``text_col`` is replaced.
    """

    def make():
        return lambda pages: [pa.array([main_text(p, rules) for p in pages.to_pylist()], type=pa.string())]

    return with_arrow(df, html_col, [T.StructField(text_col, T.StringType())], make, keep)


def labelled_blocks(df: DataFrame, html_col: str = "html", rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """One row for each block of each page: columns ``keep``, then pos, text, label, rule.

    Pages without a block have no row; a kept column named like a new one gives way.
    """
    item = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("rule", T.StringType())])
    fields = [T.StructField("_blocks", T.ArrayType(item))]
    as_arrow = pa.list_(pa.struct([(f.name, pa.string()) for f in item]))

    def make():
        return lambda pages: [pa.array([[{"text": b.text, "label": b.label, "rule": b.rule} for b in labelled(p, rules)] for p in pages.to_pylist()], type=as_arrow)]

    rows = with_arrow(df, html_col, fields, make, keep)
    others = [F.col(f"`{c}`") for c in rows.columns if c not in ("_blocks", "pos", "text", "label", "rule")]
    return rows.select(*others, F.posexplode("_blocks").alias("pos", "_b")).select(*others, "pos", "_b.text", "_b.label", "_b.rule")


def page_texts(pages: DataFrame) -> DataFrame:
    """The contract's columns: page_id, url, text, n_chars."""
    return extract(pages, keep=["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
