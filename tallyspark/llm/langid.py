"""Operator 4: language identification by rank-order profiles.

The most frequent letter 1- to 3-grams of a document, in order, are compared
with each language's profile: the distance adds how far each n-gram is out of
place, and the profile length for n-grams that the profile lacks.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import SLICE_ROWS, with_arrow
from tallyspark.shipping import ship
from tallyspark.sources.shared import Scratch

#: N-grams in a language profile and in that of a document.
PROFILE, TOP = 400, 300

#: Bound of a training sample where one is asked for: about so many labelled documents of a language.
TRAIN_DOCS = 4_000

#: N-grams that a task counts before it hands them on.
HELD = 1_000_000

_EDGE = ord("_")


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Each code point if it is a letter, else the mark of a word's edge."""
    points = np.arange(sys.maxunicode + 1, dtype=np.int32)
    letters = np.fromiter(map(str.isalpha, map(chr, points)), dtype=bool, count=len(points))
    return np.where(letters, points, np.int32(_EDGE))


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter 1- to 3-grams of a whole text, packed into 63 bits, and their counts.

    Words stand between edge marks, which 2- and 3-grams include.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return nothing
    points = letter_table()[np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    edge = points == _EDGE
    points = points[~edge | np.append(~edge[1:], True)]  # one edge for each run
    if len(points) < 3:
        return nothing
    seen = np.bincount(points)
    letters = np.flatnonzero(seen)
    small = np.zeros(len(seen), dtype=np.int64)
    small[letters] = np.arange(len(letters))
    c, k = small[points], len(letters)
    mark = small[_EDGE]
    two = np.bincount(c[:-1] * k + c[1:], minlength=0) if k < 300 else None
    pairs, pair_counts = (np.flatnonzero(two), two[two > 0]) if two is not None else np.unique(c[:-1] * k + c[1:], return_counts=True)
    triples = ((c[:-2] * k + c[1:-1]) * k + c[2:])[c[1:-1] != mark]
    triples = np.sort(triples.astype(np.int32) if k < 1290 else triples)
    starts = np.flatnonzero(np.append(True, triples[1:] != triples[:-1]))
    triple = triples[starts].astype(np.int64)
    one = letters[letters != _EDGE]
    keys = [one, letters[pairs // k] << 21 | letters[pairs % k], letters[triple // k // k] << 42 | letters[triple // k % k] << 21 | letters[triple % k]]
    return np.concatenate(keys), np.concatenate([seen[one], pair_counts, np.diff(np.append(starts, len(triples)))])


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """N-grams by falling count; ties in the order of their code points."""
    return keys[np.lexsort((keys, -counts))[:top]]


@dataclass(frozen=True)
class Profiles:
    """The ranked n-grams of each language, as one table of ranks."""

    langs: tuple[str, ...]
    keys: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def of(ranked_grams: dict[str, list[int]]) -> Profiles:
        langs = tuple(sorted(ranked_grams))
        keys = np.array(sorted({g for v in ranked_grams.values() for g in v}), dtype=np.int64)
        ranks = np.full((len(keys), len(langs)), PROFILE, dtype=np.int64)
        for j, lang in enumerate(langs):
            ranks[np.searchsorted(keys, np.array(ranked_grams[lang], dtype=np.int64)), j] = np.arange(len(ranked_grams[lang]))
        return Profiles(langs, keys, ranks)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the best distance's share of the greatest one."""
        top = ranked(*gram_counts(text), TOP)
        if not len(top) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
        known = self.keys[at] == top
        away = np.abs(self.ranks[at[known]] - np.arange(len(top))[known, None])
        away = np.where(self.ranks[at[known]] == PROFILE, PROFILE, away)
        far = away.sum(axis=0) + PROFILE * int((~known).sum())
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (PROFILE * len(top)))


def labelled(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text) of all rows with a text and a language."""
    return docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("text is not null and lang is not null")


def sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", by: Column | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(lang, text) of about ``train_docs`` labelled rows of each language, a documented bound,
    picked by a hash of ``by`` (default: the text); rows without text or language never are."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col) if by is None else by).alias("h"))
    rows = rows.filter("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return rows.select("lang", "text")
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, train_docs / n) * 1_000_000))])
    return rows.filter(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")]).select("lang", "text")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", by: Column | None = None, train_docs: int | None = None) -> Profiles:
    """Profiles from all rows with a text and a language, or from a sample of ``train_docs`` a language.

    N-grams are counted in the tasks and summed by Spark. Only the ranked profiles,
    PROFILE n-grams a language, reach the driver; without such rows there are none.
    """
    return train_on(labelled(docs, text_col, lang_col) if train_docs is None else sample(docs, text_col, lang_col, by, train_docs))


def train_on(picked: DataFrame) -> Profiles:
    """Profiles from all rows of (lang, text)."""
    ship(picked.sparkSession)

    def count(parts):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def given():
            for lang, (grams, n) in held.items():
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})
            held.clear()

        for part in parts:
            for at in range(0, len(part), SLICE_ROWS):
                for lang, texts in part.iloc[at : at + SLICE_ROWS].groupby("lang")["text"]:
                    keys, sums = zip(held.get(lang) or gram_counts(None), *map(gram_counts, texts), strict=True)
                    both, place = np.unique(np.concatenate(keys), return_inverse=True)
                    held[lang] = both, np.bincount(place, weights=np.concatenate(sums), minlength=len(both)).astype(np.int64)
                if sum(len(grams) for grams, _ in held.values()) > HELD:
                    yield from given()
        yield from given()

    grams = picked.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(_by_rank())
    top = grams.withColumn("rank", order).filter(F.col("rank") <= PROFILE).select("lang", "gram", "rank").collect()
    found: dict[str, list[int]] = {}
    for row in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(row["lang"], []).append(row["gram"])
    return Profiles.of(found)


def _by_rank():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(F.desc("n"), "gram")


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the predicted language of each whole text and its score (0 to 1).

    Null texts and texts without a letter, and any text when there is no profile,
    give 'und' and 0.0. Ties go to the language first in order. Other columns
    pass; those named like the new ones are replaced.
    """

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            found = [profiles.predict(t) for t in texts.to_pylist()]
            return [pa.array([x[0] for x in found], type=pa.string()), pa.array([x[1] for x in found], type=pa.float64())]

        return work

    return with_arrow(df, text_col, [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())], make, keep)


def least_score(picked: DataFrame, profiles: Profiles, quantile: float = 0.01, margin: float = 0.6) -> float:
    """A score below which a text is like no learned language: ``margin`` of the given quantile
    of the scores of labelled rows (lang, text). 0.0 without rows.

    Texts of languages that were not learned score about half as high as the lowest labelled ones.
    """
    found = exact_quantile(identify(picked.filter("text rlike '[A-Za-z]'"), profiles, keep=[]), "score", quantile)
    return margin * found if found is not None else 0.0


def exact_quantile(rows: DataFrame, score: str, quantile: float) -> float | None:
    """The least score (0 to 1) that the given part of the rows does not exceed; None without rows.

    The driver gets the counts of 10,001 cells, then one cell's different scores.
    """
    scratch, cell = Scratch(rows.sparkSession, "quantile"), F.floor(F.col("score") * 10_000)
    counts = scratch.saved(rows.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n")).filter("score is not null"))
    cells = sorted((r["cell"], r["n"]) for r in counts.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).collect())
    left, found = max(1, math.ceil(quantile * sum(n for _, n in cells))), None
    for at, n in cells:
        if left <= n:
            for r in sorted(counts.filter(cell == at).collect()):
                left, found = left - r["n"], r["score"]
                if left <= 0:
                    break
            break
        left -= n
    scratch.clear()
    return found


def held_out() -> Column:
    """Rows that never train: the remainder 2 of crc32(doc_id as text) by 4."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def languages(docs: DataFrame) -> DataFrame:
    """The contract: profiles from the rows not held out, predictions for all."""
    profiles = train(docs.filter(~held_out()), by=F.col("doc_id"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, profiles, keep=["doc_id", "held_out"])
