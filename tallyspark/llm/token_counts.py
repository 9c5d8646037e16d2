"""Operator 8: token counts by dynamic programming over a trie.

Distinct pre-tokens are inserted in a trie. The unigram forward score of a node,
the best total of log-probabilities over the cuts of its prefix into pieces, is
computed once when the node is made, so pre-tokens share the work of their common
prefixes; a terminal's count of pieces is stored. A document's count is the sum
over its pre-tokens.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspark.llm.bpe import vocabulary_path
from tallyspark.llm.common import Memo, with_arrow

#: Nodes after which a worker's trie is built anew, and half the terminals that it
#: remembers; results do not depend on them.
MOST_NODES, TERMINALS = 700_000, 300_000

SPACE = re.compile(r"[\x20\x09-\x0D]+")
PRETOKEN = re.compile(r"▁?(?:\w+|[^\w▁]+)|▁")


class Trie:
    """Forward scores of prefixes under a unigram vocabulary.

    ``scores``: log-probability of each piece. A character that no piece covers
    costs ``unknown`` and counts as its UTF-8 bytes. Among cuts of equal score the
    one with the shorter last piece holds.
    """

    def __init__(self, scores: dict[str, float], unknown: float) -> None:
        self.scores, self.unknown = scores, unknown
        self.longest = max(map(len, scores), default=1)
        self.clear()

        self.terminals = Memo(self.insert, TERMINALS)

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.pieces = [0.0], [0]

    def insert(self, token: str) -> int:
        """Put a pre-token in; the number of its pieces."""
        if len(self.best) > MOST_NODES:
            self.clear()
        child, best, pieces, scores, longest = self.child, self.best, self.pieces, self.scores, self.longest
        path, node = [0], 0
        for d, c in enumerate(token, 1):
            step = node, c
            node = child.get(step)
            if node is None:
                last = path[-1]
                top, n = best[last] + self.unknown, pieces[last] + len(c.encode("utf-8", "surrogatepass"))
                for at in range(d - 1, max(-1, d - 1 - longest), -1):
                    score = scores.get(token[at:d])
                    if score is not None:
                        before = path[at]
                        if best[before] + score > top:
                            top, n = best[before] + score, pieces[before] + 1
                child[step] = node = len(best)
                best.append(top)
                pieces.append(n)
            path.append(node)
        return pieces[node]

    def count(self, tokens: list[str]) -> int:
        return sum(map(self.terminals.__getitem__, tokens))


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities of an ordered vocabulary by Zipf's law: a piece's share falls as its rank."""
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - total for r, p in reversed(list(enumerate(pieces, 1)))}


@lru_cache(maxsize=2)
def load(path: str) -> Trie:
    """A trie over the pieces of a public vocabulary, one per Python worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scores = zipf_scores(usual)
    return Trie(scores, 2 * min(scores.values()))


def pretokens(text: str | None) -> list[str]:
    """Runs of word characters and of other signs, with the mark of a word's start
    for the white space (space, tab, LF, VT, FF, CR) before them."""
    marked = SPACE.sub("▁", text or "").strip("▁")
    return PRETOKEN.findall("▁" + marked) if marked else []


def count_tokens(df: DataFrame, text_col: str = "text", count_col: str = "n_tokens", words_col: str = "n_pretokens", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the numbers of tokens and of pre-tokens of each whole text.

    Null, empty and blank texts count 0; repeated rows repeat; other columns pass,
    those named like the new ones are replaced.
    """
    path = path or vocabulary_path("piece_bpe_32k.model")

    def make():
        trie = load(path)

        def work(texts: pa.Array) -> list[pa.Array]:
            words = [pretokens(t) for t in texts.to_pylist()]
            return [pa.array([trie.count(w) for w in words], type=pa.int64()), pa.array([len(w) for w in words], type=pa.int64())]

        return work

    return with_arrow(df, text_col, [T.StructField(count_col, T.LongType()), T.StructField(words_col, T.LongType())], make, keep)


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_pretokens of every document."""
    return count_tokens(docs, keep=["doc_id"])
