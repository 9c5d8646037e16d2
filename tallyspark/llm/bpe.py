"""Operator 1: BPE encoding and decoding.

A text is normalised and cut into pre-tokens; each distinct pre-token is merged
once with a priority queue of merge ranks over a doubly linked list of symbols,
in which entries that an earlier merge made stale are skipped. Decoding joins
the vocabulary strings of the ids.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import Memo, with_arrow

#: Last code point of the range in which Python and the tokenizer's regular
#: expressions agree on letters and digits and NFC changes nothing.
PLAIN_LIMIT = 0x24F


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in letters]
    return [letters.get(b) or chr(256 + hidden.index(b)) for b in range(256)]


def plain_pattern() -> re.Pattern:
    """Contractions, letter runs, single digits, runs of other signs; for texts up to PLAIN_LIMIT."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(PLAIN_LIMIT + 1) if unicodedata.category(chr(c))[0] == kind)
    letters, digits = of("L"), of("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\x09-\x0d \x85\xa0{letters}{digits}]+")


def other_pattern() -> re.Pattern:
    """A sign beyond PLAIN_LIMIT, or one whose lower case holds such a sign."""
    rising = "".join(chr(c) for c in range(PLAIN_LIMIT + 1) if max(chr(c).lower()) > chr(PLAIN_LIMIT))
    return re.compile(f"[{rising}{chr(PLAIN_LIMIT + 1)}-{chr(0x10FFFF)}]")


class WordBpe:
    """Encoder and decoder for a byte-level BPE vocabulary with word ends."""

    def __init__(self, path: str, own_merges: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.ids, self.end = path, model["vocab"], model["end_of_word_suffix"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        self.letters = byte_letters()
        self.plain = plain_pattern()
        self.other = other_pattern()
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.words = Memo(self.merged if own_merges else self.library_word)
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a piece without special tokens. Beyond the plain range the
        library's own Unicode tables normalise and cut."""
        if self.other.search(text) is None:
            return self.plain.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def symbols(self, word: str) -> list[str]:
        parts = [self.letters[b] for b in word.encode("utf-8")]
        parts[-1] += self.end
        return parts

    def merged(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit words."""
        parts = self.symbols(word)
        n, ranks = len(parts), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # stale: one of the two symbols has been merged meanwhile
            parts[i], parts[j] = left + right, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(queue, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(queue, (r, h, parts[h], parts[i]))
        return np.array([self.ids[p] for p in parts if p], dtype="<u4").tobytes()

    def library_word(self, word: str) -> bytes:
        """The same ids from the tokenizers library's model."""
        letters = "".join([self.letters[b] for b in word.encode("utf-8")])
        return np.array([t.id for t in self.library.model.tokenize(letters)], dtype="<u4").tobytes()

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit words; null counts as empty."""
        if not text:
            return b""
        out, at, words = [], 0, self.words
        for m in self.specials.finditer(text) if "<|" in text else ():
            out += map(words.__getitem__, self.pretokens(text[at : m.start()]))
            out.append(np.array([self.special[m[0]]], dtype="<u4").tobytes())
            at = m.end()
        out += map(words.__getitem__, self.pretokens(text[at:] if at else text))
        return b"".join(out)

    def decoded(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str, own_merges: bool = True) -> WordBpe:
    """One encoder per Python worker, so that its memo lasts over tasks."""
    return WordBpe(path, own_merges)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array of numpy parts."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], type=kind))


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids_col``, the ids of each whole text.

    Null and empty texts give an empty array; repeated rows are each encoded;
    other columns pass (or those in ``keep``), one named ``ids_col`` is replaced.
    """
    path = path or vocabulary_path()

    def make():
        bpe = load(path)

        def work(texts: pa.Array) -> list[pa.Array]:
            return [list_array([np.frombuffer(bpe.packed(t), dtype="<i4") for t in texts.to_pylist()], pa.int32())]

        return work

    return with_arrow(df, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make, keep)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``out_col``: the vocabulary strings of the ids joined as the tokenizers
    library joins them when a file names no decoder (one space). Null ids give ''."""
    path = path or vocabulary_path()

    def make():
        bpe = load(path)

        def work(ids: pa.Array) -> list[pa.Array]:
            return [pa.array([bpe.decoded(x) if x else "" for x in ids.to_pylist()], type=pa.string())]

        return work

    return with_arrow(df, ids_col, [T.StructField(out_col, T.StringType())], make, keep)


def round_trip(df: DataFrame) -> DataFrame:
    """The contract's digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(df, keep=["doc_id"]), keep=["doc_id", "ids"])
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
