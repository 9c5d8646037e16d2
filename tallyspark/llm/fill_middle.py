"""Operator 11: fill-in-middle over packed boundary bitvectors with rank and select.

A text is UTF-8 bytes; a bit is set where a code point begins. The bits are packed
into 64-bit words, and a directory holds the set bits before each block of words.
The directory's total is the number of code points; select on two ranks gives the
two byte cuts, so no text is decoded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import with_arrow

#: What stands before the three parts; a text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: Of 100 texts so many are transformed, and of 100 of these so many put the suffix first.
SHARE, SPM_SHARE = 90, 20

#: 64-bit words of a block of the directory.
BLOCK_WORDS = 8


class Boundaries:
    """Where the code points of UTF-8 bytes begin, as a bitvector with rank and select."""

    def __init__(self, data: np.ndarray) -> None:
        self.n_bytes = len(data)
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        self.words = np.zeros(-(-len(bits) // (8 * BLOCK_WORDS)) * BLOCK_WORDS, dtype="<u8")
        self.words.view(np.uint8)[: len(bits)] = bits
        in_block = np.bitwise_count(self.words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(in_block)])

    @property
    def total(self) -> int:
        """Number of code points."""
        return int(self.before[-1])

    def rank(self, at: int) -> int:
        """Code points that begin before byte ``at``."""
        word, bit = divmod(at, 64)
        block = word // BLOCK_WORDS
        count = int(self.before[block]) + int(np.bitwise_count(self.words[block * BLOCK_WORDS : word]).sum())
        return count + (int(self.words[word]) & ((1 << bit) - 1)).bit_count() if bit else count

    def select(self, k: int) -> int:
        """The byte at which code point ``k`` (from 0) begins; the end for k = total."""
        if k >= self.total:
            return self.n_bytes
        block = int(np.searchsorted(self.before, k, side="right")) - 1
        left, at = k - int(self.before[block]), block * BLOCK_WORDS
        while (here := int(self.words[at]).bit_count()) <= left:
            left -= here
            at += 1
        word = int(self.words[at])
        for _ in range(left):
            word &= word - 1  # drop the lowest set bit
        return at * 64 + (word & -word).bit_length() - 1


def draws(doc_id: str | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of ``seed`` and a document; a missing id draws as ''."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def transformed(text: bytes, drawn: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    bounds = Boundaries(np.frombuffer(text, dtype=np.uint8))
    n = bounds.total
    if not text or drawn[2] % 100 >= SHARE or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = bounds.select(first), bounds.select(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if drawn[3] % 100 < SPM_SHARE:
        return n, "spm", first, second - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, second - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def _strings(parts: list[bytes]) -> pa.Array:
    """Bytes that are UTF-8 already, as an Arrow string array without decoding."""
    return pa.array(parts, type=pa.binary()).view(pa.string())


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output.

    The cuts and the form are drawn from ``seed`` and the id alone, so a lost task
    repeats them. Null and empty texts are plain with n 0 and output ''; so is a
    text that holds a marker, which could not be taken apart again, with its own text
    as output. A null id draws as an empty one, repeated rows come out alike, an empty
    table gives an empty one. Other columns pass (or those in ``keep``); those named
    like a new one give way.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    handle = "_drawn"
    while handle in docs.columns:
        handle = "_" + handle
    passing = [c for c in (docs.columns if keep is None else keep) if c not in names]
    both = F.struct(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    rows = docs.select(*[F.col(f"`{c}`") for c in passing], both.alias(handle))

    def make():
        def work(pairs: pa.Array) -> list[pa.Array]:
            ids, texts = pairs.field("id").to_pylist(), pairs.field("text")
            done = [transformed(t.as_py() or b"", draws(i, seed)) for i, t in zip(ids, texts)]
            n, form, first, middle, output = zip(*done) if done else ([],) * 5
            whole = [pa.array(n, pa.int64()), pa.array(form, pa.string())]
            return [*whole, pa.array(first, pa.int64()), pa.array(middle, pa.int64()), _strings(list(output))]

        return work

    fields = [T.StructField(c, kind()) for c, kind in zip(names, (T.LongType, T.StringType, T.LongType, T.LongType, T.StringType))]
    return with_arrow(rows, handle, fields, make, keep=passing)


def rebuilt(output: Column, form: Column) -> Column:
    """The text from its output and form, by DataFrame functions.

    A transformed text holds no marker, so each marker's first place is its own.
    """

    def between(after: bytes, until: bytes | None) -> Column:
        rest = F.substring_index(output, after.decode(), -1) if until is None else F.split_part(output, F.lit(after.decode()), F.lit(2))
        return rest if until is None else F.split_part(rest, F.lit(until.decode()), F.lit(1))

    middle = between(MIDDLE, None)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def middles(docs: DataFrame) -> DataFrame:
    """The contract's digests of all documents."""
    done = fill_in_middle(docs, keep=["doc_id"])
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def oracle_sql() -> str:
    """The same rows by substrings of code points."""
    return """
    with drawn as (
      select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
    ), numbers as (
      select doc_id, t, n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
      from drawn
    ), cuts as (
      select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
             when h4 % 100 < 20 then 'spm' else 'psm' end as form
      from numbers
    ), parts as (
      select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1) as s from cuts
    )
    select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
      sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
      sha256(t) as restored_sha256
    from parts
    """
