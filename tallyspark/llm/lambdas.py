"""Small builders for higher-order column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.arrays import let, running  # noqa: F401  used by the operators beside words


def words(text: Column) -> Column:
    """Words of a text: what space, tab, LF, VT, FF and CR separate."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def shingle_hashes(w: Column, width: int) -> Column:
    """64-bit hashes of the ``width``-word windows of an array of words, in order;
    of fewer words the one of the whole sequence; of none an empty array."""

    def of(a: Column) -> Column:
        window = F.transform(F.sequence(F.lit(0), F.size(a) - width), lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(width)]))
        whole = F.array(F.xxhash64(F.array_join(a, " ")))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(a) >= width, window).when(F.size(a) > 0, whole).otherwise(none)

    return let(w, of)
