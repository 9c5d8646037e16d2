"""Folds of arrays that stay cheap for long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the optimizer does with projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``join`` over an array, each up to its element.

    Arrays grow by copies, so the work is done in blocks of about the square root of
    the size: n * sqrt(n) copied elements at most, where one fold would copy n * n.
    """

    def fold(a: Column) -> Column:
        start = F.slice(a, 1, 1)
        return F.aggregate(F.slice(a, F.lit(2), F.size(a)), start, lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))

    def of(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda k: fold(F.slice(a, k * width + 1, width)))

        def add(p: Column) -> Column:
            ends = fold(F.transform(p, lambda x: F.element_at(x, -1)))
            return let(F.struct(p.alias("p"), ends.alias("e")), lambda s: F.flatten(F.transform(s["p"], lambda x, k: F.when(k == 0, x).otherwise(F.transform(x, lambda y: join(F.get(s["e"], k - 1), y))))))

        return F.when(F.size(a) == 0, a).otherwise(let(parts, add))

    return let(values, of)
