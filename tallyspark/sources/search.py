"""Searches that show a page at a time and a limited number of hits: by ranges of a value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def search_ranges(items: DataFrame, value_col: str, limit: int, bits: int) -> DataFrame:
    """(lo, hi, n, over) of the ranges lo <= value < hi that a search for all ``items`` asks for.

    From 0 to 2 ** ``bits`` ranges are halved until each holds ``limit`` items at most;
    ``over`` marks single values of more. All halvings are counted at once, on the
    counts of the values, so a value of very many items is one row of each depth.
    """
    counts = items.groupBy(F.col(value_col).cast("long").alias("v")).agg(F.count("*").alias("c")).filter(f"v >= 0 and v < {1 << bits}")
    spread = counts.select("v", "c", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    size = F.expr(f"shiftleft(1L, {bits} - depth)")
    cells = spread.withColumn("lo", F.expr(f"v - v % shiftleft(1L, {bits} - depth)")).groupBy("depth", "lo").agg(F.sum("c").alias("n")).withColumn("hi", F.col("lo") + size)
    # a range is asked for if it is small enough and the one that it is half of is not
    whole = cells.select((F.col("depth") + 1).alias("depth"), F.col("lo").alias("up"), F.col("n").alias("above"))
    halves = cells.withColumn("up", F.expr(f"lo - lo % shiftleft(1L, {bits} - depth + 1)")).join(whole, ["depth", "up"], "left")
    final = (F.col("n") <= limit) | (F.col("depth") == bits)
    return halves.filter(final & (F.col("above").isNull() | (F.col("above") > limit))).select("lo", "hi", "n", (F.col("n") > limit).alias("over"))


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


def halved(count: Callable[[int, int], int], lo: int, hi: int, limit: int) -> Iterator[tuple[int, int]]:
    """The ranges, in order, into which a search of [lo, hi) falls until each has ``limit`` hits at most."""
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        n = count(lo, hi)
        if n > limit and hi - lo > 1:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
        elif n:
            yield lo, hi


def paged_search(count: Callable[[int, int], int], page: Callable[[int, int, int], list[tuple]], ddl: str, most: int, limit: int = 1000, name: str = "paged_search") -> type[DataSource]:
    """A data source to register: one task reads each range of 0 to ``most``.

    ``count(lo, hi)`` tells the hits of a range, ``page(lo, hi, k)`` its k-th page of rows
    of ``ddl``, empty after the last. Ranges are halved until they hold ``limit`` hits,
    which is what the search shows; a single value of more is read as far as it goes.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Range(*r) for r in halved(count, 0, most, limit)] or [_Range(0, 0)]

        def read(self, partition: _Range) -> Iterator[tuple]:
            k = 0
            while partition.hi > partition.lo and (rows := page(partition.lo, partition.hi, k)):
                yield from rows
                k += 1

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ddl

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Search
