"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.shipping import ship

#: Bytes that separate words in the contracts: space, tab, LF, VT, FF, CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows of an Arrow batch that are worked on at once, so long texts stay few.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_arrow(
    df: DataFrame,
    source: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (default: all) and new columns computed from ``source``.

    ``make`` is called once a task and returns the function from an Arrow array
    to the arrays of ``fields``. A kept column named like a new one gives way.
    """
    ship(df.sparkSession)
    names = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    handle = "_source"
    while handle in kept:
        handle = "_" + handle
    chosen = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias(handle))
    schema = T.StructType([*[chosen.schema[c] for c in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *work(part.column(part.num_columns - 1))], names=[*kept, *names])

    return chosen.mapInArrow(run, schema)


class Memo(dict):
    """A dict that computes missing values and forgets those long unused.

    Two generations of at most ``limit`` entries bound its memory; a value that
    is dropped is only computed again.
    """

    def __init__(self, compute: Callable, limit: int = 200_000) -> None:
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value
