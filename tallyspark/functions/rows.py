"""Rows that Python makes of texts, a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.shipping import ship

#: Characters, and 32 for each row, after which the rows made so far leave a task.
FLUSH = 1_000_000


def pieces(batch: pa.RecordBatch, fields: pa.Schema, work: Callable[[str | None], Iterable[tuple]]) -> Iterator[pa.RecordBatch]:
    """Batches of about FLUSH characters of the rows that ``work`` gives for the texts of a batch (key, text)."""

    def made(at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        cells = [pa.array(c, type=field.type) for c, field in zip(zip(*rows), fields, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, type=pa.int32())), *cells], names=[batch.schema.names[0], *fields.names])

    at, rows, size = [], [], 0
    for k in range(batch.num_rows):
        for row in work(batch.column(1)[k].as_py()):
            at.append(k)
            rows.append(row)
            size += 32 + sum(len(c) for c in row if isinstance(c, str))
            if size >= FLUSH:
                yield made(at, rows)
                at, rows, size = [], [], 0
    if rows:
        yield made(at, rows)


def rows_of(docs: DataFrame, key: str, text: str, fields: dict[str, tuple[T.DataType, pa.DataType]], work: Callable[[str | None], Iterable[tuple]]) -> DataFrame:
    """(``key``, *fields): the rows that ``work`` gives for each text, in its order.

    A text is decoded in its turn and rows leave in pieces, so a task holds a batch of texts,
    what is made of one of them and a piece of rows, not the rows of all texts.
    """
    ship(docs.sparkSession)
    chosen = docs.select(key, F.col(text).alias("_text"))
    schema = T.StructType([chosen.schema[key], *[T.StructField(name, kind) for name, (kind, _) in fields.items()]])
    kinds = pa.schema([(name, kind) for name, (_, kind) in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pieces(batch, kinds, work)

    return chosen.mapInArrow(run, schema)
