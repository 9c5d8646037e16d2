"""Operator 9: order-preserving packing of documents into sequences.

The documents of an input split, in their order, form one stream of tokens. A
dynamic program chooses the window cuts, at document or sentence ends where it
can, to minimise padding plus penalties for cut documents; the minimum over all
windows of up to CONTEXT tokens comes from a monotone queue.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.bpe import WordBpe, load, vocabulary_path
from tallyspark.shipping import ship

CONTEXT, END_ID = 2048, 1

#: Tokens of padding that a window, a cut at a sentence's end and a cut elsewhere are worth.
WINDOW, SENTENCE, HARD = 64.0, 4.0, 16.0

#: A gap without natural cuts is cut at this step at least; a chunk of the stream
#: is packed when it has CHUNK tokens, which bounds the memory of a task.
STEP, CHUNK = 64, 400_000

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def padding(length: int, context: int = CONTEXT) -> int:
    """Padding of a sequence: up to the context, none at a power of two."""
    return 0 if length & (length - 1) == 0 else context - length


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Positions of possible cuts in a stream, ascending from 0, and their penalties.

    Every place in the last context is one, so that the stream's end needs no padding.
    """
    total = int(doc_ends[-1])
    natural = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    gaps = np.diff(natural)
    wide = np.flatnonzero(gaps > STEP)
    inner = [np.arange(natural[i] + STEP, natural[i + 1], STEP) for i in wide]
    tail = np.arange(max(0, total - context), total)
    place = np.unique(np.concatenate([natural, *inner, tail]))
    cost = np.full(len(place), HARD)
    cost[np.isin(place, sentence_ends, assume_unique=False)] = SENTENCE
    cost[np.searchsorted(place, doc_ends)] = 0.0
    cost[0] = 0.0
    return place, cost


def best_cuts(place: np.ndarray, cost: np.ndarray, context: int = CONTEXT) -> list[int]:
    """Indexes of the cuts of least total cost, the first and the last place included.

    A window from i to j costs padding(j - i) + WINDOW + cost[j]. Without the
    powers of two it is place[i] + best[i] less what only j decides, so the least
    i in reach is the head of a queue of rising values; the powers of two are the
    places exactly so far back.
    """
    n = len(place)
    exact: dict[int, list[int]] = {}
    size = 1
    while size <= context:
        back = np.minimum(np.searchsorted(place, place - size), n - 1)
        for j in np.flatnonzero(place[back] == place - size):
            exact.setdefault(int(j), []).append(int(back[j]))
        size *= 2
    at, price = place.tolist(), cost.tolist()
    best, came = [0.0] * n, [0] * n
    queue, values, head = [0], [0.0], 0
    for j in range(1, n):
        here = at[j]
        while at[queue[head]] < here - context:
            head += 1
        i = queue[head]
        low, source = values[head] + context - here, i
        for k in exact.get(j, ()):
            if best[k] < low:
                low, source = best[k], k
        best[j], came[j] = low + WINDOW + price[j], source
        value = best[j] + here
        while len(queue) > head and values[-1] >= value:
            queue.pop()
            values.pop()
        queue.append(j)
        values.append(value)
    cuts, j = [n - 1], n - 1
    while j:
        j = came[j]
        cuts.append(j)
    return cuts[::-1]


@lru_cache(maxsize=2)
def sentence_marks(path: str) -> np.ndarray:
    """Whether a token id ends a sentence."""
    bpe = load(path, False)
    marks = np.zeros(max(bpe.strings) + 1, dtype=bool)
    for i, s in bpe.strings.items():
        word = s.removesuffix(bpe.end)
        marks[i] = s.endswith(bpe.end) and word != "" and word[0] in ".!?" or word in ("。",)
    return marks


def pack(ids: list[np.ndarray], doc_ids: list, marks: np.ndarray, first_sequence: int) -> tuple[dict[str, list], int]:
    """Columns of PIECES for a chunk of documents and the next free sequence id."""
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    ends = np.cumsum(lengths)
    stream = np.ascontiguousarray(np.concatenate(ids), dtype="<u4")
    sentence_ends = np.flatnonzero(marks[stream]) + 1
    place, cost = candidates(ends, sentence_ends)
    cuts = place[best_cuts(place, cost)]
    bounds = np.unique(np.concatenate([cuts, ends]))
    begin, end = bounds[:-1], bounds[1:]
    doc = np.searchsorted(ends, begin, side="right")
    window = np.searchsorted(cuts, begin, side="right") - 1
    view = memoryview(stream).cast("B")
    out = {
        "doc_id": [doc_ids[d] for d in doc],
        "start": (begin - (ends - lengths)[doc]).tolist(),
        "length": (end - begin).tolist(),
        "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)],
        "doc_tokens": lengths[doc].tolist(),
        "sequence_id": (window + first_sequence).tolist(),
        "offset": (begin - cuts[window]).tolist(),
    }
    return out, first_sequence + len(cuts) - 1


def document_ids(bpe: WordBpe, text: str | None) -> np.ndarray:
    """Ids of a whole text (null: none), then END_ID."""
    return np.append(np.frombuffer(bpe.packed(text), dtype="<u4"), np.uint32(END_ID))


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each piece: PIECES.

    Every id of a document lies in one piece, pieces keep the order of the rows in
    their input split, a sequence holds CONTEXT tokens at most and its pieces'
    offsets are gapless from 0. sequence_id is unique over all splits. Null texts
    have the end id only; repeated rows are packed each; empty tables give an
    empty one; other columns are not read.
    """
    path = path or vocabulary_path()
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, marks = load(path, False), sentence_marks(path)
        sequence = TaskContext.get().partitionId() << 33
        ids: list[np.ndarray] = []
        docs: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            out, sequence = pack(ids, docs, marks, sequence)
            ids.clear()
            docs.clear()
            held = 0
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([(f.name, pa.int64()) for f in PIECES]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(document_ids(bpe, text))
                docs.append(doc_id)
                held += len(ids[-1])
                if held >= CHUNK:
                    yield flush()
        if ids:
            yield flush()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
