"""Live turns, error watchdog and idle gaps as streams.

There is no event time to copy, so it is defined here: ten minutes of watermark,
an idle gap of 180 seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURN = "module string, turn long, role string, tokens long, timestamp timestamp"
WATERMARK, IDLE = "10 minutes", "180 seconds"


def turn_stream(spark: SparkSession, folder: str, schema: str = TURN) -> DataFrame:
    """Turns as they are appended to a folder of JSON lines."""
    return spark.readStream.schema(schema).json(folder).withWatermark("timestamp", WATERMARK)


def heartbeat(turns: DataFrame) -> DataFrame:
    """Turns and tokens of each module and minute."""
    return turns.groupBy("module", F.window("timestamp", "1 minute")).agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens")).select("module", F.col("window.start").alias("minute"), "turns", "tokens")


def sessions(turns: DataFrame) -> DataFrame:
    """Stretches of a module's turns without an idle gap."""
    return turns.groupBy("module", F.session_window("timestamp", IDLE)).agg(F.count("*").alias("turns")).select("module", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "turns")


def sink(stream: DataFrame, folder: str, checkpoint: str):
    """Append a stream to Parquet, exactly once, until what is there has been read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def watchdog(samples: DataFrame, k: int = 3, least: float = 1.0, floor: float = 5.0) -> DataFrame:
    """(key, n, value) of alarms in a stream of (key, n, value): the last k changes all rise by
    ``least`` and the value reaches ``floor``. The state is a key's last k + 1 values."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        alarms = []
        for row in pd.concat(list(parts)).sort_values("n").itertuples():
            held = [*held[-k:], float(row.value)]
            rises = [b - a for a, b in zip(held, held[1:], strict=False)]
            if len(rises) == k and min(rises) >= least and row.value >= floor:
                alarms.append((key[0], row.n, row.value))
        state.update((held,))
        yield pd.DataFrame(alarms, columns=["key", "n", "value"])

    return samples.groupBy("key").applyInPandasWithState(step, "key long, n long, value double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def relayed(chunks: DataFrame, markers: list[str], interval_ms: int, failed: tuple[str, ...] = (), carry: int = 64) -> DataFrame:
    """(stream, kind, text) of a stream of (stream, pos, text): what a relay passes on.

    Every chunk is a ``chunk`` row as it came, in the order of pos in each trigger; a null text closes
    its stream. A stream that is open and silent for ``interval_ms`` of processing time gives a
    ``keep-alive`` row, and one more for each interval; so it needs a trigger by time. At the close a
    stream gives ``done`` if one of the markers was seen in its text, ``failed`` if one of ``failed``
    was, and else ``truncated``. What follows a close is a new stream.

    The state of a stream is whether a marker and a failure were seen and its last ``carry`` characters, so
    that a marker is found over any number of chunks; it is gone after the close. Empty chunks pass.
    """
    if carry < max(map(len, [*markers, *failed])):
        raise ValueError("carry is shorter than a marker")
    new = (False, False, "\n")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.update(state.get)
            state.setTimeoutDuration(interval_ms)
            yield pd.DataFrame([(key[0], "keep-alive", None)], columns=["stream", "kind", "text"])
            return
        out = []
        seen, bad, tail = state.get if state.exists else new
        is_open = state.exists
        for text in pd.concat(list(parts)).sort_values("pos")["text"]:
            if text is None or text != text:
                out.append((key[0], "failed" if bad else "done" if seen else "truncated", None))
                (seen, bad, tail), is_open = new, False
                continue
            window, is_open = tail + text, True
            seen = seen or any(m in window for m in markers)
            bad = bad or any(m in window for m in failed)
            tail = window[-carry:]
            out.append((key[0], "chunk", text))
        if is_open:
            state.update((seen, bad, tail))
            state.setTimeoutDuration(interval_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["stream", "kind", "text"])

    return chunks.groupBy("stream").applyInPandasWithState(step, "stream string, kind string, text string", "seen boolean, bad boolean, tail string", "append", GroupStateTimeout.ProcessingTimeTimeout)
