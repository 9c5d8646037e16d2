"""Streaming queries: a folder of events read as a stream until its end, beside their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.plans.registry import query, read
from tallyspark.sources.shared import Scratch
from tallyspark.streaming import turns as T


def _events_as_stream(spark, d):
    """The events table as a stream of turns."""
    schema = read(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.select((F.col("user_id") % 20).cast("string").alias("module"), F.col("event_id").alias("turn"), F.col("event_type").alias("role"), (F.col("event_id") % 100).alias("tokens"), F.col("ts").cast("timestamp").alias("timestamp"), "value").withWatermark("timestamp", T.WATERMARK)


def _finished(spark, stream, mode="complete", timers=False):
    """Run a stream to its end; its whole result from the shared folder."""
    top = Scratch(spark, "stream", lasting=True).top

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={n}")

    # a stream with timers by the clock would have a batch without data after every batch
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    try:
        spark.conf.set(empty, "false" if timers else before)
        running = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{top}/state").outputMode(mode).trigger(availableNow=True).start()
    finally:
        spark.conf.set(empty, before)
    running.awaitTermination()
    out = spark.read.parquet(f"{top}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.filter(F.col("batch") == last)
    return out.drop("batch")


@query("stream_heartbeat", "select (user_id % 20)::varchar as module, epoch_us(date_trunc('minute', ts)) as minute, count(*) as turns, sum(event_id % 100)::bigint as tokens from events group by all")
def stream_heartbeat(spark, d):
    """2.11.1, 2.2.2."""
    return _finished(spark, T.heartbeat(_events_as_stream(spark, d))).withColumn("minute", F.unix_micros("minute"))


@query("stream_sessions", """with e as (select (user_id % 20)::varchar as module, ts, ts - lag(ts) over (partition by user_id % 20 order by ts) >= interval 180 second as gap from events), s as (select *, sum(case when gap then 1 else 0 end) over (partition by module order by ts rows unbounded preceding) as n from e)
select module, epoch_us(min(ts)) as start, epoch_us(max(ts)) + 180000000 as "end", count(*) as turns from s group by module, n""")
def stream_sessions(spark, d):
    """2.11.4: an idle gap of 180 seconds ends a session."""
    out = _finished(spark, T.sessions(_events_as_stream(spark, d)))
    return out.withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


@query("stream_watchdog", """with s as (select user_id as key, event_id as n, value, value - lag(value) over w as dv from events window w as (partition by user_id order by event_id)), l as (select *, min(dv) over w as lo, count(dv) over w as c from s window w as (partition by key order by n rows between 1 preceding and current row)) select key, n, value from l where c = 2 and lo >= 1 and value >= 5""")
def stream_watchdog(spark, d):
    """2.11.6: state for each key; the same alarms as the window query."""
    schema = read(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), "value")
    return _finished(spark, T.watchdog(rows, k=2), "append")


#: A close every 37th event, and pieces of the words that end a stream.
PIECE = "case when event_id % 37 = 36 then null when event_id % 4 = 0 then 'response.' when event_id % 4 = 1 then 'comp' when event_id % 4 = 2 then 'leted ' else 'failed ' end"


@query("stream_relay", f"""with e as (select user_id::varchar as stream, event_id, {PIECE} as text, count(*) filter (where event_id % 37 = 36) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as part from events),
w as (select stream, part, coalesce(string_agg(text, '' order by event_id), '') as whole, bool_or(text is null) as closed from e group by stream, part)
select stream, 'chunk' as kind, text, count(*) as n from e where text is not null group by stream, text
union all select stream, case when contains(whole, 'response.failed') then 'failed' when contains(whole, 'response.completed') then 'done' else 'truncated' end as kind, null, count(*) from w where closed group by all""")
def stream_relay(spark, d):
    """2.11.4: chunks as they came and how each stream ended, by words that may come in three chunks."""
    schema = read(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    chunks = rows.select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("pos"), F.expr(PIECE).alias("text"))
    out = T.relayed(chunks, ["response.completed"], 3_600_000, failed=("response.failed",))
    return _finished(spark, out, "append", timers=True).groupBy("stream", "kind", "text").agg(F.count("*").alias("n"))


@query("active_module", "select arg_max(user_id, ts) as module, epoch_us(max(ts)) as seen, true as live from events")
def active_module(spark, d):
    """2.11.5: the clock is a parameter, here 100 seconds after the last event."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.agg(F.max_by("user_id", "ts").alias("module"), F.unix_micros(F.max("ts")).alias("seen"))
    now = F.col("seen") + 100 * 1_000_000
    return last.withColumn("live", (now - F.col("seen")) < 300 * 1_000_000)
