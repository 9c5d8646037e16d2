"""Order-sensitive operators: each has an explicit position column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a task that sorts whole groups, about.
ROWS = 250_000


def collapse_adjacent(rows: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Drop rows equal in ``same`` to the row just before."""
    w = Window.partitionBy(*by).orderBy(*order)
    key = F.struct(*same)
    return rows.withColumn("_before", F.lag(key).over(w)).filter(~key.eqNullSafe(F.col("_before"))).drop("_before")


def clamp_timestamps(rows: DataFrame, by: list[str], order: list[str], ts: str, out: str = "clamped") -> DataFrame:
    """Strictly rising microseconds: t'(i) = max(t(i), t'(i-1) + 1), in closed form; null times stay null."""
    w = Window.partitionBy(*by).orderBy(*order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ranked = rows.withColumn("_n", F.count(ts).over(w))
    raised = ranked.withColumn("_high", F.max(micros - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return raised.withColumn(out, F.when(F.col(ts).isNotNull(), F.col("_high") + F.col("_n"))).drop("_n", "_high")


def apportion(rows: DataFrame, by: list[str], order: list[str], weight: str, target: str, out: str = "share", place: str | None = None) -> DataFrame:
    """Split an integer target by integer weights; what is left goes to the largest remainders,
    ties to the later row; with no weight at all the last row takes everything. ``place`` names a
    column for the row's place in its group, from 1."""
    # tasks grow in number with the rows, whatever the session says: each sorts about ROWS of them
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS)), *by)
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.sum(weight).over(w)).withColumn("_n", F.count("*").over(w))
    product = F.col(target) * F.col(weight)
    ranked = ranked.withColumn("_base", F.when(F.col("_all") > 0, F.floor(product / F.col("_all"))).otherwise(0)).withColumn("_rest", F.when(F.col("_all") > 0, product % F.col("_all")).otherwise(0))
    ranked = ranked.withColumn("_left", F.col(target) - F.sum("_base").over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_rest"), F.desc("_i"))))
    share = F.when(F.col("_all") > 0, F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("long")).otherwise(F.when(F.col("_i") == F.col("_n"), F.col(target)).otherwise(0))
    done = ranked.withColumn(out, share.cast("long"))
    done = done if place is None else done.withColumn(place, F.col("_i"))
    return done.drop("_i", "_all", "_n", "_base", "_rest", "_left", "_rank")


def stage_regression(stages: DataFrame) -> DataFrame:
    """(run, regressed, constant_tests): passes must not drop between scored stages; null below two of them."""
    w = Window.partitionBy("run").orderBy("stage")
    scored = stages.filter("num_passed is not null").withColumn("drop", F.col("num_passed") < F.lag("num_passed").over(w))
    few = F.count("*") < 2
    return scored.groupBy("run").agg(F.when(~few, F.coalesce(F.bool_or("drop"), F.lit(False))).alias("regressed"), F.when(~few, F.count_distinct("num_tests") == 1).alias("constant_tests"))


def never_rises(turns: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Groups with two turns or more: whether a value ever rises, and the first turn at which it does."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = turns.withColumn("_rise", F.col(value) > F.lag(value).over(w))
    out = marked.groupBy(*by).agg(F.count("*").alias("turns"), F.min(F.when(F.col("_rise"), F.col(order))).alias("first_rise"))
    return out.filter("turns >= 2").withColumn("holds", F.col("first_rise").isNull())


def cumulative(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    return rows.withColumn(out, F.round(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), 4))


def best_of(samples: DataFrame, by: list[str], order: str, rate: str) -> DataFrame:
    """The earliest sample of the best rate; the first one when every rate is 0."""
    return samples.groupBy(*by).agg(F.max_by(order, F.struct(F.greatest(F.col(rate), F.lit(0.0)), -F.col(order))).alias("best"), F.greatest(F.lit(0.0), F.max(rate)).alias("best_rate"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("duplicate", F.count("*").over(Window.partitionBy(*keys)) > 1)


def first_and_last(rows: DataFrame, by: list[str], pos: str, value: str, first_if, last_if) -> DataFrame:
    """The first value where one condition holds and the last where another does."""
    return rows.groupBy(*by).agg(F.min_by(F.when(first_if, F.col(value)), F.when(first_if, F.col(pos))).alias("first_value"), F.max_by(F.when(last_if, F.col(value)), F.when(last_if, F.col(pos))).alias("last_value"))


def blocks(lines: DataFrame, by: list[str], pos: str, marker) -> DataFrame:
    """Add ``block``: how many marker lines there are up to each line."""
    return lines.withColumn("block", F.sum(F.coalesce(marker, F.lit(False)).cast("int")).over(Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))


def role_runs(lines: DataFrame, by: list[str], pos: str, role) -> DataFrame:
    """Carry the last role forward (not into code fences) and number its maximal runs."""
    w = Window.partitionBy(*by).orderBy(pos)
    fence = F.col("text").startswith("```")
    rows = lines.withColumn("_fenced", F.sum(fence.cast("int")).over(w) % 2 == 1)
    rows = rows.withColumn("_role", F.last(F.when(~F.col("_fenced"), role), ignorenulls=True).over(w))
    rows = rows.withColumn("_new", ~F.col("_role").eqNullSafe(F.lag("_role").over(w)))
    return rows.withColumn("run", F.sum(F.col("_new").cast("int")).over(w)).withColumnRenamed("_role", "role").drop("_fenced", "_new")


def rising_errors(samples: DataFrame, by: list[str], order: str, value: str, k: int = 3, least: float = 1, floor: float = 5) -> DataFrame:
    """Samples at which the last k changes all reach ``least`` and the value reaches ``floor``."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = samples.withColumn("_d", F.col(value) - F.lag(value).over(w))
    last = w.rowsBetween(-(k - 1), 0)
    rows = rows.withColumn("_low", F.min("_d").over(last)).withColumn("_n", F.count("_d").over(last))
    return rows.withColumn("alarm", F.coalesce((F.col("_n") == k) & (F.col("_low") >= least) & (F.col(value) >= floor), F.lit(False))).drop("_d", "_low", "_n")


def resume_points(stages: DataFrame) -> DataFrame:
    """The first stage without a result of each run; null when all have one."""
    return stages.groupBy("run").agg(F.min(F.when(F.col("result").isNull(), F.col("stage"))).alias("resume_at"))


def highest_stage(patches: DataFrame) -> DataFrame:
    """Each module's patch of the highest stage."""
    return patches.groupBy("module").agg(F.max_by("patch", "stage").alias("patch"), F.max("stage").alias("stage"))


def repeated_errors(lines: DataFrame, by: list[str], pos: str, key: str) -> DataFrame:
    """Drop repeats of an error line and what follows them up to the next blank line."""
    w = Window.partitionBy(*by).orderBy(pos)
    nth = F.row_number().over(Window.partitionBy(*by, key).orderBy(pos))
    blank = F.trim("text") == ""
    mark = F.when(F.col(key).isNotNull(), F.when(nth > 1, "skip").otherwise("keep")).when(blank, "keep")
    rows = lines.withColumn("_mark", mark)
    return rows.withColumn("_state", F.coalesce(F.last("_mark", ignorenulls=True).over(w), F.lit("keep"))).filter("_state = 'keep'").drop("_mark", "_state")
