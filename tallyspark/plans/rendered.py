"""Texts made of table rows: what a runner, an editor or a model would have written about them.

The parsers read these texts back; the SQL beside a query works on the rows that the
texts were made of and never sees a text, so both agree only if the parser is right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.registry import read

#: The numbers that texts are made of, in SQL: a user is a document, an event one line.
E = "e as (select user_id as doc, event_id as pos, event_id % 37 as i, event_id % 4 as k, event_id % 1000 as ms, event_id % 3 as p from events)"
STATUS = "case k when 0 then 'PASSED' when 1 then 'FAILED' else 'SKIPPED' end"


def numbers(spark, d) -> DataFrame:
    """(doc, pos, i, k, ms, p): the same numbers."""
    n = F.col("event_id")
    return read(spark, d, "events").select(F.col("user_id").alias("doc"), n.alias("pos"), (n % 37).alias("i"), (n % 4).alias("k"), (n % 1000).alias("ms"), (n % 3).alias("p"))


def text_of(rows: DataFrame, line: str | Column, by: str = "doc", glue: str = "\n") -> DataFrame:
    """(doc, text): the lines of each document in the order of ``pos``; null lines are left out."""
    line = F.expr(line) if isinstance(line, str) else line
    parts = rows.select(by, "pos", line.alias("line")).filter("line is not null").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("a"))
    return parts.select(by, F.array_join(F.transform("a", lambda x: x["line"]), glue).alias("text"))
