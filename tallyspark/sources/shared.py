"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` or of ``setCheckpointDir``.

    Local sessions that name none (tests) take a temporary folder; a cluster must
    name one, for its executors do not see each other's disks.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "tallyspark-shared")
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, whatever store the path names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


class Scratch:
    """Tables that cut the lineage of one run; ``clear`` deletes them.

    What a returned DataFrame still reads is kept until the session's end: such
    tables go to a scratch of their own, made with ``lasting``.
    """

    def __init__(self, spark: SparkSession, name: str, lasting: bool = False) -> None:
        self.spark, self.top, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        if lasting:
            atexit.register(self._clear_at_exit)

    def path(self) -> str:
        self.count += 1
        return f"{self.top}/{self.count}"

    def saved(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back. Parquet instead of ``checkpoint()``: half the bytes, prunable columns."""
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove(self.spark, self.top)

    def _clear_at_exit(self) -> None:
        try:
            self.clear()
        except Exception:  # noqa: BLE001  the session is stopped; nothing can be reached any more
            return
