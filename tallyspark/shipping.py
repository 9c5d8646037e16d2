"""Make this package importable in Python workers that lack it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_NAME = "tallyspark_src.zip"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once a session."""
    context = spark.sparkContext
    if _NAME in " ".join(map(str, context._python_includes or [])):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyspark-"), _NAME)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
