"""Functions that are not written yet, from sources in seven languages; inputs are (doc, text)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspark.functions.blocks import marked_functions
from tallyspark.functions.rows import rows_of

#: What stands in a body that is not written yet.
STUB_MARKS = {
    "c": ("STUB_PANIC",),
    "cpp": ("__builtin_trap() /* STUB: not implemented */", "return {}"),
    "go": ('"STUB: not implemented"',),
    "java": ('UnsupportedOperationException("STUB: not implemented")',),
    "js": ('throw new Error("STUB")',),
    "rust": ('panic!("STUB: not implemented")',),
    "ts": ('throw new Error("STUB")',),
}


def source_stubs(docs: DataFrame, language: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """(doc, name, line, signature): the functions of each source that hold a stub, each once.

    ``marks`` are the language's own unless given. Functions are found by their brackets, so a mark in
    a comment or a string is none, and one in a closure belongs to the function around it. Null and
    empty sources give no rows; repeated rows give theirs again; other columns are not read.
    """
    sought = tuple(marks) or STUB_MARKS[language]
    fields = {"name": (T.StringType(), pa.string()), "line": (T.IntegerType(), pa.int32()), "signature": (T.StringType(), pa.string())}
    return rows_of(docs, "doc", "text", fields, lambda s: marked_functions(s, language, sought) if s else [])
