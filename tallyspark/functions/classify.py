"""Classifiers of failures, outcomes and compiler output: ordered conditions, the first holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Signs of failures that do not come from the code, and exit codes of kills.
TRANSIENT_MARKS = (
    "econnreset", "etimedout", "connection reset", "connection refused", "temporary failure in name resolution", "read timed out", "429 too many requests",
    "503 service unavailable", "no space left on device", "oomkilled", "gateway timeout", "tls handshake timeout", "i/o timeout",
)
KILLED = (124, 137, 143)


def infra_failure(stderr: Column, exit_code: Column) -> Column:
    """infra_transient for lost networks, kills and full disks, else genuine."""
    text, lost = F.lower(F.coalesce(stderr, F.lit(""))), F.lit(False)
    for mark in TRANSIENT_MARKS:
        lost = lost | F.contains(text, F.lit(mark))
    return F.when(F.coalesce(exit_code.isin(*KILLED), F.lit(False)) | lost, "infra_transient").otherwise("genuine")


def http_error(status: Column, body: Column, tokens_left: Column) -> Column:
    """The kind of a failed model call."""
    text = F.lower(F.coalesce(body, F.lit("")))
    cap = tokens_left.eqNullSafe(F.lit(0)) | text.rlike("usage limit|quota|monthly limit")
    return (
        F.when(status.isin(401, 403), "auth").when((status == 429) & cap, "cap").when(status == 429, "rate_limit").when(status == 529, "overloaded")
        .when(status >= 500, "server").when((status == 400) & text.rlike("context|too long"), "context").when(status >= 400, "client").otherwise("ok")
    )


def patch_failed(log: Column, window: int = 8192) -> Column:
    """Whether the head or the tail of a log says that the patch did not apply."""
    seen = lambda part: F.contains(part, F.lit("PATCH_APPLY_FAILED"))
    return F.coalesce(seen(F.substring(log, 1, window)) | seen(F.right(log, F.lit(window))), F.lit(False))


def timed_out(exit_code: Column) -> Column:
    return F.coalesce(exit_code.isin(124, 137, 143), F.lit(False))


def impossible_claim(passed: Column, tests: Column, exit_code: Column) -> Column:
    """All tests said to pass though the run failed."""
    return F.coalesce((exit_code != 0) & (tests > 0) & (passed >= tests), F.lit(False))


#: What the compiler says of broken syntax, and of names and types.
SYNTAX_ERRORS = [
    "';' expected", "'{' expected", "'}' expected", "')' expected", "'(' expected", "class, interface, enum, or record expected", "class, interface, or enum expected",
    "reached end of file while parsing", "illegal start of expression", "illegal start of type", "illegal character", "unclosed string literal", "unclosed character literal",
    "unclosed comment", "identifier expected",
]
SEMANTIC_ERRORS = ["cannot find symbol", "package ", "cannot access", "cannot resolve", "does not exist", "not a statement", "incompatible types", "method does not override"]


def compiler_counts(output: Column) -> Column:
    """(syntax, semantic, other): the lines with ``: error:`` by kind, syntax tested first."""

    def holds(marks: list[str]):
        return lambda line: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(line, m))

    errors = F.transform(F.filter(F.split(output, r"\r\n|\n|\r", -1), lambda x: F.contains(x, F.lit(": error:"))), lambda x: F.lower(x))
    syntax, semantic = holds(SYNTAX_ERRORS), holds(SEMANTIC_ERRORS)
    n_syntax, n_semantic = F.size(F.filter(errors, syntax)), F.size(F.filter(errors, lambda x: ~syntax(x) & semantic(x)))
    return F.struct(n_syntax.alias("syntax"), n_semantic.alias("semantic"), (F.size(errors) - n_syntax - n_semantic).alias("other"))


def framework(output: Column) -> Column:
    """The test framework that wrote an output, by the first of its marks that occurs."""
    mark = lambda s: F.contains(output, F.lit(s))
    return (
        F.when(mark("[==========]") | mark("[ RUN      ]") | mark("[  PASSED  ]"), "gtest")
        .when(mark("[doctest]"), "doctest")
        .when(mark("test cases:") & mark("assertions:"), "catch2")
        .when(mark("*** No errors detected ***") | mark("*** Errors were detected"), "boost_test")
        .when(mark("Test project") | output.rlike(r"[0-9]% tests passed"), "ctest")
        .otherwise("unknown")
    )


def licence(text: Column) -> Column:
    low = F.lower(text)
    mark = lambda s: F.contains(low, F.lit(s))
    return F.when(mark("apache license"), "apache-2.0").when(mark("mozilla public license"), "mpl-2.0").when(mark("gnu lesser general"), "lgpl").when(mark("gnu general public"), "gpl").when(mark("permission is hereby granted, free of charge"), "mit").when(mark("redistribution and use in source and binary"), "bsd").otherwise("unknown")


def call_cost(provider: Column, prompt: Column, completion: Column, cache_read: Column, cache_write: Column, price: dict[str, Column]) -> Column:
    """Cost of a call; where the prompt count includes cached tokens only the rest is fresh."""
    fresh = F.when(provider == "bedrock", F.greatest(F.lit(0), prompt - cache_read - cache_write)).otherwise(prompt)
    return fresh * price["prompt"] + completion * price["completion"] + cache_read * price["cache_read"] + cache_write * price["cache_write"]
