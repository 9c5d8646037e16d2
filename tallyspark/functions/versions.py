"""Version constraints as half-open ranges of integer arrays, which compare as versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(version: Column) -> Column:
    """[major, minor, patch] of a version; missing parts are 0."""
    at = lambda k: F.coalesce(F.regexp_extract(F.get(F.split(version, r"\."), F.lit(k)), r"^\d+", 0).try_cast("int"), F.lit(0))
    return F.array(at(0), at(1), at(2))


def semver_range(raw: Column) -> Column:
    """(lo, hi) of the first clause of ^, ~, x-range, bare and comparator constraints; null bounds are open."""
    clause = F.trim(F.get(F.split(raw, r"\|\|"), F.lit(0)))
    body = F.regexp_replace(clause, r"^[\^~>=<v\s]+", "")
    v = parts(F.regexp_replace(body, r"[xX*]", "0"))
    major, minor, patch = (F.get(v, F.lit(k)) for k in range(3))
    zero = F.lit(0)
    next_major, next_minor, next_patch = F.array(major + 1, zero, zero), F.array(major, minor + 1, zero), F.array(major, minor, patch + 1)
    caret = F.when(major > 0, next_major).when(minor > 0, next_minor).otherwise(next_patch)
    size = F.size(F.split(body, r"\."))
    wild = F.when(body.rlike(r"^\d+(\.[xX*])?(\.[xX*])?$") & body.rlike(r"[xX*]|^\d+$"), next_major).when(body.rlike(r"^\d+\.\d+(\.[xX*])?$"), next_minor).otherwise(next_patch)
    nothing = F.lit(None).cast("array<int>")
    lo = F.when(clause.rlike(r"^\*?$") | clause.startswith("<"), nothing).when(clause.rlike(r"^>[^=]"), next_patch).otherwise(v)
    hi = (
        F.when(clause.rlike(r"^\*?$") | clause.startswith(">"), nothing)
        .when(clause.startswith("<="), next_patch)
        .when(clause.startswith("<"), v)
        .when(clause.startswith("^"), caret)
        .when(clause.startswith("~"), F.when(size >= 2, next_minor).otherwise(next_major))
        .otherwise(wild)
    )
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def within(version: Column, bounds: Column) -> Column:
    v = parts(version)
    return (bounds["lo"].isNull() | (v >= bounds["lo"])) & (bounds["hi"].isNull() | (v < bounds["hi"]))


def _clause_admits(v: Column, clause: Column) -> Column:
    """Whether [major, minor, patch] meets one clause: an operator and a version, whose last parts may be wild."""
    sign = F.regexp_extract(clause, r"^(>=|<=|===?|!=|~=|\^|~|>|<|=)?", 1)
    body = F.regexp_replace(F.substring(clause, F.length(sign) + 1, F.length(clause)), r"^\s*v?", "")
    wild, numbers = body.rlike(r"\.[xX*]$"), F.regexp_replace(body, r"(\.[xX*])+$", "")
    n, low = F.size(F.split(numbers, r"\.")), parts(numbers)
    at = lambda k: F.get(low, F.lit(k))
    # the first version after all that begin like ``low`` in so many parts
    after = lambda k: F.when(k <= 1, F.array(at(0) + 1, F.lit(0), F.lit(0))).when(k == 2, F.array(at(0), at(1) + 1, F.lit(0))).otherwise(F.array(at(0), at(1), at(2) + 1))
    begins = (v >= low) & (v < after(n))
    same = F.when(wild, begins).otherwise(v == low)
    caret = F.when(at(0) > 0, after(F.lit(1))).when((at(1) > 0) | (n == 2), after(F.lit(2))).when(n == 1, after(F.lit(1))).otherwise(after(F.lit(3)))
    return (
        F.when(clause.isin("", "*", "x", "X"), True).when(sign == ">=", v >= low).when(sign == "<=", v <= low).when(sign == ">", v > low).when(sign == "<", v < low)
        .when(sign.isin("==", "===", "="), same).when(sign == "!=", ~same).when(sign == "~=", (v >= low) & (v < after(n - 1)))
        .when(sign == "~", (v >= low) & (v < after(F.least(n, F.lit(2))))).when(sign == "^", (v >= low) & (v < caret)).otherwise(begins)
    )


def admits(version: Column, raw: Column) -> Column:
    """Whether a constraint admits a version: one alternative (`||`) of which every clause
    (by commas or spaces) holds. Missing parts of the version are 0; null gives null."""
    spaced = F.regexp_replace(raw, r"(>=|<=|===?|!=|~=|\^|~|>|<|=)\s+", "$1")
    v = parts(version)
    clauses = lambda alternative: F.split(F.trim(F.regexp_replace(alternative, r"[\s,]+", " ")), " ")
    return F.exists(F.split(spaced, r"\|\|", -1), lambda a: F.forall(clauses(a), lambda c: _clause_admits(v, c)))
