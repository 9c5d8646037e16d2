"""The version of a project from signals of three tiers: declared constraints, test matrices, hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import versions as V


def _usable() -> Column:
    """Whether a signal says anything: a declared one needs a constraint, others versions."""
    declared = (F.col("tier") == "A") & F.col("raw").isNotNull()
    return F.coalesce(declared | F.col("tier").isin("B", "C") & (F.size("versions") > 0), F.lit(False))


def _agrees(version: Column) -> Column:
    return F.when(F.col("tier") == "A", V.admits(version, F.col("raw"))).otherwise(F.array_contains("versions", version))


def resolved_versions(signals: DataFrame, supported: list[str], pick: str = "min") -> DataFrame:
    """(project, version, tier, source, n_conflicts) of each project of ``signals``
    (project, pos, tier, source, raw, versions).

    Every constraint of tier A must admit a supported version, else the project is in
    ``conflict`` and has none. The union of the matrices of tier B narrows what is left,
    and so do the hints of tier C, each only where something stays. Of the rest the least
    (or with ``pick`` max the greatest) is taken. The source is the first usable signal of
    the tier that decided; n_conflicts counts the signals that do not agree.

    ``supported`` is a short parameter; signals meet it one by one and are summed up by
    project and version, so a project of very many signals is no row of its own. Signals
    that say nothing leave the project to tier ``default``.
    """
    every = F.array(*map(F.lit, supported))
    rows = signals.withColumn("usable", _usable())
    tier = lambda t: F.col("usable") & (F.col("tier") == t)
    matrix = tier("B") & F.arrays_overlap(F.coalesce("versions", F.array().cast("array<string>")), every)
    first = lambda cond: F.min_by("source", F.when(cond, F.col("pos")))
    firsts = rows.groupBy("project").agg(
        *[F.when(F.bool_or(c), first(c)).alias(n) for n, c in (("first_a", tier("A")), ("first_b", matrix), ("first_c", tier("C")))],
        *[F.bool_or(c).alias(n) for n, c in (("has_a", tier("A")), ("has_b", matrix), ("has_c", tier("C")))],
        F.count_if("usable").alias("n_usable"),
    )
    met = rows.withColumn("version", F.explode(every)).withColumn("ok", _agrees(F.col("version")))
    some = lambda t: F.coalesce(F.bool_or(tier(t) & F.col("ok")), F.lit(False)).alias(f"in_{t.lower()}")
    told = met.groupBy("project", "version").agg(F.count_if(tier("A") & ~F.col("ok")).alias("unmet"), some("B"), some("C"), F.count_if(F.col("usable") & F.col("ok")).alias("agree"))
    # as many rows a project as versions are supported
    one = told.filter("unmet = 0").groupBy("project").agg(F.collect_list(F.struct(V.parts(F.col("version")).alias("key"), "version", "in_b", "in_c", "agree")).alias("left"))

    def narrowed(left: Column, flag: str) -> Column:
        return F.when(F.exists(left, lambda x: x[flag]), F.filter(left, lambda x: x[flag])).otherwise(left)

    best = F.array_min if pick == "min" else F.array_max
    chosen = one.withColumn("left", narrowed(F.col("left"), "in_b")).withColumn("left", narrowed(F.col("left"), "in_c")).select("project", best("left").alias("best"))
    out = firsts.join(chosen, "project", "left")
    none = F.col("best").isNull()
    decided = F.when(none, "conflict").when(F.col("has_a"), "A").when(F.col("has_b"), "B").when(F.col("has_c"), "C").otherwise("default")
    source = F.when(none, "conflict").when(F.col("has_a"), F.col("first_a")).when(F.col("has_b"), F.col("first_b")).when(F.col("has_c"), F.col("first_c")).otherwise("default")
    return out.select("project", F.col("best.version").alias("version"), decided.alias("tier"), source.alias("source"), (F.col("n_usable") - F.coalesce("best.agree", F.lit(0))).alias("n_conflicts"))


def version_conflicts(signals: DataFrame, resolved: DataFrame) -> DataFrame:
    """(project, pos, source, raw): the usable signals that do not agree with their project's
    version; of a project without one all of tier A."""
    both = signals.withColumn("usable", _usable()).filter("usable").join(resolved.select("project", "version"), "project")
    against = F.when(F.col("version").isNull(), F.col("tier") == "A").otherwise(~_agrees(F.col("version")))
    return both.filter(against).select("project", "pos", "source", "raw")
