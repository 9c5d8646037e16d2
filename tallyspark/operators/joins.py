"""Anti, outer, theta and range joins of run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_inventory(repos: DataFrame, inventory: DataFrame) -> DataFrame:
    """Repos without any inventory row."""
    return repos.join(inventory.select("repo").distinct(), "repo", "left_anti")


def stale_inventory(inventory: DataFrame, provenance: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, reason): the first that applies of corrupt (checksum differs or content is
    unreadable), drifted (made at another commit), no_provenance."""
    rows = inventory.select("repo", "content").join(provenance.select("repo", "sha256", "commit"), "repo", "left").join(commits.select("repo", F.col("reference_commit")), "repo", "left")
    reason = (
        F.when(F.col("content").isNull() | (F.sha2("content", 256) != F.col("sha256")), "corrupt")
        .when(F.col("commit") != F.col("reference_commit"), "drifted")
        .when(F.col("sha256").isNull() & F.col("commit").isNull(), "no_provenance")
    )
    return rows.select("repo", reason.alias("reason")).filter("reason is not null")


def orphan_observations(observations: DataFrame, actions: DataFrame) -> DataFrame:
    """Observations that answer no action of their module."""
    known = actions.select("module", F.col("call_id").alias("action_id"))
    return observations.filter("action_id is not null").join(known, ["module", "action_id"], "left_anti")


def mismatched_observations(observations: DataFrame, actions: DataFrame) -> DataFrame:
    """Answers whose tool is not the action's; of actions with one id the last holds."""
    last = actions.groupBy("module", F.col("call_id").alias("action_id")).agg(F.max_by("tool", "pos").alias("action_tool"))
    both = observations.join(last, ["module", "action_id"])
    return both.filter("tool <> '' and action_tool <> '' and tool <> action_tool")


def hallucinated_actions(actions: DataFrame, declared: DataFrame, meta: DataFrame) -> DataFrame:
    """Actions that use neither a declared tool of their module nor a meta tool."""
    undeclared = actions.join(declared.select("module", "tool"), ["module", "tool"], "left_anti")
    return undeclared.join(meta.select("tool"), "tool", "left_anti")


def anchor_verdicts(golden: DataFrame, stub: DataFrame, solution: DataFrame) -> DataFrame:
    """(test, golden, stub, solution, verdict) over the union of the three sides' tests."""
    side = lambda df, name: df.select("test", F.col("ok").alias(name))
    both = side(golden, "golden").join(side(stub, "stub"), "test", "full").join(side(solution, "solution"), "test", "full")
    good = F.coalesce("golden", F.lit(False))
    verdict = F.when(~good, "wrong_oracle").when(F.coalesce("stub", F.lit(False)), "non_discriminating").otherwise("sound")
    return both.withColumn("verdict", verdict)


def valid_criteria(criteria: DataFrame, golden: DataFrame, stub: DataFrame) -> DataFrame:
    """(criterion, kept, reason): an anchorable criterion holds if golden passes and stub fails; unknown sides keep it."""
    rows = criteria.join(golden.select("criterion", F.col("ok").alias("g")), "criterion", "left").join(stub.select("criterion", F.col("ok").alias("s")), "criterion", "left")
    reason = F.when(~F.col("anchorable"), "not_anchorable").when(F.col("g").isNull() | F.col("s").isNull(), "unknown").when(~F.col("g"), "golden_fails").when(F.col("s"), "stub_passes").otherwise("sound")
    return rows.select("criterion", reason.alias("reason"), reason.isin("not_anchorable", "unknown", "sound").alias("kept"))


def file_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, state): the union of two families of files."""
    both = left.select("key", F.lit(1).alias("a")).join(right.select("key", F.lit(1).alias("b")), "key", "full")
    return both.select("key", F.when(F.col("a").isNull(), "status_only").when(F.col("b").isNull(), "data_only").otherwise("both").alias("state"))


def nearest_ancestor(units: DataFrame, files: DataFrame) -> DataFrame:
    """(unit, file): the file in the closest folder above each unit, the first by name there.

    ``units``: (unit, path); ``files``: (file, dir). Prefixes of the path are
    exploded with their depth, so it is an equi-join.
    """
    parts = F.split("path", "/")
    depths = units.select("unit", F.explode(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), n.alias("depth")))).alias("p"))
    hits = depths.select("unit", "p.dir", "p.depth").join(files, "dir")
    return units.select("unit").join(hits.groupBy("unit").agg(F.min_by("file", F.struct((-F.col("depth")).alias("d"), "file")).alias("file")), "unit", "left")


def supported_versions(supported: DataFrame, signals: DataFrame) -> DataFrame:
    """(project, version, ok): a version holds if every declared range [lo, hi) of its project has it.

    A version is in all ranges where it is in the one from the greatest lo to the least hi.
    """
    narrow = signals.groupBy("project").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    inside = (F.col("lo").isNull() | (F.col("version") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("version") < F.col("hi")))
    return supported.select("project", "version").distinct().join(narrow, "project", "left").select("project", "version", inside.alias("ok"))


def pattern_counts(texts: DataFrame, patterns: dict[str, str], samples: int = 5, salts: int = 64) -> DataFrame:
    """(name, n, files): matches of each constant pattern over all texts, with the first sample paths.

    Paths are cut to a few in each of ``salts`` parts first, so no task sees all of them.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.regexp_count("text", F.lit(p)).alias("n")) for k, p in patterns.items()]))
    hits = texts.select("path", pairs.alias("h")).select("path", "h.name", "h.n")
    totals = hits.groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    found = hits.filter("n > 0").select("name", "path").distinct().withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)))
    for by in (["name", "salt"], ["name"]):
        found = found.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("path"))).filter(F.col("k") <= samples)
    files = found.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"))
    return totals.join(files, "name", "left").select("name", "n", F.coalesce("files", F.lit("")).alias("files"))


#: Needles that one automaton holds: so many characters in all, about 100 bytes each.
NEEDLE_CHARS = 1_000_000


def leaked_needles(texts: DataFrame, needles: DataFrame, most_chars: int = NEEDLE_CHARS) -> DataFrame:
    """(text_id, needle_id): texts that contain a needle, in whatever place; one row for each
    row of both. Null and empty needles and null texts are in no pair.

    Needles up to ``most_chars`` characters in all go to every task as one automaton,
    which reads each text once. More of them go through a join (``leaked_by_windows``).
    """
    held = needles.filter(F.length("needle") > 0).select("needle_id", "needle")
    if (held.agg(F.sum(F.length("needle"))).first()[0] or 0) > most_chars:
        return leaked_by_windows(texts, held)
    ids: dict[str, list] = {}
    for row in held.collect():
        ids.setdefault(row["needle"], []).append(row["needle_id"])
    sent = texts.sparkSession.sparkContext.broadcast(ids)

    def find(parts):
        import ahocorasick
        import pandas as pd

        automaton = ahocorasick.Automaton()
        for needle, found in sent.value.items():
            automaton.add_word(needle, found)
        if len(automaton):
            automaton.make_automaton()
        for part in parts:
            pairs = []
            for text_id, text in zip(part["text_id"], part["text"], strict=True):
                hits = {id(found): found for _, found in automaton.iter(text)} if text and len(automaton) else {}
                pairs += [(text_id, needle_id) for found in hits.values() for needle_id in found]
            yield pd.DataFrame(pairs, columns=["text_id", "needle_id"])

    schema = T.StructType([T.StructField("text_id", texts.schema["text_id"].dataType), T.StructField("needle_id", needles.schema["needle_id"].dataType)])
    return texts.select("text_id", "text").mapInPandas(find, schema)


def leaked_by_windows(texts: DataFrame, needles: DataFrame, width: int = 32) -> DataFrame:
    """The same for any number of needles, without any of them on the driver.

    The first ``width`` characters of a needle, or all of a shorter one, join by hash
    with every window of that length in the texts, confirmed by ``contains``. Texts
    are cut into pieces that overlap by ``width``, so a window never seeks its place
    through a long text.
    """
    sized = needles.filter(F.length("needle") > 0).withColumn("w", F.least(F.length("needle"), F.lit(width)))
    heads = sized.select("needle_id", "needle", "w", F.xxhash64(F.substring("needle", F.lit(1), F.col("w"))).alias("h"))
    # at most ``width`` rows, hence broadcast
    widths = heads.select("w").distinct()
    size = 1024
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / size).cast("int")), lambda k: F.substring("text", k * size + 1, F.lit(size + width)))
    cut = texts.select("text_id", F.explode(pieces).alias("piece"))
    places = F.sequence(F.lit(1), F.least(F.length("piece") - F.col("w") + 1, F.lit(size)))
    hashes = F.transform(places, lambda i: F.xxhash64(F.substring("piece", i, F.col("w"))))
    windows = cut.join(F.broadcast(widths), F.length("piece") >= F.col("w")).select("text_id", "w", F.explode(F.array_distinct(hashes)).alias("h"))
    pairs = windows.join(heads, ["w", "h"]).select("text_id", "needle_id", "needle").distinct()
    return pairs.join(texts.select("text_id", "text"), "text_id").filter(F.contains("text", "needle")).select("text_id", "needle_id")


def leak_guard(diffs: DataFrame, texts: DataFrame, least: int = 24, most: int = 2) -> DataFrame:
    """(run, leaked, violates): how many different added lines of a run's change stand in its text
    word for word; short lines and comments do not count, ``most`` of them are no leak."""
    added = F.filter(F.split("diff", r"\r?\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    code = F.array_distinct(F.transform(added, lambda x: F.trim(F.substring(x, F.lit(2), F.length(x)))))
    telling = F.filter(code, lambda x: (F.length(x) >= least) & ~x.rlike(r"^(//|/\*|#|\*)"))
    both = texts.join(diffs.select("run", telling.alias("code")), "run")
    found = F.size(F.filter("code", lambda x: F.contains(F.col("body"), x)))
    return both.select("run", found.cast("long").alias("leaked"), (found > most).alias("violates"))


def uncovered_files(expected: DataFrame, touched: DataFrame) -> DataFrame:
    """(run, missing, n_missing): expected files that no patch touches."""
    gone = expected.join(touched, ["run", "path"], "left_anti").groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("missing"), F.count_distinct("path").alias("n_missing"))
    return gone


def tampered(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose checksum changed or that vanished."""
    both = before.select("path", F.sha2("content", 256).alias("was")).join(after.select("path", F.sha2("content", 256).alias("now")), "path", "left")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("path", F.col("now").isNull().alias("vanished"))


def fifo_zip(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Each unit's k-th edit goes to the turn whose running marker count reaches k; the last takes the rest.

    ``turns``: (unit, turn, markers); ``edits``: (unit, k, edit), k from 1. A range
    join of half-open intervals within a unit.
    """
    w = Window.partitionBy("unit").orderBy("turn")
    hi = F.sum("markers").over(w)
    last = F.lead("turn").over(w).isNull()
    spans = turns.select("unit", "turn", (hi - F.col("markers")).alias("lo"), F.when(last, F.lit(2**62)).otherwise(hi).alias("hi"))
    return edits.join(spans, "unit").filter("k > lo and k <= hi").select("unit", "k", "edit", "turn")
