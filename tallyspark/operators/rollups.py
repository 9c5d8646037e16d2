"""Aggregations of calls, turns, checks, mutants and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENS = ("prompt", "completion", "cache_read", "cache_write")


def calls_by_source(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost of each module and source; cache columns only where the first call's provider has a cache."""
    first = F.min_by("provider", "pos")
    has_cache = first.isin("bedrock", "anthropic")
    sums = [F.sum(t).alias(f"{t}_tokens") for t in TOKENS[:2]] + [F.when(has_cache, F.sum(t)).alias(f"{t}_tokens") for t in TOKENS[2:]]
    return calls.groupBy("module", "source").agg(F.count("*").alias("calls"), *sums, F.round(F.sum("cost"), 4).alias("cost"))


def call_totals(calls: DataFrame) -> DataFrame:
    """Grand totals and whether every call with tokens has a cost."""
    tokens = sum((F.sum(t) for t in TOKENS[1:]), F.sum(TOKENS[0]))
    return calls.agg(
        F.count("*").alias("calls"), *[F.sum(t).alias(f"{t}_tokens") for t in TOKENS], F.round(F.sum("cost"), 3).alias("cost"),
        (~((tokens > 0) & (F.sum("cost") == 0))).alias("cost_resolved"), F.bool_and(F.col("provider") == "vertex").alias("all_vertex"),
    )


def module_metrics(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """Totals of a module: its calls' where it has any, else its turns'; agent turns without reflections."""
    t = turns.groupBy("module").agg(F.sum("cost").alias("turn_cost"), F.count("*").alias("num_turns"), F.count_if("reflection").alias("reflections"))
    c = calls.groupBy("module").agg(F.sum("cost").alias("call_cost"), F.count("*").alias("calls"))
    cost = F.when(F.col("calls").isNotNull(), F.col("call_cost")).otherwise(F.col("turn_cost"))
    return t.join(c, "module", "left").select("module", F.round(cost, 4).alias("cost"), F.col("calls").isNotNull().alias("from_calls"), F.greatest(F.lit(0), F.col("num_turns") - F.col("reflections")).alias("agent_turns"))


def run_metrics(turns: DataFrame) -> DataFrame:
    """Sums over assistant turns for each stage and overall (stage null, total 1)."""
    rows = turns.filter(F.col("role") == "assistant")
    return rows.rollup("stage").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 3).alias("cost"), F.grouping_id().cast("int").alias("total"))


def tool_counts(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind") == "action").groupBy("tool").agg(F.count("*").alias("n"))


def authoritative_totals(calls: DataFrame) -> DataFrame:
    """Main-loop and grand sums in one pass."""
    main = lambda c: F.sum(F.when(F.col("source") == "main_loop", F.col(c)))
    return calls.groupBy("module").agg(*[F.coalesce(main(c), F.lit(0)).alias(f"main_{c}") for c in TOKENS[:2]], *[F.sum(c).alias(f"grand_{c}") for c in TOKENS[:2]])


def usage_fold_in(events: DataFrame, totals: DataFrame) -> DataFrame:
    """Add what a unit's grand total has beyond its events to the unit's last event."""
    w = Window.partitionBy("unit")
    rows = events.withColumn("own", F.sum("tokens").over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("pos"))))
    both = rows.join(totals, "unit")
    return both.select("unit", "pos", (F.col("tokens") + F.when(F.col("back") == 1, F.col("grand") - F.col("own")).otherwise(0)).alias("tokens"))


def gate_and_score(results: DataFrame) -> DataFrame:
    """(run, gate, score, passed, failed, unenforced): QUARANTINE if a gating check fails or errs; the
    weighted share of passes among decided process checks, null if none."""
    decided = ~F.col("gating") & F.col("status").isin("PASS", "FAIL")
    weight, won = F.sum(F.when(decided, F.col("weight"))), F.sum(F.when(decided & (F.col("status") == "PASS"), F.col("weight")).when(decided, 0.0))
    return results.groupBy("run").agg(
        F.when(F.bool_or(F.col("gating") & F.col("status").isin("FAIL", "ERROR")), "QUARANTINE").otherwise("ACCEPT").alias("gate"),
        F.round(F.try_divide(won, weight), 4).alias("score"),
        F.count_if(F.col("status") == "PASS").alias("n_pass"),
        F.count_if(F.col("status") == "FAIL").alias("n_fail"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") == "PENDING", F.col("concern")))), ",").alias("unenforced"),
    )


def with_pending(results: DataFrame, taxonomy: list[tuple[str, bool, float, int]], runs: DataFrame) -> DataFrame:
    """One row for each run and concern of the taxonomy, constants (concern, gating, weight, layer);
    a check that did not run is PENDING."""
    concerns = [F.struct(F.lit(concern).alias("concern"), F.lit(gating).alias("gating"), F.lit(weight).alias("weight")) for concern, gating, weight, _ in taxonomy]
    every = runs.select("run", F.explode(F.array(*concerns)).alias("t")).select("run", "t.*")
    return every.join(results.select("run", "concern", "status"), ["run", "concern"], "left").withColumn("status", F.coalesce("status", F.lit("PENDING")))


def mutation_score(mutants: DataFrame) -> DataFrame:
    """Killed share of breaking mutants, and soundness: none survived, no preserving one killed."""
    breaking = F.col("kind") == "BREAKING"
    return mutants.groupBy("verifier").agg(
        F.round(F.avg(F.when(breaking, F.col("killed").cast("int"))), 6).alias("score"),
        F.count_if(breaking & ~F.col("killed")).alias("survived"),
        F.count_if(~breaking & F.col("killed")).alias("false_kills"),
        F.bool_and(breaking == F.col("killed")).alias("sound"),
    )


def heldout_gap(tests: DataFrame, least: int = 3, tolerance: float = 0.1) -> DataFrame:
    """1 less the pass rate on sound tests; not applicable below ``least`` of them."""
    sound = F.count_if("sound")
    gap = F.round(1 - F.avg(F.when(F.col("sound"), F.col("ok").cast("int"))), 6)
    out = tests.groupBy("run").agg(sound.alias("n_sound"), gap.alias("gap"))
    return out.withColumn("status", F.when(F.col("n_sound") < least, "NOT_APPLICABLE").when(F.col("gap") <= tolerance, "PASS").otherwise("FAIL")).withColumn("gap", F.when(F.col("n_sound") >= least, F.col("gap")))


def unseen_mass(species: DataFrame, least: int = 20, threshold: float = 0.05) -> DataFrame:
    """Good-Turing unseen mass of each group: species seen once over observations, 1.0 without any."""
    counts = species.groupBy("group", "species").agg(F.count("species").alias("c"))
    out = counts.groupBy("group").agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once"))
    mass = F.coalesce(F.try_divide("once", "n"), F.lit(1.0))
    return out.select("group", "n", F.round(mass, 6).alias("mass"), ((F.col("n") >= least) & (mass < threshold)).alias("saturated"))


def flaky(outcomes: DataFrame) -> DataFrame:
    ok = F.col("ok")
    return outcomes.groupBy("test").agg(F.when(F.bool_and(ok), "stable_pass").when(~F.bool_or(ok), "stable_fail").otherwise("flaky").alias("kind"), F.count("*").alias("runs"))


def completeness(reports: DataFrame) -> DataFrame:
    """One row of counts over entry reports."""
    return reports.agg(F.count("*").alias("total"), F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("incomplete"), F.count_if(~F.col("complete") & F.col("recoverable")).alias("recoverable"))


def conversion_report(units: DataFrame) -> DataFrame:
    """Parse rate, empty-edit percentage and mean reward; null where there is nothing to divide by."""
    edits = F.sum("edits")
    return units.groupBy("model").agg(
        F.round(F.try_divide(F.sum("parsed"), F.sum("markers")), 6).alias("parse_rate"), F.round(F.try_divide(100 * F.count_if(F.col("edits") == 0), F.count("*")), 4).alias("empty_pct"),
        F.round(F.avg("reward"), 6).alias("mean_reward"), edits.alias("edits"),
    )


def stage_cost(log_lines: DataFrame) -> DataFrame:
    """The last session cost in each log, summed over a stage."""
    return log_lines.filter("cost is not null").groupBy("stage", "log").agg(F.max_by("cost", "line_no").alias("last")).groupBy("stage").agg(F.round(F.sum("last"), 4).alias("cost"))


def coverage_manifest(taxonomy: DataFrame, checks: DataFrame) -> DataFrame:
    """Concerns enforced and pending by layer, and checks registered twice."""
    have = checks.groupBy("concern").agg(F.count("*").alias("n"))
    return taxonomy.join(have, "concern", "left").groupBy("layer").agg(F.count_if(F.col("n").isNotNull()).alias("enforced"), F.count_if(F.col("n").isNull()).alias("pending"), F.count_if(F.col("n") > 1).alias("duplicates"))


def capture_audit(events: DataFrame, records: DataFrame) -> DataFrame:
    """Modules whose numbers of events and of records differ."""
    e, r = events.groupBy("module").agg(F.count("*").alias("e")), records.groupBy("module").agg(F.count("*").alias("r"))
    both = e.join(r, "module", "full").select("module", (F.coalesce("e", F.lit(0)) - F.coalesce("r", F.lit(0))).alias("delta"))
    return both.filter("delta <> 0")
