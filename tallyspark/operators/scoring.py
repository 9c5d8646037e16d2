"""Scoring of test runs: inventories joined with reports, policies, means and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How each language counts. ``bounded``: only inventory ids can pass;
#: ``denominator``: greatest = larger of inventory and report, inventory = its size,
#: observed = the report's if there is one; ``excluded``: statuses left out of the mean;
#: ``precedence``: which of several results of one test holds; ``markers``: results that
#: are no tests; ``claims``: passes are counted from what programs print; ``unscored``: what
#: else leaves a run out of the mean (no tests, or the run's infra flag); ``zeroed``:
#: statuses of runs that passed nothing.
LANG_POLICY = [
    ("python", True, "greatest", ["INVENTORY_MISMATCH", "PYTEST_INFRA_ERROR"], "last", [], False, "", []),
    ("go", False, "greatest", ["PATCH_APPLY_FAILED", "TEST_SUITE_TIMEOUT", "OUTPUT_MISSING", "GO_TEST_CRASH"], "fail", [], False, "", []),
    ("rust", False, "greatest", ["INFRA_FETCH_FAILED", "TEST_SUITE_TIMEOUT", "CHEAT_DETECTED"], "fail", [], False, "", []),
    ("c", False, "greatest", ["COMPILE_FAILED", "OUTPUT_MISSING"], "last", [], False, "", []),
    ("cpp", False, "greatest", ["CHEAT_DETECTED", "COMPILE_FAILED", "BUILD_CONFIGURE_FAILED", "OUTPUT_MISSING", "TEST_SUITE_TIMEOUT", "PATCH_APPLY_FAILED"], "last", [], True, "", ["COMPILE_FAILED_MODEL"]),
    ("js", False, "greatest", [], "fail", [], False, "infra", []),
    ("ts", True, "inventory", ["SUITE_CRASHED", "PATCH_APPLY_FAILED", "TEST_SUITE_TIMEOUT", "COMPILE_FAILED", "OUTPUT_MISSING"], "pass", [], False, "", []),
    ("java", False, "observed", [], "last", ["TIMEOUT", "COMPILATION"], False, "no tests", []),
]
POLICY_SCHEMA = "lang string, bounded boolean, denominator string, excluded array<string>, precedence string, markers array<string>, claims boolean, unscored string, zeroed array<string>"

PASSING = ("passed", "xfail")


def joined_report(inventory: DataFrame, report: DataFrame) -> DataFrame:
    """Every inventory id with the report's outcome; absent ones failed in no time."""
    found = report.select("repo", "test_id", F.col("outcome").alias("seen"), F.col("duration").alias("took"))
    return inventory.select("repo", "test_id").join(found, ["repo", "test_id"], "left").select(
        "repo", "test_id", F.col("seen").isNotNull().alias("matched"), F.coalesce("seen", F.lit("failed")).alias("outcome"), F.coalesce("took", F.lit(0.0)).alias("duration")
    )


def repo_scores(inventory: DataFrame, report: DataFrame) -> DataFrame:
    """(name, sum, passed, num_passed, num_tests, status): passes counted among inventory
    ids only, over the larger of the two sizes; no id in common with a report is a mismatch."""
    ours = joined_report(inventory, report).groupBy("repo").agg(
        F.count("*").alias("n_inv"),
        F.count_if("matched").alias("n_matched"),
        F.count_if(F.col("outcome").isin(*PASSING)).alias("num_passed"),
        F.sum("duration").alias("sum"),
    )
    sizes = report.groupBy("repo").agg(F.count("*").alias("n_rep"))
    both = ours.join(sizes, "repo", "left").withColumn("n_rep", F.coalesce("n_rep", F.lit(0)))
    mismatch = (F.col("n_matched") == 0) & (F.col("n_rep") > 0)
    tests = F.when(mismatch, F.col("n_inv")).otherwise(F.greatest("n_inv", "n_rep"))
    return both.select(
        F.col("repo").alias("name"),
        F.when(mismatch, 0.0).otherwise(F.col("sum")).alias("sum"),
        F.when(~mismatch, F.coalesce(F.try_divide("num_passed", tests), F.lit(0.0))).alias("passed"),
        F.when(mismatch, 0).otherwise(F.col("num_passed")).cast("long").alias("num_passed"),
        tests.cast("long").alias("num_tests"),
        F.when(mismatch, "INVENTORY_MISMATCH").otherwise("OK").alias("status"),
    )


def average_pass_rate(rows: DataFrame, excluded: list[str], by: list[str] | None = None, exclude_if: Column | None = None) -> DataFrame:
    """Unweighted mean of the rates of scored rows: (avg, excluded, scored), 0.0 when none is scored."""
    drop = F.col("passed").isNull() | F.coalesce(F.col("status").isin(*excluded) if excluded else F.lit(False), F.lit(False))
    if exclude_if is not None:
        drop = drop | F.coalesce(exclude_if, F.lit(False))
    aggs = [F.coalesce(F.avg(F.when(~drop, F.col("passed"))), F.lit(0.0)).alias("avg_passed"), F.count_if(drop).alias("excluded"), F.count_if(~drop).alias("scored")]
    return rows.groupBy(*(by or [])).agg(*aggs)


def resolved_results(results: DataFrame, policy: DataFrame) -> DataFrame:
    """One row a test (lang, repo, test_id, status, duration) under the language's precedence."""
    rows = results.join(F.broadcast(policy.select("lang", "precedence", "markers")), "lang").filter(~F.array_contains("markers", F.col("test_id").cast("string")))
    failing = F.col("status").isin("FAILED", "ERROR")
    rank = (
        F.when(F.col("precedence") == "fail", F.when(failing, 2).when(F.col("status") == "PASSED", 1).otherwise(0))
        .when(F.col("precedence") == "pass", F.when(F.col("status") == "PASSED", 1).otherwise(0))
        .otherwise(0)
    )
    return rows.groupBy("lang", "repo", "test_id").agg(F.max_by(F.struct("status", "duration"), F.struct(rank, "pos")).alias("r")).select("lang", "repo", "test_id", "r.status", "r.duration")


def policy_scores(inventory: DataFrame, results: DataFrame, policy: DataFrame) -> DataFrame:
    """Scores of all languages by one policy table: (lang, repo, num_passed, num_tests, rate)."""
    one = resolved_results(results, policy)
    marked = one.join(inventory.select("lang", "repo", "test_id", F.lit(True).alias("frozen")), ["lang", "repo", "test_id"], "left")
    passing = F.col("status").isin("PASSED", "XFAIL")
    seen = marked.groupBy("lang", "repo").agg(
        F.count("*").alias("observed"), F.count_if(passing).alias("passing"), F.count_if(passing & F.col("frozen").isNotNull()).alias("frozen_passing"), F.sum("duration").alias("runtime")
    )
    sizes = inventory.groupBy("lang", "repo").agg(F.count("*").alias("inventory"))
    both = sizes.join(seen, ["lang", "repo"], "full").join(F.broadcast(policy), "lang").na.fill(0, ["inventory", "observed", "passing", "frozen_passing"])
    tests = F.when(F.col("denominator") == "inventory", F.col("inventory")).when(
        (F.col("denominator") == "observed") & (F.col("observed") == 0), F.col("inventory")
    ).otherwise(F.greatest("inventory", "observed"))
    num = F.when(F.col("bounded"), F.col("frozen_passing")).otherwise(F.least(F.col("passing"), tests))
    return both.select("lang", "repo", num.alias("num_passed"), tests.alias("num_tests"), F.coalesce(F.try_divide(num, tests), F.lit(0.0)).alias("rate"), F.coalesce("runtime", F.lit(0.0)).alias("runtime"))


def run_outcomes(runs: DataFrame, policy: DataFrame) -> DataFrame:
    """Scored runs (lang, repo, status, exit_code, num_passed, num_tests, compile_errors,
    infra_failed if there is such a flag) with their rates.

    Where a language counts what programs print (``claims``), a clean sheet of a run
    that exited with an error is forged: its status is CHEAT_DETECTED and it passed
    nothing; nor did a run of a ``zeroed`` status.
    """
    if "infra_failed" not in runs.columns:
        runs = runs.withColumn("infra_failed", F.lit(False))
    rows = runs.join(F.broadcast(policy.select("lang", "claims", "zeroed")), "lang")
    forged = F.coalesce(F.col("claims") & (F.col("exit_code") != 0) & (F.col("num_tests") > 0) & (F.col("num_passed") >= F.col("num_tests")), F.lit(False))
    nothing = forged | F.array_contains("zeroed", F.coalesce("status", F.lit("")))
    passed = F.when(nothing, 0).otherwise(F.col("num_passed"))
    return rows.select(
        "lang", "repo", F.when(forged, "CHEAT_DETECTED").otherwise(F.col("status")).alias("status"), passed.alias("num_passed"), "num_tests",
        F.coalesce(F.try_divide(passed, F.col("num_tests")), F.lit(0.0)).alias("rate"), "compile_errors", F.coalesce("infra_failed", F.lit(False)).alias("infra_failed"),
    )


def policy_means(outcomes: DataFrame, policy: DataFrame) -> DataFrame:
    """(lang, mean, scored, excluded, compile_errors): the mean rate of the runs that a language
    does not leave out, by status, for having no tests or by its infra flag; 0.0 without any,
    and the mean compile errors of all."""
    rows = outcomes.join(F.broadcast(policy.select("lang", "excluded", "unscored")), "lang")
    empty = (F.col("unscored") == "no tests") & (F.coalesce("num_tests", F.lit(0)) <= 0)
    out = F.array_contains("excluded", F.coalesce("status", F.lit(""))) | empty | (F.col("unscored") == "infra") & F.col("infra_failed")
    return rows.groupBy("lang").agg(
        F.coalesce(F.avg(F.when(~out, F.col("rate"))), F.lit(0.0)).alias("mean"), F.count_if(~out).alias("scored"), F.count_if(out).alias("excluded"), F.avg("compile_errors").alias("compile_errors")
    )


def status_breakdown(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def result_summary(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """Counts of each outcome a repo, with zeros for outcomes that do not occur."""
    return rows.groupBy("repo").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in statuses], F.count("*").alias("total"))


def cascade_match(tests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(test_id, status): results matched to ids by the first candidate key that fits; a leaf
    name matches only if one id has it; a pass upgrades a failure.

    ``tests``: (test_id, leaf); ``candidates``: (result, pos, key, leaf, status).
    """
    direct = candidates.join(tests.select(F.col("test_id").alias("key")), "key").groupBy("result").agg(F.min_by("key", "pos").alias("direct"))
    unique = tests.groupBy("leaf").agg(F.count("*").alias("n"), F.first("test_id").alias("by_leaf")).filter("n = 1").select("leaf", "by_leaf")
    each = candidates.groupBy("result").agg(F.min_by("leaf", "pos").alias("leaf"), F.min_by("status", "pos").alias("status"))
    found = each.join(direct, "result", "left").join(unique, "leaf", "left").select(F.coalesce("direct", "by_leaf").alias("test_id"), "status")
    seen = found.filter("test_id is not null").groupBy("test_id").agg(F.when(F.bool_or(F.col("status") == "PASSED"), "PASSED").otherwise(F.max("status")).alias("status"))
    return tests.select("test_id").join(seen, "test_id", "left").select("test_id", F.coalesce("status", F.lit("FAILED")).alias("status"))


def leaderboard(scores: DataFrame, lite: DataFrame) -> DataFrame:
    """(split, submission, resolved, rate, runtime) of all repos and of the lite ones, best first."""
    every = scores.withColumn("split", F.lit("all")).unionByName(scores.join(lite.select("name").distinct(), "name", "left_semi").withColumn("split", F.lit("lite")))
    out = every.groupBy("split", "submission").agg(F.count_if(F.col("passed") == 1.0).alias("resolved"), F.round(F.avg("passed"), 6).alias("rate"), F.round(F.sum("sum"), 4).alias("runtime"))
    return out.orderBy("split", F.desc("rate"), "submission")
