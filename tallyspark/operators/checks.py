"""The deterministic checks of a run's records: one status a run and check, all runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.filters import touches_protected

#: Evaluation statuses that can be trusted, and the one that never is.
GOOD_STATUSES, FAIR_FAILURES, CHEAT = ("OK", "TESTS_RAN"), ("COMPILE_FAILED", "COMPILE_FAILED_MODEL", "BUILD_FAILED"), "CHEAT_DETECTED"


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(False))


def _stage_facts(stages: DataFrame) -> DataFrame:
    """One row a run from its stage records (run, stage 1 to 3, recorded, has_dir, status, num_passed, num_tests, diff, error)."""
    scored = F.col("num_passed").isNotNull() & F.col("num_tests").isNotNull()
    trusted = (F.col("status") != CHEAT) & (F.col("status").isin(*GOOD_STATUSES, *FAIR_FAILURES) | (F.col("status") == "") & scored)
    rows = stages.filter("recorded or has_dir").withColumns({"scored": scored & F.col("recorded"), "trusted": F.coalesce(trusted, F.lit(False)), "wrote": F.coalesce(F.trim("diff") != "", F.lit(False))})
    score = lambda n: F.max(F.when(F.col("scored") & (F.col("stage") == n), F.col("num_passed")))
    odd = F.col("status").isin(*GOOD_STATUSES) & (F.coalesce("num_tests", F.lit(0)) <= 0) | (F.col("num_passed") > F.col("num_tests"))
    return rows.groupBy("run").agg(
        F.count_if("recorded").alias("records"),
        _any(F.col("error") != "").alias("error"),
        _any(F.col("recorded") & (F.col("status") == CHEAT)).alias("cheat"),
        F.max_by("trusted", F.when(F.col("recorded"), F.col("stage"))).alias("trusted"),
        _any(F.col("recorded") & odd).alias("odd"),
        F.count_if("scored").alias("scored"),
        F.count_distinct(F.when(F.col("scored"), F.col("num_tests"))).alias("sizes"),
        score(1).alias("p1"), score(2).alias("p2"), score(3).alias("p3"),
        F.max(F.when(F.col("scored") & (F.col("stage") == 3), F.col("num_passed") / F.col("num_tests"))).alias("rate"),
        _any(F.col("diff").isNotNull()).alias("has_diff"), _any(touches_protected(F.col("diff"))).alias("diff_touches"),
        _any((F.col("stage") == 1) & F.col("wrote")).alias("draft_wrote"),
        F.count_if(F.col("has_dir") & (F.col("stage") > 1)).alias("later"), F.count_if(F.col("has_dir") & (F.col("stage") > 1) & ~F.col("wrote")).alias("later_blank"),
    )


def _module_facts(modules: DataFrame) -> DataFrame:
    """One row a run from its modules (run, stage, module, done, needs_retry, has_turns, has_output, parsed, has_cost, has_log, has_history, did_work, patch)."""
    wrote = F.coalesce(F.trim("patch") != "", F.lit(False))
    lacks = F.col("done") & ~(F.col("has_turns") & F.col("has_output") & F.col("has_log") & (F.col("has_history") | ~F.col("did_work")))
    return modules.groupBy("run").agg(
        F.count("*").alias("modules"), F.count_if("done").alias("done"), F.count_if("has_output").alias("outputs"), F.count_distinct("stage").alias("module_stages"), F.count_if(F.col("stage") == 1).alias("drafts"),
        _any(~F.col("done") | F.col("needs_retry")).alias("unfinished"), _any(lacks).alias("gaps"), _any(F.col("has_output") & ~(F.col("parsed") & F.col("has_cost"))).alias("bad_output"),
        _any(wrote | F.col("did_work")).alias("worked"), _any(touches_protected(F.col("patch"))).alias("patch_touches"), _any((F.col("stage") == 1) & wrote).alias("draft_patch"),
    )


def trajectory_checks(runs: DataFrame, stages: DataFrame, modules: DataFrame, content: DataFrame) -> DataFrame:
    """(run, concern, status) of fifteen checks over the records of all runs.

    ``content``: (run, conversations, orphans, mismatched, hallucinated, without_id,
    scanned, leaks), counts of what the history and leak joins found. A run without
    records fails or cannot be decided; it is never passed for what is absent.
    """
    both = runs.select("run").join(_stage_facts(stages), "run", "left").join(_module_facts(modules), "run", "left").join(content, "run", "left")
    kept = ("p1", "p2", "p3", "rate")
    both = both.na.fill(0, [x for x in both.columns if x not in kept]).na.fill(False)
    c = F.col

    def pick(*cases: tuple[Column, str]) -> Column:
        """The status of the first condition that holds, else PASS."""
        out = F.lit("PASS")
        for condition, status in reversed(cases):
            out = F.when(condition, status).otherwise(out)
        return out

    talked = (c("conversations") == 0, "NOT_APPLICABLE")
    drops = F.coalesce(c("p2") < c("p1"), F.lit(False)) | F.coalesce(c("p3") < F.coalesce("p2", "p1"), F.lit(False))
    checks = {
        "outcome_signal_trustworthy": pick((c("cheat"), "FAIL"), (c("records") == 0, "ERROR"), (~c("trusted"), "FAIL")),
        "pipeline_complete": pick((c("error") | (c("records") < 3), "FAIL")),
        "modules_done": pick((c("modules") == 0, "ERROR"), (c("unfinished"), "FAIL")),
        "module_artifacts_present": pick((c("done") == 0, "ERROR"), (c("gaps"), "FAIL")),
        "output_json_integrity": pick((c("outputs") == 0, "ERROR"), (c("bad_output"), "FAIL")),
        "test_files_untouched": pick((~c("has_diff") & c("worked"), "ERROR"), (~c("has_diff"), "NOT_APPLICABLE"), (c("diff_touches") | c("patch_touches"), "FAIL")),
        "fabricated_observation": pick(talked, (c("orphans") + c("mismatched") > 0, "FAIL")),
        "side_channel_clean": pick((c("scanned") == 0, "NOT_APPLICABLE"), (c("leaks") > 0, "FAIL")),
        "denominator_sanity": pick((c("odd"), "FAIL")),
        "toolcall_correctness": pick(talked, (c("hallucinated") + c("without_id") > 0, "FAIL")),
        "stage_dirs_present": pick((c("module_stages") < 3, "FAIL")),
        "draft_modules_addressed": pick((c("drafts") == 0, "ERROR"), (~(c("draft_patch") | c("draft_wrote")), "FAIL")),
        "no_regression": pick((c("scored") < 2, "NOT_APPLICABLE"), ((c("sizes") > 1) | drops, "FAIL")),
        "test_stage_outcome": pick((c("rate").isNull(), "NOT_APPLICABLE"), (c("rate") < 1, "FAIL")),
        "stage_handoff_continuity": pick((c("later") == 0, "NOT_APPLICABLE"), (c("later_blank") > 0, "NOT_APPLICABLE")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("concern"), status.alias("status")) for name, status in checks.items()]))
    return both.select("run", rows.alias("x")).select("run", "x.*")
