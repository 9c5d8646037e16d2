"""The deterministic checks over records made of orders (stages), line items (modules) and events (histories)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators import checks as K
from tallyspark.plans.registry import query, read

#: Three orders of a customer are the stages of one run.
STAGES = """st as (select o_custkey * 1000 + (rn - 1) // 3 as run, (rn - 1) % 3 + 1 as stage, o as k, o % 13 > 0 as recorded, o % 23 > 0 as has_dir,
  case o % 11 when 0 then 'CHEAT_DETECTED' when 1 then 'OUTPUT_MISSING' when 2 then '' when 3 then 'COMPILE_FAILED' else 'TESTS_RAN' end as status,
  case when o % 19 = 0 then null else 40 end as num_tests, least(40 + o % 31 // 30, 36 + 2 * ((rn - 1) % 3) + o % 7 // 6 + o % 5 // 4) as num_passed,
  case o % 5 when 0 then null when 1 then ' ' else 'diff --git a/' || case when o % 29 = 0 then 'tests/x.py' else 'src/f.py' end || ' b/src/f.py' end as diff, case when o_custkey % 31 = 0 then 'boom' else '' end as error
  from (select o_custkey, o_orderkey as o, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders))"""
MODULES = """mo as (select run, stage, l_linenumber as module, l_quantity > 2 as done, l_quantity > 49 as needs_retry, l_partkey % 41 > 0 as has_turns, l_partkey % 3 > 0 as has_output, l_partkey % 37 > 0 as parsed, l_partkey % 43 > 0 as has_cost,
  l_suppkey % 13 > 0 as has_log, l_suppkey % 7 > 0 as has_history, l_tax > 0.04 as did_work, case when l_discount < 0.05 then '' when l_partkey % 97 = 0 then '+++ b/conftest.py' else '+++ b/src/m.py' end as patch from st join lineitem on k = l_orderkey)"""
CONTENT = """co as (select run, run % 4 as conversations, run % 17 // 16 as orphans, run % 19 // 18 as mismatched, run % 11 // 10 as hallucinated, run % 13 // 12 as without_id, run % 3 as scanned, run % 7 // 6 as leaks from (select distinct run from st) where run % 5 > 0)"""
FACTS = f"""{STAGES}, {MODULES}, {CONTENT},
t as (select *, recorded and num_tests is not null as scored, coalesce(status <> 'CHEAT_DETECTED' and (status in ('TESTS_RAN', 'COMPILE_FAILED') or status = '' and num_tests is not null), false) as trusted, coalesce(trim(diff) <> '', false) as wrote from st where recorded or has_dir),
s as (select run, count(*) filter (where recorded) as records, bool_or(error <> '') as error, bool_or(recorded and status = 'CHEAT_DETECTED') as cheat, arg_max(trusted, stage) filter (where recorded) as trusted,
  bool_or(recorded and (status = 'TESTS_RAN' and num_tests is null or coalesce(num_passed > num_tests, false))) as odd, count(*) filter (where scored) as scored, max(num_passed) filter (where scored and stage = 1) as p1, max(num_passed) filter (where scored and stage = 2) as p2, max(num_passed) filter (where scored and stage = 3) as p3,
  bool_or(diff is not null) as has_diff, bool_or(coalesce(contains(diff, 'tests/'), false)) as touch, bool_or(stage = 1 and wrote) as draft_wrote, count(*) filter (where has_dir and stage > 1) as later, count(*) filter (where has_dir and stage > 1 and not wrote) as blank from t group by run),
m as (select run, count(*) as modules, count(*) filter (where done) as done, count(*) filter (where has_output) as outputs, count(distinct stage) as stages, count(*) filter (where stage = 1) as drafts, bool_or(not done or needs_retry) as unfinished,
  bool_or(done and not (has_turns and has_output and has_log and (has_history or not did_work))) as gaps, bool_or(has_output and not (parsed and has_cost)) as bad, bool_or(did_work or patch <> '') as worked, bool_or(contains(patch, 'conftest')) as touch, bool_or(stage = 1 and patch <> '') as draft_patch from mo group by run),
f as (select r.run, s.* exclude (run, touch), m.* exclude (run, touch), co.* exclude (run), coalesce(s.touch, false) or coalesce(m.touch, false) as touch from (select distinct run from st) r left join s using (run) left join m using (run) left join co using (run))"""
RULES = {
    "outcome_signal_trustworthy": "case when cheat then 'FAIL' when coalesce(records, 0) = 0 then 'ERROR' when not trusted then 'FAIL' else 'PASS' end",
    "pipeline_complete": "case when error or coalesce(records, 0) < 3 then 'FAIL' else 'PASS' end",
    "modules_done": "case when modules is null then 'ERROR' when unfinished then 'FAIL' else 'PASS' end",
    "module_artifacts_present": "case when coalesce(done, 0) = 0 then 'ERROR' when gaps then 'FAIL' else 'PASS' end",
    "output_json_integrity": "case when coalesce(outputs, 0) = 0 then 'ERROR' when bad then 'FAIL' else 'PASS' end",
    "test_files_untouched": "case when not coalesce(has_diff, false) then case when worked then 'ERROR' else 'NOT_APPLICABLE' end when touch then 'FAIL' else 'PASS' end",
    "fabricated_observation": "case when coalesce(conversations, 0) = 0 then 'NOT_APPLICABLE' when orphans + mismatched > 0 then 'FAIL' else 'PASS' end",
    "side_channel_clean": "case when coalesce(scanned, 0) = 0 then 'NOT_APPLICABLE' when leaks > 0 then 'FAIL' else 'PASS' end",
    "denominator_sanity": "case when odd then 'FAIL' else 'PASS' end",
    "toolcall_correctness": "case when coalesce(conversations, 0) = 0 then 'NOT_APPLICABLE' when hallucinated + without_id > 0 then 'FAIL' else 'PASS' end",
    "stage_dirs_present": "case when coalesce(stages, 0) < 3 then 'FAIL' else 'PASS' end",
    "draft_modules_addressed": "case when coalesce(drafts, 0) = 0 then 'ERROR' when draft_patch or draft_wrote then 'PASS' else 'FAIL' end",
    "no_regression": "case when coalesce(scored, 0) < 2 then 'NOT_APPLICABLE' when p2 < p1 or p3 < p2 or p3 < coalesce(p2, p1) then 'FAIL' else 'PASS' end",
    "test_stage_outcome": "case when p3 is null then 'NOT_APPLICABLE' when p3 < 40 then 'FAIL' else 'PASS' end",
    "stage_handoff_continuity": "case when coalesce(later, 0) = 0 or blank > 0 then 'NOT_APPLICABLE' else 'PASS' end",
}


@query("trajectory_checks", f"with {FACTS} " + " union all ".join(f"select run, '{name}' as concern, {rule} as status from f" for name, rule in RULES.items()))
def trajectory_checks(spark, d):
    """2.10.12: fifteen checks over all runs; the gate, the held-out gap and the two of turns are queries of their own."""
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = read(spark, d, "orders").withColumn("rn", rn).withColumn("o", F.col("o_orderkey"))
    e = lambda name, text: F.expr(text).alias(name)
    stages = o.select(
        e("run", "o_custkey * 1000 + (rn - 1) div 3"), e("stage", "(rn - 1) % 3 + 1"), e("k", "o"), e("recorded", "o % 13 > 0"), e("has_dir", "o % 23 > 0"),
        e("status", "case o % 11 when 0 then 'CHEAT_DETECTED' when 1 then 'OUTPUT_MISSING' when 2 then '' when 3 then 'COMPILE_FAILED' else 'TESTS_RAN' end"),
        e("num_tests", "if(o % 19 = 0, null, 40)"), e("num_passed", "least(40 + o % 31 div 30, 36 + 2 * ((rn - 1) % 3) + o % 7 div 6 + o % 5 div 4)"),
        e("diff", "case o % 5 when 0 then null when 1 then ' ' else concat('diff --git a/', if(o % 29 = 0, 'tests/x.py', 'src/f.py'), ' b/src/f.py') end"), e("error", "if(o_custkey % 31 = 0, 'boom', '')"),
    )
    modules = stages.select("run", "stage", "k").join(read(spark, d, "lineitem"), F.col("k") == F.col("l_orderkey")).select(
        "run", "stage", e("module", "l_linenumber"), e("done", "l_quantity > 2"), e("needs_retry", "l_quantity > 49"), e("has_turns", "l_partkey % 41 > 0"), e("has_output", "l_partkey % 3 > 0"), e("parsed", "l_partkey % 37 > 0"), e("has_cost", "l_partkey % 43 > 0"),
        e("has_log", "l_suppkey % 13 > 0"), e("has_history", "l_suppkey % 7 > 0"), e("did_work", "l_tax > 0.04"), e("patch", "case when l_discount < 0.05 then '' when l_partkey % 97 = 0 then '+++ b/conftest.py' else '+++ b/src/m.py' end"),
    )
    runs = stages.select("run").distinct()
    content = runs.filter("run % 5 > 0").select(
        "run", e("conversations", "run % 4"), e("orphans", "run % 17 div 16"), e("mismatched", "run % 19 div 18"), e("hallucinated", "run % 11 div 10"), e("without_id", "run % 13 div 12"), e("scanned", "run % 3"), e("leaks", "run % 7 div 6")
    )
    return K.trajectory_checks(runs, stages, modules, content)
