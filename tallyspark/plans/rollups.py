"""Rollup queries: line items stand for model calls, events and conversations for turns, labels for checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import rollups as R
from tallyspark.plans.registry import query, read

CALLS = """calls as (select l_orderkey % 40 as module, case when l_linenumber = 1 then 'main_loop' else 'source' || (l_linenumber % 3) end as source, case when l_orderkey % 40 < 20 then 'bedrock' else 'openai' end as provider,
  l_quantity::bigint as prompt, l_partkey % 100 as completion, l_suppkey % 10 as cache_read, l_linenumber::bigint as cache_write, l_extendedprice / 1e6 as cost, l_orderkey * 10 + l_linenumber as pos from lineitem)"""


def calls(spark, d):
    n = F.col("l_linenumber")
    module = F.col("l_orderkey") % 40
    return read(spark, d, "lineitem").select(
        module.alias("module"), F.when(n == 1, "main_loop").otherwise(F.concat(F.lit("source"), (n % 3).cast("string"))).alias("source"), F.when(module < 20, "bedrock").otherwise("openai").alias("provider"),
        F.col("l_quantity").cast("long").alias("prompt"), (F.col("l_partkey") % 100).alias("completion"), (F.col("l_suppkey") % 10).alias("cache_read"), n.cast("long").alias("cache_write"),
        (F.col("l_extendedprice") / 1e6).alias("cost"), (F.col("l_orderkey") * 10 + n).alias("pos"),
    )


@query("calls_by_source", f"with {CALLS} select module, source, count(*) as calls, sum(prompt)::bigint as prompt_tokens, sum(completion)::bigint as completion_tokens, case when module < 20 then sum(cache_read)::bigint end as cache_read_tokens, case when module < 20 then sum(cache_write)::bigint end as cache_write_tokens, round(sum(cost), 4) as cost from calls group by module, source")
def by_source(spark, d):
    """2.5.6."""
    return R.calls_by_source(calls(spark, d))


@query("call_totals", f"with {CALLS} select count(*) as calls, sum(prompt)::bigint as prompt_tokens, sum(completion)::bigint as completion_tokens, sum(cache_read)::bigint as cache_read_tokens, sum(cache_write)::bigint as cache_write_tokens, round(sum(cost), 3) as cost, not (sum(prompt) > 0 and sum(cost) = 0) as cost_resolved, bool_and(provider = 'vertex') as all_vertex from calls")
def totals(spark, d):
    """2.5.7."""
    return R.call_totals(calls(spark, d))


def turns(spark, d):
    return read(spark, d, "events").select((F.col("user_id") % 60).alias("module"), (F.col("event_id") % 3 + 1).alias("stage"), F.when(F.col("event_type").isin("click", "view", "purchase"), "assistant").otherwise("user").alias("role"), F.col("value").alias("cost"), (F.col("event_id") % 500).alias("tokens"), (F.col("event_type") == "view").alias("reflection"))


TURNS = "turns as (select user_id % 60 as module, event_id % 3 + 1 as stage, case when event_type in ('click', 'view', 'purchase') then 'assistant' else 'user' end as role, value as cost, event_id % 500 as tokens, event_type = 'view' as reflection from events)"


@query("module_metrics", f"with {CALLS}, {TURNS}, t as (select module, sum(cost) as tc, count(*) as n, count(*) filter (where reflection) as r from turns group by module), c as (select module, sum(cost) as cc from calls group by module) select t.module, round(case when c.module is not null then cc else tc end, 4) as cost, c.module is not null as from_calls, greatest(0, n - r) as agent_turns from t left join c using (module)")
def module_metrics(spark, d):
    """2.5.8."""
    return R.module_metrics(turns(spark, d), calls(spark, d))


@query("run_metrics", f"with {TURNS} select stage, count(*) as turns, sum(tokens)::bigint as tokens, round(sum(cost), 3) as cost, grouping(stage)::integer as total from turns where role = 'assistant' group by rollup (stage)")
def run_metrics(spark, d):
    """2.5.9."""
    return R.run_metrics(turns(spark, d))


@query("tool_counts", "select event_type as tool, count(*) as n from events where value > 5 group by event_type")
def tool_counts(spark, d):
    """2.5.10."""
    return R.tool_counts(read(spark, d, "events").select(F.when(F.col("value") > 5, "action").otherwise("other").alias("kind"), F.col("event_type").alias("tool")))


@query("authoritative_totals", f"with {CALLS} select module, coalesce(sum(prompt) filter (where source = 'main_loop'), 0)::bigint as main_prompt, coalesce(sum(completion) filter (where source = 'main_loop'), 0)::bigint as main_completion, sum(prompt)::bigint as grand_prompt, sum(completion)::bigint as grand_completion from calls group by module")
def authoritative(spark, d):
    """2.5.11."""
    return R.authoritative_totals(calls(spark, d))


@query("usage_fold_in", "with e as (select conv_id as unit, turn as pos, length(text) % 50 as tokens from conversations), t as (select unit, sum(tokens) + unit % 7 as grand, sum(tokens) as own, max(pos) as last from e group by unit) select e.unit, e.pos, (tokens + case when pos = last then grand - own else 0 end)::bigint as tokens from e join t using (unit)")
def fold_in(spark, d):
    """2.5.12."""
    e = read(spark, d, "conversations").select(F.col("conv_id").alias("unit"), F.col("turn").alias("pos"), (F.length("text") % 50).cast("long").alias("tokens"))
    return R.usage_fold_in(e, e.groupBy("unit").agg((F.sum("tokens") + F.col("unit") % 7).alias("grand")))


TAXONOMY = [("complete", True, 0.0, 1), ("untouched", True, 0.0, 1), ("quality", False, 2.0, 2), ("toxic", False, 1.0, 2), ("rerun", False, 1.0, 3), ("never_built", False, 0.5, 3)]
TAX_SQL = "tax as (select * from (values " + ", ".join(f"('{c}', {str(g).lower()}, {w}::double, {layer})" for c, g, w, layer in TAXONOMY) + ") as t(concern, gating, weight, layer))"
CHECKS = """checks as (select doc_id as run, 'complete' as concern, case when length(text) > 100 then 'PASS' else 'FAIL' end as status from documents
  union all select doc_id, 'untouched', case when contains(text, 'AKIA') then 'ERROR' else 'PASS' end from documents
  union all select doc_id, 'quality', case when quality = 1 then 'PASS' else 'FAIL' end from labels
  union all select doc_id, 'toxic', case when toxic = 1 then 'FAIL' else 'PASS' end from labels
  union all select doc_id, 'rerun', 'NOT_APPLICABLE' from labels where doc_id % 2 = 0)"""


def checks(spark, d):
    docs, labels = read(spark, d, "documents").withColumnRenamed("doc_id", "run"), read(spark, d, "labels").withColumnRenamed("doc_id", "run")
    one = lambda df, name, status: df.select("run", F.lit(name).alias("concern"), status.alias("status"))
    return (
        one(docs, "complete", F.when(F.length("text") > 100, "PASS").otherwise("FAIL"))
        .unionByName(one(docs, "untouched", F.when(F.contains("text", F.lit("AKIA")), "ERROR").otherwise("PASS")))
        .unionByName(one(labels, "quality", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL")))
        .unionByName(one(labels, "toxic", F.when(F.col("toxic") == 1, "FAIL").otherwise("PASS")))
        .unionByName(one(labels.filter("run % 2 = 0"), "rerun", F.lit("NOT_APPLICABLE")))
    )


def taxonomy(spark):
    return spark.createDataFrame(TAXONOMY, "concern string, gating boolean, weight double, layer int")


@query("gate_and_score", f"""with {TAX_SQL}, {CHECKS}, every as (select d.doc_id as run, tax.concern, gating, weight, coalesce(c.status, 'PENDING') as status from documents d cross join tax left join checks c on c.run = d.doc_id and c.concern = tax.concern)
select run, case when bool_or(gating and status in ('FAIL', 'ERROR')) then 'QUARANTINE' else 'ACCEPT' end as gate, round(sum(case when status = 'PASS' then weight else 0 end) filter (where not gating and status in ('PASS', 'FAIL')) / sum(weight) filter (where not gating and status in ('PASS', 'FAIL')), 4) as score,
count(*) filter (where status = 'PASS') as n_pass, count(*) filter (where status = 'FAIL') as n_fail, coalesce(string_agg(concern, ',' order by concern) filter (where status = 'PENDING'), '') as unenforced from every group by run""")
def gate(spark, d):
    """2.5.13, 2.10.12, 2.2.8: checks unioned, absent ones pending, then gate and score for all runs at once."""
    runs = read(spark, d, "documents").select(F.col("doc_id").alias("run"))
    return R.gate_and_score(R.with_pending(checks(spark, d), TAXONOMY, runs))


@query("coverage_manifest", f"with {TAX_SQL}, have as (select concern, count(*) as n from (select distinct concern from (with {CHECKS} select concern from checks) union all select 'rerun') group by concern) select layer, count(*) filter (where n is not null) as enforced, count(*) filter (where n is null) as pending, count(*) filter (where n > 1) as duplicates from tax left join have using (concern) group by layer")
def coverage(spark, d):
    """2.5.23, 2.12.1."""
    built = checks(spark, d).select("concern").distinct().unionByName(spark.createDataFrame([("rerun",)], "concern string"))
    return R.coverage_manifest(taxonomy(spark), built)


@query("mutation_score", "select o_custkey % 50 as verifier, round(avg(case when o_orderpriority < '3' then case when o_orderstatus = 'F' then 1 else 0 end end), 6) as score, count(*) filter (where o_orderpriority < '3' and o_orderstatus <> 'F') as survived, count(*) filter (where not o_orderpriority < '3' and o_orderstatus = 'F') as false_kills, bool_and((o_orderpriority < '3') = (o_orderstatus = 'F')) as sound from orders group by o_custkey % 50")
def mutation(spark, d):
    """2.5.14, 2.12.3."""
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("verifier"), F.when(F.col("o_orderpriority") < "3", "BREAKING").otherwise("PRESERVING").alias("kind"), (F.col("o_orderstatus") == "F").alias("killed"))
    return R.mutation_score(rows)


@query("heldout_gap", """with t as (select source as run, toxic = 0 and (source < 'src15' or doc_id % 10 = 0) as sound, quality = 1 as ok from labels join documents using (doc_id)), g as (select run, count(*) filter (where sound) as n_sound, round(1 - avg(case when sound then ok::int end), 6) as gap from t group by run)
select run, n_sound, case when n_sound >= 3 then gap end as gap, case when n_sound < 3 then 'NOT_APPLICABLE' when g.gap <= 0.1 then 'PASS' else 'FAIL' end as status from g""")
def heldout(spark, d):
    """2.5.15."""
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return R.heldout_gap(rows.select(F.col("source").alias("run"), F.expr("toxic = 0 and (source < 'src15' or doc_id % 10 = 0)").alias("sound"), (F.col("quality") == 1).alias("ok")))


@query("unseen_mass", 'with c as (select user_id as "group", round(value) as species, count(*) as c from events group by all), g as (select "group", sum(c)::bigint as n, count(*) filter (where c = 1) as once from c group by "group") select "group", n, round(once / n, 6) as mass, n >= 20 and once / n < 0.05 as saturated from g')
def unseen(spark, d):
    """2.5.16."""
    return R.unseen_mass(read(spark, d, "events").select(F.col("user_id").alias("group"), F.round("value").alias("species")))


@query("flaky", "select l_partkey as test, case when bool_and(l_returnflag <> 'R') then 'stable_pass' when not bool_or(l_returnflag <> 'R') then 'stable_fail' else 'flaky' end as kind, count(*) as runs from lineitem group by l_partkey")
def flaky(spark, d):
    """2.5.17."""
    return R.flaky(read(spark, d, "lineitem").select(F.col("l_partkey").alias("test"), (F.col("l_returnflag") != "R").alias("ok")))


@query("completeness", "select count(*) as total, count(*) filter (where quality is not null) as complete, count(*) filter (where quality is null) as incomplete, count(*) filter (where quality is null and n_chars > 500) as recoverable from documents left join labels using (doc_id)")
def completeness(spark, d):
    """2.5.19."""
    both = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id", "left")
    return R.completeness(both.select(F.col("quality").isNotNull().alias("complete"), (F.col("n_chars") > 500).alias("recoverable")))


@query("conversion_report", "with u as (select 'm' || conv_id % 5 as model, length(text) % 4 as markers, least(length(text) % 4, turn) as parsed, case when turn = 0 then 0 else length(text) % 3 end as edits, case when conv_id % 3 = 0 then null else (length(text) % 10) / 10 end as reward from conversations) select model, round(case when sum(markers) > 0 then sum(parsed) / sum(markers) end, 6) as parse_rate, round(100 * count(*) filter (where edits = 0) / count(*), 4) as empty_pct, round(avg(reward), 6) as mean_reward, sum(edits)::bigint as edits from u group by model")
def conversion(spark, d):
    """2.5.20."""
    n = F.length("text")
    rows = read(spark, d, "conversations").select(F.concat(F.lit("m"), (F.col("conv_id") % 5).cast("string")).alias("model"), (n % 4).alias("markers"), F.least(n % 4, "turn").alias("parsed"), F.when(F.col("turn") == 0, 0).otherwise(n % 3).alias("edits"), F.when(F.col("conv_id") % 3 > 0, n % 10 / 10).alias("reward"))
    return R.conversion_report(rows)


@query("stage_cost", "with l as (select user_id % 3 as stage, user_id as log, arg_max(value, event_id) as last from events where event_type <> 'error' group by user_id) select stage, round(sum(last), 4) as cost from l group by stage")
def stage_cost(spark, d):
    """2.5.22."""
    return R.stage_cost(read(spark, d, "events").select((F.col("user_id") % 3).alias("stage"), F.col("user_id").alias("log"), F.when(F.col("event_type") != "error", F.col("value")).alias("cost"), F.col("event_id").alias("line_no")))


@query("capture_audit", "select module, e - r as delta from (select coalesce(a.m, b.m) as module, coalesce(e, 0) as e, coalesce(r, 0) as r from (select user_id as m, count(*) as e from events where event_type = 'click' group by user_id) a full join (select user_id as m, count(*) as r from events where event_type = 'view' group by user_id) b on a.m = b.m) where e <> r")
def audit(spark, d):
    """2.5.24."""
    e = read(spark, d, "events").withColumnRenamed("user_id", "module")
    return R.capture_audit(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"))
