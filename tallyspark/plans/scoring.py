"""Scoring queries: documents stand for inventories (a source is a repository), labels for reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import scoring as S
from tallyspark.plans.registry import query, read

INV = "select source as repo, doc_id as test_id from documents"
REP = """select source as repo, case when source = 'src3' then doc_id + 10000000 else doc_id end as test_id,
  case when quality = 1 then 'passed' else 'failed' end as outcome, n_chars / 1000.0 as duration from labels join documents using (doc_id)"""
SCORES = f"""with inv as ({INV}), rep as ({REP}),
ours as (select inv.repo, count(*) as n_inv, count(rep.test_id) as n_matched, count(*) filter (where outcome in ('passed', 'xfail')) as p, sum(coalesce(duration, 0)) as s
  from inv left join rep on inv.repo = rep.repo and inv.test_id = rep.test_id group by inv.repo),
sizes as (select repo, count(*) as n_rep from rep group by repo),
b as (select ours.*, coalesce(n_rep, 0) as n_rep, n_matched = 0 and coalesce(n_rep, 0) > 0 as mm from ours left join sizes using (repo)),
scores as (select repo as name, case when mm then 0 else s end as sum, case when mm then null when greatest(n_inv, n_rep) = 0 then 0 else p / greatest(n_inv, n_rep) end as passed,
  case when mm then 0 else p end as num_passed, case when mm then n_inv else greatest(n_inv, n_rep) end as num_tests, case when mm then 'INVENTORY_MISMATCH' else 'OK' end as status from b)"""


def inventory(spark, d):
    return read(spark, d, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("test_id"))


def report(spark, d):
    """Labels as outcomes; one repository's ids are shifted, so that its inventory does not match."""
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    test_id = F.when(F.col("source") == "src3", F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id"))
    return rows.select(F.col("source").alias("repo"), test_id.alias("test_id"), F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("outcome"), (F.col("n_chars") / 1000.0).alias("duration"))


def scores(spark, d):
    return S.repo_scores(inventory(spark, d), report(spark, d))


@query("pass_rate_by_repo", SCORES + " select name, round(sum, 3) as runtime, round(passed, 6) as passed, num_passed, num_tests, status from scores")
def pass_rate_by_repo(spark, d):
    """2.4.1, 2.4.2, 2.5.1, 2.7.1."""
    return scores(spark, d).select("name", F.round("sum", 3).alias("runtime"), F.round("passed", 6).alias("passed"), "num_passed", "num_tests", "status").orderBy(F.desc("runtime"), "name")


@query("average_pass_rate", SCORES + " select round(coalesce(avg(passed) filter (where status <> 'INVENTORY_MISMATCH' and num_tests >= 5), 0), 6) as avg_passed, count(*) filter (where passed is null or status = 'INVENTORY_MISMATCH' or num_tests < 5) as excluded, count(*) filter (where passed is not null and status <> 'INVENTORY_MISMATCH' and num_tests >= 5) as scored from scores")
def average(spark, d):
    """2.5.2, 2.12.2: the callback is a Column."""
    out = S.average_pass_rate(scores(spark, d), ["INVENTORY_MISMATCH", "PYTEST_INFRA_ERROR"], exclude_if=F.col("num_tests") < 5)
    return out.withColumn("avg_passed", F.round("avg_passed", 6))


@query("status_breakdown", SCORES + " select status, count(*) as n from scores group by status")
def status_breakdown(spark, d):
    """2.5.4."""
    return S.status_breakdown(scores(spark, d))


LANGS = ["python", "go", "rust", "c", "cpp", "js", "ts", "java"]
CASES = "case doc_id % 8 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(LANGS)) + " end"


def _lang(c="doc_id"):
    return F.element_at(F.array(*map(F.lit, LANGS)), (F.col(c) % 8 + 1).cast("int"))


@query("lang_policy_scores", f"""with inv as (select {CASES} as lang, source as repo, case when doc_id % 10 = 9 then doc_id + 10000000 else doc_id end::varchar as test_id from documents),
res as (select {CASES} as lang, source as repo, doc_id::varchar as test_id, case when quality = 1 then 'PASSED' else 'FAILED' end as status, 1.0 as duration, 0 as pos from labels join documents using (doc_id)
  union all select {CASES}, source, doc_id::varchar, case when toxic = 1 then 'FAILED' else 'PASSED' end, 2.0, 1 from labels join documents using (doc_id) where doc_id % 3 = 0
  union all select distinct {CASES}, source, 'TIMEOUT', 'FAILED', 3.0, 0 from labels join documents using (doc_id) where source = 'src2' and {CASES} <> 'java'),
pol as (select * from (values ('python', true, 'greatest', 'last'), ('go', false, 'greatest', 'fail'), ('rust', false, 'greatest', 'fail'), ('c', false, 'greatest', 'last'), ('cpp', false, 'greatest', 'last'), ('js', false, 'greatest', 'fail'), ('ts', true, 'inventory', 'pass'), ('java', false, 'observed', 'last')) as p(lang, bounded, denominator, precedence)),
ranked as (select res.*, row_number() over (partition by res.lang, repo, test_id order by case precedence when 'fail' then case status when 'FAILED' then 2 else 1 end when 'pass' then case status when 'PASSED' then 1 else 0 end else 0 end desc, pos desc) as rn from res join pol using (lang)),
one as (select * from ranked where rn = 1),
seen as (select one.lang, one.repo, count(*) as observed, count(*) filter (where status = 'PASSED') as passing, count(*) filter (where status = 'PASSED' and inv.test_id is not null) as frozen, sum(duration) as runtime
  from one left join inv on one.lang = inv.lang and one.repo = inv.repo and one.test_id = inv.test_id group by one.lang, one.repo),
sizes as (select lang, repo, count(*) as n from inv group by lang, repo),
b as (select coalesce(sizes.lang, seen.lang) as lang, coalesce(sizes.repo, seen.repo) as repo, coalesce(n, 0) as n, coalesce(observed, 0) as o, coalesce(passing, 0) as p, coalesce(frozen, 0) as f, coalesce(runtime, 0) as runtime from sizes full join seen on sizes.lang = seen.lang and sizes.repo = seen.repo),
t as (select b.*, bounded, case when denominator = 'inventory' then n when denominator = 'observed' and o = 0 then n else greatest(n, o) end as tests from b join pol using (lang))
select lang, repo, case when bounded then f else least(p, tests) end as num_passed, tests as num_tests, round(case when tests = 0 then 0 else (case when bounded then f else least(p, tests) end) / tests end, 6) as rate, round(runtime, 3) as runtime from t""")
def lang_policy(spark, d):
    """2.5.3 and 2.13: eight languages from one policy table."""
    docs, labels = read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels")
    # the ids of a tenth of the inventory are others than the results'
    inv = docs.select(_lang().alias("lang"), F.col("source").alias("repo"), F.expr("cast(if(doc_id % 10 = 9, doc_id + 10000000, doc_id) as string)").alias("test_id"))
    both = labels.join(docs, "doc_id")
    rows = lambda ok, took, pos, df: df.select(_lang().alias("lang"), F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("test_id"), F.when(ok, "PASSED").otherwise("FAILED").alias("status"), F.lit(took).alias("duration"), F.lit(pos).alias("pos"))
    res = rows(F.col("quality") == 1, 1.0, 0, both).unionByName(rows(F.col("toxic") != 1, 2.0, 1, both.filter("doc_id % 3 = 0")))
    # markers of lost runs, which count for nothing in Java and as a failing test elsewhere
    lost = both.filter("source = 'src2'").select(_lang().alias("lang"), F.col("source").alias("repo"), F.lit("TIMEOUT").alias("test_id"), F.lit("FAILED").alias("status"), F.lit(3.0).alias("duration"), F.lit(0).alias("pos"))
    res = res.unionByName(lost)
    out = S.policy_scores(inv, res, spark.createDataFrame(S.LANG_POLICY, S.POLICY_SCHEMA))
    return out.withColumn("rate", F.round("rate", 6)).withColumn("runtime", F.round("runtime", 3))


@query("result_summary", "select source as repo, count(*) filter (where quality = 1) as n_passed, count(*) filter (where quality = 0) as n_failed, 0::bigint as n_skipped, 0::bigint as n_error, count(*) as total from labels join documents using (doc_id) group by source")
def result_summary(spark, d):
    """2.5.5."""
    rows = report(spark, d).select("repo", F.upper("outcome").alias("status"))
    return S.result_summary(rows, ["PASSED", "FAILED", "SKIPPED", "ERROR"])


@query("cascade_match", """with tests as (select doc_id as test_id, 'leaf' || (doc_id % 700) as leaf from documents), res as (select doc_id as result, 'leaf' || (doc_id % 700) as leaf, case when quality = 1 then 'PASSED' else 'FAILED' end as status, case when doc_id % 4 = 0 then -1 else doc_id end as k1, case when doc_id % 4 = 2 then doc_id + 1 else -2 end as k0 from labels),
direct as (select result, coalesce((select test_id from tests where test_id = k0), (select test_id from tests where test_id = k1)) as direct from res),
uni as (select leaf, min(test_id) as by_leaf from tests group by leaf having count(*) = 1),
found as (select coalesce(direct, by_leaf) as test_id, status from res join direct using (result) left join uni using (leaf)),
seen as (select test_id, case when bool_or(status = 'PASSED') then 'PASSED' else 'FAILED' end as status from found where test_id is not null group by test_id)
select tests.test_id, coalesce(status, 'FAILED') as status from tests left join seen using (test_id)""")
def cascade(spark, d):
    """2.4.3: candidate keys in order, then the leaf where only one id has it."""
    leaf = F.concat(F.lit("leaf"), (F.col("doc_id") % 700).cast("string"))
    tests = read(spark, d, "documents").select(F.col("doc_id").alias("test_id"), leaf.alias("leaf"))
    keys = F.array(F.when(F.col("doc_id") % 4 == 2, F.col("doc_id") + 1).otherwise(-2), F.when(F.col("doc_id") % 4 == 0, -1).otherwise(F.col("doc_id")))
    found = read(spark, d, "labels").select(F.col("doc_id").alias("result"), leaf.alias("leaf"), F.when(F.col("quality") == 1, "PASSED").otherwise("FAILED").alias("status"), F.posexplode(keys).alias("pos", "key"))
    return S.cascade_match(tests, found)


@query("leaderboard", """with rows as (select lang as submission, source as name, avg(coalesce(quality, 0)) as passed, sum(n_chars) / 1000.0 as sum from documents left join labels using (doc_id) group by lang, source),
every as (select *, 'all' as split from rows union all select *, 'lite' from rows where name in ('src1', 'src2', 'src5'))
select split, submission, count(*) filter (where passed = 1) as resolved, round(avg(passed), 6) as rate, round(sum(sum), 4) as runtime from every group by split, submission""")
def leaderboard(spark, d):
    """2.5.21, 2.2.9: languages stand for submissions; the lite rows come from all."""
    both = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, d, "labels"), "doc_id", "left")
    rows = both.groupBy(F.col("lang").alias("submission"), F.col("source").alias("name")).agg(F.avg(F.coalesce("quality", F.lit(0))).alias("passed"), (F.sum("n_chars") / 1000.0).alias("sum"))
    return S.leaderboard(rows, spark.createDataFrame([("src1",), ("src2",), ("src5",)], "name string"))


RUNS_SQL = f"""runs as (select {CASES} as lang, source || '.' || (doc_id % 40) as repo, case doc_id % 12 when 0 then 'COMPILE_FAILED' when 1 then 'OUTPUT_MISSING' when 2 then 'TEST_SUITE_TIMEOUT' when 3 then 'CHEAT_DETECTED' when 4 then null when 5 then 'COMPILE_FAILED_MODEL' else 'TESTS_RAN' end as status, doc_id % 7 = 2 as infra_failed,
  doc_id % 3 as exit_code, doc_id % 9 as num_passed, 8 - doc_id % 2 * 8 * (doc_id % 5 // 4) as num_tests, n_chars % 7 as compile_errors from documents)"""
EXCLUDED_SQL = "ex as (select * from (values " + ", ".join(f"('{p[0]}', '{x}')" for p in S.LANG_POLICY for x in p[3]) + ") as t(lang, status))"


@query("lang_policy_means", f"""with {RUNS_SQL}, {EXCLUDED_SQL}, f as (select *, lang = 'cpp' and exit_code <> 0 and num_tests > 0 and num_passed >= num_tests as forged from runs),
o as (select lang, case when forged then 'CHEAT_DETECTED' else status end as status, case when num_tests = 0 then 0 when forged or lang = 'cpp' and status = 'COMPILE_FAILED_MODEL' then 0 else num_passed / num_tests end as rate, compile_errors, num_tests, infra_failed from f),
m as (select o.*, ex.lang is not null or o.lang = 'java' and num_tests = 0 or o.lang = 'js' and infra_failed as out from o left join ex on o.lang = ex.lang and o.status = ex.status)
select lang, round(coalesce(avg(rate) filter (where not out), 0), 6) as mean, count(*) filter (where not out) as scored, count(*) filter (where out) as excluded, round(avg(compile_errors), 6) as compile_errors from m group by lang""")
def lang_policy_means(spark, d):
    """2.5.3: statuses that a language leaves out of its mean, forged sheets of C++, compile errors of C."""
    status = "case doc_id % 12 when 0 then 'COMPILE_FAILED' when 1 then 'OUTPUT_MISSING' when 2 then 'TEST_SUITE_TIMEOUT' when 3 then 'CHEAT_DETECTED' when 4 then null when 5 then 'COMPILE_FAILED_MODEL' else 'TESTS_RAN' end"
    numbers = [F.expr(x).alias(n) for n, x in (("status", status), ("exit_code", "doc_id % 3"), ("num_passed", "doc_id % 9"), ("num_tests", "8 - doc_id % 2 * 8 * (doc_id % 5 div 4)"), ("compile_errors", "n_chars % 7"), ("infra_failed", "doc_id % 7 = 2"))]
    runs = read(spark, d, "documents").select(_lang().alias("lang"), F.expr("concat(source, '.', doc_id % 40)").alias("repo"), *numbers)
    policy = spark.createDataFrame(S.LANG_POLICY, S.POLICY_SCHEMA)
    out = S.policy_means(S.run_outcomes(runs, policy), policy)
    return out.withColumn("mean", F.round("mean", 6)).withColumn("compile_errors", F.round("compile_errors", 6))
