"""Runner summaries, stubs and rubric texts over logs and sources made of table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.operators import summaries as S
from tallyspark.plans.registry import query, read
from tallyspark.plans.rendered import E, numbers, text_of

#: A line for each event, by what m leaves: the same words in Spark's SQL and in DuckDB's.
CPP = "case ms % 8 when 0 then concat('[  FAILED  ] T', i) when 1 then concat('a.cc:1: error: e', i) when 2 then concat('  expected: ', i) when 3 then concat('[====] ', i, ' tests from x') when 5 then concat('All tests passed ', i) when 6 then concat('[====] Running ', i) else concat('noise ', i) end"
CARGO = "case ms % 7 when 0 then concat('running ', i, ' tests') when 1 then concat('error[E0', i, ']: x') when 2 then concat('test result: FAILED. ', i) when 3 then 'failures:' when 4 then concat('    m::t', i) else concat('note ', i) end"
JS = "case ms % 9 when 0 then concat('FAIL s', i) when 1 then concat('PASS s', i) when 2 then '' when 3 then '' when 4 then concat('Expected: ', i) when 5 then concat('Tests: ', i, ' failed') when 7 then concat('TypeError: e', i % 5) else concat('x ', i) end"
MOST, SIDE = 600, 280


def _log(line: str) -> str:
    return f"{E}, l as (select doc, pos, i, ms, {line} as line from e), raw as (select doc, string_agg(line, chr(10) order by pos) as raw from l group by doc)"


def _tiers(parsed: str) -> str:
    return f""", p as ({parsed}) select doc, case when length(raw) // 4 <= {MOST // 4} then 0 when length(text) // 4 <= {MOST // 4} then 1 else 3 end as tier,
case when length(raw) // 4 <= {MOST // 4} then raw when length(text) // 4 <= {MOST // 4} then text else left(text, {SIDE}) || chr(10) || chr(10) || '... [truncated] ...' || chr(10) || chr(10) || right(text, {SIDE}) end as text from raw join p using (doc)"""


def _summaries(spark, d, line: str, runner: str):
    return S.summaries(text_of(numbers(spark, d), line), runner, MOST, SIDE)


@query("cpp_summaries", f"""with {_log(CPP)}, s as (select l.* from l join (select doc, coalesce(min(pos) filter (where ms % 8 = 6), 0) as f from l group by doc) using (doc) where pos >= f),
sec as (select doc, 1 as k, 0 as pos, string_agg(line, chr(10) order by pos) as t from s where ms % 8 = 0 group by doc
union all select doc, 2, pos, line from s where ms % 8 = 3 union all select doc, 3, pos, line from s where ms % 8 = 5
union all select doc, 4, 0, string_agg(line, chr(10) order by pos) from s where ms % 8 = 2 group by doc union all select doc, 5, 0, string_agg(line, chr(10) order by pos) from s where ms % 8 = 1 group by doc)
{_tiers("select doc, string_agg(t, chr(10) || chr(10) order by k, pos) as text from sec group by doc")}""")
def cpp(spark, d):
    """2.9.32, 2.9.34: logs of a C++ runner, with all comparisons and errors, as the SQL has them."""
    return S.summaries(text_of(numbers(spark, d), CPP), "cpp", MOST, SIDE, checks=None, errors=None)


@query("cargo_summaries", f"""with {_log(CARGO)}, s as (select l.* from l join (select doc, coalesce(min(pos) filter (where ms % 7 = 0), 0) as f from l group by doc) using (doc) where pos >= f),
f as (select doc, min(pos) as f, max(last) as last from (select *, max(pos) over (partition by doc) as last from s) where ms % 7 = 3 group by doc), g as (select f.doc, f.f, min(s.pos) as e from f left join s on s.doc = f.doc and s.pos > f.f and s.ms % 7 = 2 where f.f < f.last group by f.doc, f.f),
sec as (select s.doc, 1 as k, trim(string_agg(line, chr(10) order by pos), ' ' || chr(10)) as t from s join g on s.doc = g.doc and s.pos >= g.f and s.pos < coalesce(g.e, s.pos + 1) group by s.doc
union all select doc, 2, arg_min(line, pos) from s where ms % 7 = 2 group by doc union all select doc, 3, string_agg(line, chr(10) order by pos) from s where ms % 7 = 1 group by doc)
{_tiers("select doc, string_agg(t, chr(10) || chr(10) order by k) as text from sec group by doc")}""")
def cargo(spark, d):
    """2.9.32, 2.9.34: logs of cargo."""
    return _summaries(spark, d, CARGO, "cargo")


@query("js_summaries", f"""with {_log(JS)}, b as (select *, lag(line) over (partition by doc order by pos) as prev from l),
s as (select *, last_value(case when ms % 9 = 0 then 1 when ms % 9 = 1 or line = '' and prev = '' then 0 end ignore nulls) over (partition by doc order by pos rows unbounded preceding) as inside from b),
hits as (select doc, 1 as k, pos, line from s where inside = 1 union all select doc, 2, pos, line from l where ms % 9 = 4 union all select doc, 3, pos, line from l where ms % 9 = 5),
parts as (select * from hits union all select doc, k, -1, '' from (select doc, k from hits group by doc, k) join (select doc, min(k) as low from hits group by doc) using (doc) where k > low union all select doc, 1, pos, line from l where doc not in (select doc from hits)),
keyed as (select *, case when line like 'TypeError%' then line end as err from parts), n as (select *, row_number() over (partition by doc, err order by k, pos) as nth from keyed),
kept as (select *, coalesce(last_value(case when err is not null then nth = 1 when line = '' then true end ignore nulls) over (partition by doc order by k, pos rows unbounded preceding), true) as keep from n)
{_tiers("select doc, string_agg(line, chr(10) order by k, pos) filter (where keep) || case when count(err) > count(distinct err) then format(chr(10) || chr(10) || '[{} duplicate error(s) removed. {} unique error(s) remain.]', count(err) - count(distinct err), count(distinct err)) else '' end as text from kept group by doc")}""")
def js(spark, d):
    """2.9.32, 2.9.34, 2.9.27: logs of JavaScript runners, repeated errors taken out."""
    return _summaries(spark, d, JS, "js")


@query("go_stubs", f"""with {E}, n as (select *, row_number() over (partition by doc order by pos) as line from e), o as (select *, last_value(case when k = 0 then line end ignore nulls) over (partition by doc order by pos rows unbounded preceding) as own from n)
select distinct o.doc, 'F' || n.i as name, n.line, case n.p when 0 then 'func ' else 'func (r *T) ' end || 'F' || n.i || '(a int) error {{' as signature from o join n on n.doc = o.doc and n.line = o.own where o.k = 1""")
def go_stubs(spark, d):
    """2.9.33."""
    line = "case k when 0 then concat(if(p = 0, 'func ', 'func (r *T) '), 'F', i, '(a int) error { ') when 1 then '\\tpanic(\"STUB: not implemented\")' else concat('\\tx := F', i, '(1)') end"
    return S.stubs(text_of(numbers(spark, d), line), "go")


@query("rubric_texts", """select id, text, concern, anchorable from (values ('bb.intent_fidelity', 'L2.INTENT_FIDELITY', true), ('bb.reasoning_faithfulness', 'L2.REASONING_FAITHFULNESS', false), ('bb.stage_legitimacy', 'L2.STAGE_LEGITIMACY', false), ('bb.oracle_strength', 'L2.ORACLE_STRENGTH', true)) as b(id, concern, anchorable), lateral (select null::varchar as text)
union all select 'd' || doc_id, text || ' as the behavioral contract says, the behavioral contract.', null, null from documents where text is not null""")
def rubric(spark, d):
    """2.10.21: the fixed criteria, and texts that name the answer key in any case."""
    own = X.backbone_criteria(spark).withColumn("text", F.lit(None).cast("string"))
    text = F.concat("text", F.lit(" as TRUTH.md says, Truth.MD."))
    docs = read(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("d"), "doc_id").alias("id"), X.without_answer_key(text).alias("text"), F.lit(None).cast("string").alias("concern"), F.lit(None).cast("boolean").alias("anchorable"))
    return own.unionByName(docs)
