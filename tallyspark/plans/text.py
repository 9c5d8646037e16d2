"""Scalar function queries over documents, pages and inline text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import classify as C
from tallyspark.functions import text as X
from tallyspark.functions import versions as V
from tallyspark.operators import resolver as R
from tallyspark.plans.registry import query, read
from tallyspark.plans.rendered import E, numbers, text_of


@query(
    "clean_prose",
    f"""with {E}, stop as (select doc, min(pos) as stop from e where i = 36 group by doc),
l as (select e.doc, pos, case k when 0 then 'Alpha ' || i || ' beta of line ' || pos || '.' when 3 then 'Heading of part ' || i end as line from e left join stop using (doc) where pos < coalesce(stop, pos + 1)),
j as (select doc, coalesce(string_agg(line, chr(10) || chr(10) order by pos), '') as s from l group by doc), docs as (select distinct doc from e)
select doc, case when length(coalesce(s, '')) <= 400 then coalesce(s, '') else left(s, length(left(s, 400)) - strpos(reverse(left(s, 400)), '.') + 1) end as text from docs left join j using (doc)""",
)
def clean(spark, d):
    """2.10.1: navigation, code and broken-off lines go; the interface's listing ends a page, which is cut after a sentence."""
    line = """case when i = 36 then 'Constants' when k = 0 then concat('Alpha ', i, ' beta of line ', pos, '.') when k = 3 then concat('Heading of part ', i)
      else element_at(array('Search', 'Crate tally', '1.2.3 (now)', 'let x = 1;', 'core::a core::b core::c d.', 'broken off and of far too many words to be one', '// said.', 'two words.'), cast(i % 8 + 1 as int)) end"""
    return text_of(numbers(spark, d), line, glue="\n\n").select("doc", X.clean_prose(F.col("text"), 400).alias("text"))


@query("chunks")
def chunks(spark, d):
    """2.10.2: SQL has no such fold; tests compare it with a plain loop."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.coalesce("text", F.lit("")), 2000)).alias("pos", "chunk")).select("doc_id", "pos", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("digest"))


@query("head_tail", "select doc_id, case when length(text) <= 1000 then text else left(text, 500) || chr(10) || '...' || chr(10) || right(text, 500) end as text from documents")
def head_tail(spark, d):
    """2.10.3, 2.9.34 tier 3."""
    return read(spark, d, "documents").select("doc_id", X.head_tail(F.col("text"), 500).alias("text"))


@query("clean_paths", f"with {E} select pos, 'ok ' || i as text, case k when 3 then '/other/b' || i else 'src/a' || i end || '.js' as path from e")
def clean_paths(spark, d):
    """2.10.4."""
    text = "concat(if(p = 0, concat(chr(27), '[31m'), ''), 'ok ', if(p = 1, concat(chr(27), '[1;2K'), ''), i, if(p = 0, concat(chr(27), '[0m'), ''))"
    path = "concat(element_at(array('/repo/src/a', './src/a', 'src/a', '/other/b'), cast(k + 1 as int)), i, '.js')"
    return numbers(spark, d).select("pos", X.strip_ansi(F.expr(text)).alias("text"), X.strip_prefix(F.expr(path), "/repo").alias("path"))


@query("short_hash", "select doc_id, left(sha256(text), 22) as hash from documents where text is not null")
def short_hash(spark, d):
    """2.10.5."""
    return read(spark, d, "documents").filter("text is not null").select("doc_id", X.short_hash(F.col("text")).alias("hash"))


@query("model_names", f"with {E} select pos, case k when 1 then 'gpt-' else 'm' end || i as name, case k when 0 then 'bedrock' when 1 then 'openai' when 2 then 'vertex' else 'other' end as provider from e")
def models(spark, d):
    """2.10.6."""
    name = "concat(element_at(array('bedrock/converse/m', 'openai/gpt-', 'vertex_ai/m', 'm'), cast(k + 1 as int)), i, if(p = 0, '-2024-08-06', ''))"
    return numbers(spark, d).select("pos", X.model_name(F.expr(name)).alias("name"), X.provider(F.expr(name)).alias("provider"))


@query("call_costs", "select l_orderkey, round(sum(case when l_linenumber % 2 = 0 then greatest(0, l_quantity - l_suppkey % 10 - 1) else l_quantity end * p_retailprice / 1e6 + l_linenumber * p_size / 1e6 + (l_suppkey % 10) * 1e-7 + 1 * 2e-7) + 1e-9, 5) as cost from lineitem join part on l_partkey = p_partkey group by l_orderkey")
def costs(spark, d):
    """2.10.7: parts stand for the price table."""
    both = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    provider = F.when(F.col("l_linenumber") % 2 == 0, "bedrock").otherwise("openai")
    price = {"prompt": F.col("p_retailprice") / 1e6, "completion": F.col("p_size") / 1e6, "cache_read": F.lit(1e-7), "cache_write": F.lit(2e-7)}
    cost = C.call_cost(provider, F.col("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey") % 10, F.lit(1), price)
    return both.select("l_orderkey", cost.alias("c")).groupBy("l_orderkey").agg(F.round(F.sum("c") + 1e-9, 5).alias("cost"))


@query("semver_ranges", f"""with {E}, v as (select pos, i % 13 as form, k as a, p as b, ms % 5 as c from e)
select pos, case when form in (8, 9, 10) then null when form in (4, 5) then a || '.0.0' when form = 6 then a || '.' || b || '.0' when form = 7 then a || '.' || b || '.' || (c + 1) else a || '.' || b || '.' || c end as lo,
case when form in (3, 7, 10) then null when form = 0 then case when a > 0 then (a + 1) || '.0.0' when b > 0 then '0.' || (b + 1) || '.0' else '0.0.' || (c + 1) end when form in (1, 6) then a || '.' || (b + 1) || '.0' when form in (4, 5) then (a + 1) || '.0.0' when form = 8 then a || '.' || b || '.' || c else case when form = 11 and a > 0 then (a + 1) || '.0.0' when form = 11 and b > 0 then '0.' || (b + 1) || '.0' else a || '.' || b || '.' || (c + 1) end end as hi from v""")
def semver(spark, d):
    """2.10.8: caret, tilde, bare, least, wild, greater, below, up to, any, and the first of several."""
    abc = "concat(k, '.', p, '.', ms % 5)"
    raw = f"element_at(array(concat('^', {abc}), concat('~', {abc}), {abc}, concat('>=', {abc}), concat(k, '.x'), concat('~', k), concat(k, '.', p, '.x'), concat('>', {abc}), concat('<', {abc}), concat('<=', {abc}), '*', concat('^', {abc}, ' || ^9'), concat('v', {abc})), cast(i % 13 + 1 as int))"
    rows = numbers(spark, d).select("pos", V.semver_range(F.expr(raw)).alias("r"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ".")
    return rows.select("pos", text("r.lo").alias("lo"), text("r.hi").alias("hi"))


@query("detected_versions", """with s as (select o_custkey as project, o_orderkey % 5 as f, 9 + o_orderkey % 4 as m from orders), v as (select unnest([10, 11, 12]) as n),
ok as (select project, n, bool_and(case f when 0 then n >= m when 1 then n < m + 2 when 2 then n <= m + 1 when 3 then true else n >= 8 end) as good from s, v group by project, n)
select project, '3.' || max(case when good then n end) as version from ok group by project""")
def detected(spark, d):
    """2.10.19, 2.10.23, 2.4.13: the highest supported version that every signal admits."""
    raw = "element_at(array(concat('>=3.', 9 + o_orderkey % 4), concat('<3.', 11 + o_orderkey % 4), concat('<=3.', 10 + o_orderkey % 4), '*', '^3.8'), cast(o_orderkey % 5 + 1 as int))"
    supported = F.explode(F.array(*map(F.lit, ("3.10", "3.11", "3.12"))))
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.expr(raw).alias("raw")).select("project", V.semver_range(F.col("raw")).alias("r"), supported.alias("version")).withColumn("ok", V.within(F.col("version"), F.col("r")))
    good = rows.groupBy("project", "version").agg(F.bool_and("ok").alias("ok"))
    return good.groupBy("project").agg(F.max_by(F.when(F.col("ok"), F.col("version")), F.when(F.col("ok"), V.parts(F.col("version")))).alias("version"))


SIGNALS_SQL = """s as (select o_custkey as project, o_orderkey as pos, o_orderkey % 9 as f, 9 + o_orderkey % 5 as m from orders),
sig as (select *, case when f < 4 then 'A' when f < 6 then 'B' when f < 8 then 'C' else 'D' end as tier from s), v as (select unnest([10, 11, 12]) as n),
met as (select project, pos, tier, n, case f when 0 then n >= m when 1 then n < m + 2 and n <> 11 when 2 then n <= m + 1 or n = 12 when 3 then n >= m and n < m + 3 when 4 then n in (m, m + 1) when 5 then n = 10 when 6 then n = m when 7 then n = 12 end as ok from sig, v),
left_a as (select project, n, count(*) filter (where tier = 'A' and not ok) = 0 as good, coalesce(bool_or(ok) filter (where tier = 'B'), false) as b, coalesce(bool_or(ok) filter (where tier = 'C'), false) as c, count(*) filter (where ok) as agree from met group by project, n),
left_b as (select * from (select *, bool_or(b) over (partition by project) as any_b from left_a where good) where b or not any_b),
left_c as (select * from (select *, bool_or(c) over (partition by project) as any_c from left_b) where c or not any_c),
best as (select project, min(n) as n, arg_min(agree, n) as agree from left_c group by project),
who as (select project, min(pos) filter (where tier = 'A') as a, min(pos) filter (where tier = 'B' and (f = 5 or m between 9 and 12)) as b, min(pos) filter (where tier = 'C') as c, count(*) filter (where tier <> 'D') as usable from sig group by project)"""


def signals(spark, d):
    """Constraints, matrices and hints of each customer, made of orders; those of tier D say nothing."""
    rows = read(spark, d, "orders").selectExpr("o_custkey as project", "o_orderkey as pos", "o_orderkey % 9 as f", "9 + o_orderkey % 5 as m")
    raw = "element_at(array(concat('>=3.', m), concat('<3.', m + 2, ', != 3.11.*'), concat('<= 3.', m + 1, ' || ==3.12'), concat('>=3.', m, ' <3.', m + 3)), cast(f + 1 as int))"
    versions = "case f when 4 then array(concat('3.', m), concat('3.', m + 1)) when 5 then array('3.10', '2.7') when 6 then array(concat('3.', m)) when 7 then array('3.12') end"
    tier = "case when f < 4 or f = 8 then 'A' when f < 6 then 'B' else 'C' end"
    return rows.selectExpr("project", "pos", f"{tier} as tier", "concat('file', pos) as source", f"if(f < 4, {raw}, null) as raw", f"{versions} as versions")


SUPPORTED = ["3.12", "3.10", "3.11"]


@query("resolved_versions", f"""with {SIGNALS_SQL} select project, '3.' || n as version, case when n is null then 'conflict' when a is not null then 'A' when b is not null then 'B' when c is not null then 'C' else 'default' end as tier,
case when n is null then 'conflict' else coalesce('file' || coalesce(a, b, c), 'default') end as source, usable - coalesce(agree, 0) as n_conflicts from who left join best using (project)""")
def resolved_versions(spark, d):
    """2.10.19, 2.10.23: declared constraints, then matrices, then hints; the tier and the signals that disagree."""
    return R.resolved_versions(signals(spark, d), SUPPORTED)


@query("version_conflicts", f"with {SIGNALS_SQL} select m.project, m.pos, 'file' || m.pos as source from met m join best using (project) where m.n = best.n and not m.ok union all select project, pos, 'file' || pos from sig where tier = 'A' and project not in (select project from best)")
def version_conflicts(spark, d):
    """2.10.19: each signal that its project's version does not meet."""
    found = signals(spark, d)
    return R.version_conflicts(found, R.resolved_versions(found, SUPPORTED)).select("project", "pos", "source")


@query("elapsed", "select o_orderkey, lpad((s // 3600)::varchar, 2, '0') || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as elapsed from (select o_orderkey, (o_orderkey * 37) % 86400 as s from orders)")
def elapsed(spark, d):
    """2.10.9."""
    start = F.col("o_orderdate").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + (F.col("o_orderkey") * 37 % 86400) * 1_000_000)
    return read(spark, d, "orders").select("o_orderkey", X.elapsed(start, end).alias("elapsed"))


@query("http_errors", f"with {E} select pos, case i % 9 when 0 then 'auth' when 1 then case when k = 0 or p = 0 then 'cap' else 'rate_limit' end when 2 then 'overloaded' when 3 then 'server' when 4 then case when k = 1 then 'context' else 'client' end when 5 then 'client' when 6 then 'auth' when 7 then 'server' else 'ok' end as kind from e")
def http(spark, d):
    """2.10.10."""
    status = "element_at(array(401, 429, 529, 500, 400, 404, 403, 503, 200), cast(i % 9 + 1 as int))"
    body = "element_at(array('Usage Limit reached', 'prompt is too long', null, 'slow down'), cast(k + 1 as int))"
    return numbers(spark, d).select("pos", C.http_error(F.expr(status), F.expr(body), F.expr("cast(p as int)")).alias("kind"))


@query("infra_failures", f"with {E} select pos, case when i < 13 or ms % 10 in (1, 2, 3) then 'infra_transient' else 'genuine' end as kind from e")
def infra(spark, d):
    """2.10.10: every sign of a lost machine or network, and the exit codes of kills."""
    marks = ", ".join(f"'{m.upper() if k % 2 else m}'" for k, m in enumerate(C.TRANSIENT_MARKS))
    text = f"case when i < 13 then concat('x: ', element_at(array({marks}), cast(i + 1 as int)), ' y') when k = 0 then null else concat('timed out waiting ', i) end"
    code = "cast(element_at(array(0, 124, 137, 143, 1), cast(least(ms % 10, 4) + 1 as int)) as int)"
    return numbers(spark, d).select("pos", C.infra_failure(F.expr(text), F.expr(f"if(ms % 10 = 9, null, {code})")).alias("kind"))


@query("eval_outcomes", f"with {E} select pos, k = 0 as patch_failed, k = 1 and p < 3 as timed_out, k = 2 and ms % 7 >= 5 as impossible from e")
def outcomes(spark, d):
    """2.10.11: a patch marker near either end of a log, kills, and a clean sheet of a failed run."""
    far = "repeat('x', 9000)"
    log = f"case when k = 0 and p = 0 then concat('PATCH_APPLY_FAILED', {far}) when k = 0 then concat({far}, 'PATCH_APPLY_FAILED') when k = 3 then concat({far}, 'PATCH_APPLY_FAILED', {far}) else null end"
    code = "case k when 1 then element_at(array(124, 137, 143), cast(p + 1 as int)) when 2 then 1 when 3 then 0 end"
    rows = numbers(spark, d).select("pos", F.expr(log).alias("log"), F.expr(code).alias("code"), F.expr("if(k = 1, 0, ms % 7)").alias("p"), F.lit(5).alias("n"))
    return rows.select("pos", C.patch_failed(F.col("log")).alias("patch_failed"), C.timed_out(F.col("code")).alias("timed_out"), C.impossible_claim(F.col("p"), F.col("n"), F.col("code")).alias("impossible"))


@query("usage_fields", f"with {E} select pos, case when k < 2 then ms end as prompt, case when k < 2 then i end as completion from e")
def usage(spark, d):
    """2.10.14: alternate names in model responses."""
    text = """element_at(array(concat('{"usage": {"prompt_tokens": ', ms, ', "completion_tokens": ', i, '}}'), concat('{"usage": {"input_tokens": ', ms, ', "output_tokens": ', i, '}}'), 'not json', concat('{"other": ', ms, '}')), cast(k + 1 as int))"""
    v = F.try_parse_json("j")
    get = lambda a, b: F.coalesce(F.try_variant_get(v, f"$.usage.{a}", "bigint"), F.try_variant_get(v, f"$.usage.{b}", "bigint"))
    return numbers(spark, d).select("pos", F.expr(text).alias("j")).select("pos", get("prompt_tokens", "input_tokens").alias("prompt"), get("completion_tokens", "output_tokens").alias("completion"))


@query("markdown_html", f"with {E} select doc, string_agg(case k when 0 then '<h' || (p + 1) || '>T' || i || '</h' || (p + 1) || '>' when 1 then '<p>a <strong>b' || i || '</strong> <code>c' || ms || '</code></p>' when 2 then '' else '<p>plain ' || i || '</p>' end, chr(10) order by pos) as html from e group by doc")
def markdown(spark, d):
    """2.10.15."""
    line = "case k when 0 then concat(repeat('#', cast(p + 1 as int)), ' T', i) when 1 then concat('a **b', i, '** `c', ms, '`') when 2 then '' else concat('plain ', i) end"
    return text_of(numbers(spark, d), line).select("doc", X.markdown_html(F.col("text")).alias("html"))


@query("top_imports", f"with {E} select doc, coalesce(string_agg(distinct 'm' || i, ',' order by 'm' || i) filter (where k < 2), '') as modules from e group by doc")
def imports(spark, d):
    """2.10.16: by pattern; nested imports are indented and do not count."""
    line = "element_at(array(concat('import m', i), concat('from m', i, if(p = 0, '.sub', ''), ' import x'), concat('    import n', i), concat('x = \"import o', i, '\"')), cast(k + 1 as int))"
    return text_of(numbers(spark, d), line).select("doc", F.array_join(X.top_imports(F.col("text")), ",").alias("modules"))


@query("token_proxy", r"select conv_id, turn, len(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]'))::bigint as n from conversations")
def tokens(spark, d):
    """2.10.17: a proxy; real tokenizers are in the corpus operators."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return read(spark, d, "conversations").select("conv_id", "turn", X.token_proxy(plain).cast("long").alias("n"))


@query("complexity", "select p_brand, case when n < 100 then 'small' when n < 500 then 'medium' when n < 2000 then 'large' else 'massive' end as bucket from (select p_brand, sum(p_size) // 1 as n from part group by p_brand) union all select 'order' || o_orderkey, case when o_orderkey % 2500 < 100 then 'small' when o_orderkey % 2500 < 500 then 'medium' when o_orderkey % 2500 < 2000 then 'large' else 'massive' end from orders")
def complexity(spark, d):
    """2.10.18: by the number of functions."""
    brands = read(spark, d, "part").groupBy("p_brand").agg(X.complexity(F.sum("p_size")).alias("bucket"))
    return brands.unionByName(read(spark, d, "orders").select(F.expr("concat('order', o_orderkey)").alias("p_brand"), X.complexity(F.col("o_orderkey") % 2500).alias("bucket")))


@query("dependencies", f"with {E} select distinct doc, case k when 0 then 'numpy-' || i when 1 then 'pyyaml' when 2 then 'my-pkg-' || i else 'python-dateutil' end as package, case k when 0 then 'numpy_' || i when 1 then 'yaml' when 2 then 'my_pkg_' || i else 'dateutil' end as module from e")
def dependencies(spark, d):
    """2.10.20, 2.10.24: merged from several files, the first of each name."""
    from tallyspark.operators.dedup import keep_first

    spec = "element_at(array(concat('NumPy.', i, '>=1.20'), concat('PyYAML==6.', i, ' ; python_version<\\'4\\''), concat(' my_pkg.', i, ' @ file:///x'), 'python_dateutil[x]'), cast(k + 1 as int))"
    rows = numbers(spark, d).withColumn("package", X.package_name(F.expr(spec)))
    return keep_first(rows, ["doc", "package"], "pos").select("doc", "package", X.import_name(F.col("package")).alias("module"))


@query("frameworks", f"with {E} select pos, case when i % 11 < 3 then 'gtest' when i % 11 = 3 then 'doctest' when i % 11 = 4 then 'catch2' when i % 11 < 7 then 'boost_test' when i % 11 < 9 then 'ctest' else 'unknown' end as framework from e")
def frameworks(spark, d):
    """2.10.22, 2.9.9."""
    logs = ["[==========] 3 tests", "[ RUN      ] A.b", "[  PASSED  ] 2 tests", "[doctest] test cases: 1 | assertions: 2", "test cases: 3\\nassertions: 4", "*** No errors detected ***", "*** Errors were detected in A", "Test project /b", "97% tests passed", "All tests passed!", "Running 3 test cases..."]
    text = "concat('log ', pos, '\\n', element_at(array(" + ", ".join(f"'{x}'" for x in logs) + "), cast(i % 11 + 1 as int)))"
    return numbers(spark, d).select("pos", C.framework(F.expr(text)).alias("framework"))


@query("licences", f"with {E} select pos, case i % 7 when 0 then 'apache-2.0' when 1 then 'mit' when 2 then 'lgpl' when 3 then 'gpl' when 4 then 'mpl-2.0' when 5 then 'bsd' else 'unknown' end as licence from e")
def licences(spark, d):
    """2.10.22."""
    text = "concat('Copyright ', i, '\\n', element_at(array('Apache License Version 2.0', 'Permission is hereby granted, free of charge, to any', 'GNU Lesser General Public License', 'GNU GENERAL PUBLIC LICENSE', 'Mozilla Public License 2.0', 'Redistribution and use in source and binary forms', 'mine'), cast(i % 7 + 1 as int)))"
    return numbers(spark, d).select("pos", C.licence(F.expr(text)).alias("licence"))


@query("compiler_counts", f"with {E} select doc, count(*) filter (where k = 0 and i % 2 = 0) as syntax, count(*) filter (where k = 1) as semantic, count(*) filter (where k = 2) as other from e group by doc")
def compiler(spark, d):
    """2.9.29: lines that only name an error do not count."""
    odd = "element_at(array('2 errors', 'note: 2 errors', 'x = new errorHandler();', 'error: without a place', 'Unexpected expected'), cast(i % 5 + 1 as int))"
    line = f"""case when k = 0 and i % 2 = 0 then concat('A.java:', i, ': error: ', element_at(array('\\';\\' expected', 'Illegal start of type'), cast(p % 2 + 1 as int)))
      when k = 1 then concat('B.java:', i, ': error: ', element_at(array('cannot find symbol', 'package x does not exist'), cast(p % 2 + 1 as int)))
      when k = 2 then concat('C.java:', i, ': error: unexpected, expected') else {odd} end"""
    rows = text_of(numbers(spark, d), line).select("doc", C.compiler_counts(F.col("text")).alias("c"))
    return rows.select("doc", *[F.col(f"c.{n}").cast("long").alias(n) for n in ("syntax", "semantic", "other")])
