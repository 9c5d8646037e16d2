"""Parser queries over texts made of table rows, and over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import joins as J
from tallyspark.operators import parsers as P
from tallyspark.plans.registry import query, read
from tallyspark.plans.rendered import STATUS, E, numbers, text_of
from tallyspark.sources import readers, writers


@query("go_json", f"""with {E}, t as (select doc, 'p' || p || '/T' || i as test_id, pos, k, case when k < 3 then {STATUS} end as status, ms / 1000.0 as s from e where pos % 11 > 0),
b as (select doc, test_id, arg_max(status, [case k when 1 then 2 when 0 then 1 else 0 end, pos]) as status, arg_max(s, [case k when 1 then 2 when 0 then 1 else 0 end, pos]) as duration from t where k < 3 group by doc, test_id)
select doc, test_id, status, duration from b union all select distinct doc, test_id, 'ERROR', null from t where k = 3 and (doc, test_id) not in (select doc, test_id from b)""")
def go_json(spark, d):
    """2.9.1: a failure holds, a pass outlives a skip, the later of equals; a test that only starts errs."""
    word = "element_at(array('pass', 'fail', 'skip', 'run'), cast(k + 1 as int))"
    line = f"""case when pos % 11 = 0 then 'not json' else concat('{{"Action":"', {word}, '","Package":"p', p, '","Test":"T', i, '"', if(k < 3, concat(',"Elapsed":', ms / 1000), ''), '}}') end"""
    return P.go_json(text_of(numbers(spark, d), line)).select("doc", "test_id", "status", "duration")


@query("go_plain", f"""with {E}, w as (select *, last_value(case when k = 3 then p end ignore nulls) over (partition by doc order by pos rows unbounded preceding) as pkg from e),
t as (select doc, coalesce('pkg/p' || pkg || '/', '') || 'T' || i as test_id, k, pos from w where k < 3)
select doc, test_id, arg_max({STATUS}, [case k when 1 then 2 when 0 then 1 else 0 end, pos]) as status from t group by doc, test_id""")
def go_plain(spark, d):
    """2.9.2: the package line above names the package."""
    line = "case when k = 3 then concat(if(ms % 2 = 0, 'ok  ', 'FAIL'), '\\tpkg/p', p, '\\t0.1s') else concat(if(ms % 5 = 0, '    ', ''), '--- ', element_at(array('PASS', 'FAIL', 'SKIP'), cast(k + 1 as int)), ': T', i, ' (0.00s)') end"
    return P.go_plain(text_of(numbers(spark, d), line)).select("doc", "test_id", "status")


@query("rust_tests", f"""with {E}, t as (select doc, pos, i // 9 as n, case when k = 1 then 'FAILED' when k = 2 then 'SKIPPED' else 'PASSED' end as status from e),
text as (select *, lag((n, status)) over (partition by doc order by pos) as b from t where doc % 2 = 0 and pos % 7 > 0)
select doc, 'm::t' || n as name, status from text where b is distinct from (n, status) union all select doc, 'x' || n, status from t where doc % 2 = 1""")
def rust(spark, d):
    """2.9.3, 2.9.4, 2.6.1: libtest text without doc tests and adjacent repeats; nextest's JSON."""
    text = "case when pos % 7 = 0 then concat('test src/lib.rs - f', i, ' (line 3) ... ok') else concat('test m::t', i div 9, ' ... ', element_at(array('ok', 'FAILED', 'ignored', 'ok'), cast(k + 1 as int))) end"
    json = """concat('{"type":"test","event":"', element_at(array('ok', 'failed', 'ignored', 'ok'), cast(k + 1 as int)), '","name":"x', i div 9, '"}\\n{"type":"suite","event":"started"}')"""
    return P.rust_tests(text_of(numbers(spark, d), f"if(doc % 2 = 0, {text}, {json})")).select("doc", "name", "status")


def _jest(spark, d):
    """(doc, text): suites by package; the reports of every fifth user are cut short."""
    e = numbers(spark, d)
    test = F.struct("pos", F.when(F.col("i") > 4, F.concat(F.lit("t"), "i")).alias("fullName"), F.expr("element_at(array('passed', 'failed', 'pending', 'odd'), cast(k + 1 as int))").alias("status"), F.col("ms").alias("duration"))
    suites = e.groupBy("doc", "p").agg(F.array_sort(F.collect_list(test)).alias("a"))
    items = F.transform("a", lambda x: F.struct(x["fullName"].alias("fullName"), x["status"].alias("status"), x["duration"].alias("duration")))
    whole = suites.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("s"), "p").alias("name"), items.alias("assertionResults")))).alias("testResults"))
    text = F.to_json(F.struct("testResults"))
    return whole.select("doc", F.when(F.col("doc") % 5 == 0, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text).alias("text"))


@query("jest", f"""with {E}, t as (select *, case k when 0 then 'PASSED' when 2 then 'SKIPPED' else 'FAILED' end as status, row_number() over (partition by doc, p order by pos) - 1 as n, row_number() over (partition by doc order by p, pos) - 1 as all_n from e),
r as (select *, row_number() over (partition by doc order by p, pos) - 1 as cut_n from t where doc % 5 = 0 and k < 3)
select doc, 's' || p || '::' || case when i > 4 then 't' || i else '#' || n end as key, status, ms / 1000.0 as seconds from t where doc % 5 > 0
union all select doc, '<regex-' || cut_n || '>', status, 0 from r""")
def jest(spark, d):
    """2.9.5, 2.9.7: whole reports and, by pattern, those cut short."""
    return P.jest(_jest(spark, d))


@query("jest_crashed", f"with {E} select doc, count(*) filter (where k < 3) = 0 or bool_or(k = 3) as crashed from e group by doc")
def jest_crashed(spark, d):
    """2.9.30: an empty suite that has a message is a crash, and so is a report without suites."""
    suite = F.when(F.col("k") == 3, F.lit('{"name":"a","assertionResults":[],"failureMessage":"boom"}')).otherwise(F.lit('{"name":"b","assertionResults":[{"status":"passed"}]}'))
    docs = text_of(numbers(spark, d), suite, glue=",")
    return P.jest_crashed(docs.select("doc", F.concat(F.lit('{"testResults":['), "text", F.lit("]}")).alias("text")))


@query("mocha", f"with {E} select doc, 't' || i as name, case when bool_or(k = 1) then 'FAILED' when bool_or(k = 0) then 'PASSED' else 'SKIPPED' end as status from e where k < 3 group by doc, i")
def mocha(spark, d):
    """2.9.6."""
    item = F.struct(F.concat(F.lit("t"), "i").alias("fullTitle"))
    part = lambda k: F.collect_list(F.when(F.col("k") == k, item))
    docs = numbers(spark, d).groupBy("doc").agg(part(0).alias("passes"), part(1).alias("failures"), part(2).alias("pending"))
    return P.mocha(docs.select("doc", F.to_json(F.struct("passes", "failures", "pending")).alias("text"))).select("doc", "name", "status")


@query("tap", f"""with {E} select doc, pos, 'p' || p || ' > t' || i as name, case when k = 3 then 'SKIPPED' else {STATUS} end as status, case when ms % 2 = 0 then ms / 1000.0 else 0 end as seconds from e
union all select doc, pos, 'p' || p, 'PASSED', 0 from e""")
def tap(spark, d):
    """2.9.8: a UDTF, as subtests need a stack."""
    word = "element_at(array('ok 1 - t', 'not ok 1 - t', 'ok 1 - t', 'not ok 1 - t'), cast(k + 1 as int))"
    line = f"concat('# Subtest: p', p, '\\n    ', {word}, i, if(k > 1, ' # SKIP later', ''), if(ms % 2 = 0, concat('\\n      ---\\n      duration_ms: ', ms, '\\n      ...'), ''), '\\nok 1 - p', p)"
    rows = numbers(spark, d).withColumn("doc", F.struct("doc", "pos"))
    return P.tap(text_of(rows, line)).select("doc.doc", "doc.pos", "name", "status", "seconds")


@query("gtest", f"with {E} select doc, 'S.t' || pos as name, {STATUS} as status, case when p = 0 then 0 else ms / 1000.0 end as seconds from e where k < 2")
def gtest(spark, d):
    """2.9.9: with and without times, also behind CTest's numbers."""
    line = "concat(if(doc % 2 = 0, '3: ', ''), '[ RUN      ] S.t', pos, if(k < 2, concat(if(k = 1, '\nx.cc:1: Failure', ''), '\n', if(doc % 2 = 0, '3: ', ''), if(k = 0, '[       OK ] S.t', '[  FAILED  ] S.t'), pos, if(p = 0, '', concat(' (', ms, ' ms)'))), ''))"
    return P.gtest(text_of(numbers(spark, d), line)).select("doc", "name", "status", "seconds")


def counted_sql(prefix: str, good: str, bad: str) -> str:
    """Made names for the passes and failures of each user."""
    return f"""with {E}, s as (select doc, {good} as g, {bad} as b from e group by doc) select doc, '{prefix}_test_' || n as name, 'PASSED' as status from (select doc, unnest(range(1, g + 1)) as n from s) union all select doc, '{prefix}_failed_' || n, 'FAILED' from (select doc, unnest(range(1, b + 1)) as n from s)"""


def _sums(spark, d, text: str):
    """(doc, text) from g passes and b failures of each user."""
    sums = numbers(spark, d).groupBy("doc").agg(F.count_if(F.col("k") != 1).alias("g"), F.count_if(F.col("k") == 1).alias("b"))
    return sums.select("doc", F.expr(text).alias("text"))


@query("catch2", counted_sql("catch2", "count(*) filter (where k <> 1)", "count(*) filter (where k = 1)"))
def catch2(spark, d):
    """2.9.9: the summary counts cases, in one of two forms."""
    return P.catch2(_sums(spark, d, "if(b = 0, concat('All tests passed (9 assertions in ', g, ' test cases)'), concat('x.cpp:3: FAILED:\ntest cases: ', g + b, ' | ', g, ' passed | ', b, ' failed\nassertions: 20 | 3 passed | 17 failed'))"))


@query("doctest", counted_sql("doctest", "case when doc % 2 = 0 then count(*) else count(*) filter (where k <> 1) end", "case when doc % 2 = 0 then 0 else count(*) filter (where k = 1) end"))
def doctest(spark, d):
    """2.9.9: without a table all cases pass."""
    return P.doctest(_sums(spark, d, "concat('[doctest] doctest version is 2.4\n[doctest] test cases: ', g + b, if(doc % 2 = 0, '', concat(' | ', g, ' passed | ', b, ' failed | 0 skipped')))"))


@query("boost", counted_sql("boost", "case when count(*) filter (where k = 1) > 0 or doc % 2 = 0 then count(*) filter (where k <> 1) else 1 end", "count(*) filter (where k = 1)"))
def boost(spark, d):
    """2.9.9: an errorless run without a count is one test."""
    return P.boost(_sums(spark, d, "case when b > 0 then concat('Running ', g + b, ' test cases...\n*** ', b, ' failures are detected in the test module \"m\"\n*** Errors were detected') when doc % 2 = 0 then concat('Running ', g, ' test cases...\n*** No errors detected ***') else '*** No errors detected ***' end"))


@query("ctest", f"with {E} select doc, 't' || pos as name, case when k = 3 then 'FAILED' else {STATUS} end as status, ms / 100.0 as seconds from e")
def ctest(spark, d):
    """2.9.10."""
    word = "element_at(array('   Passed', '***Failed', '***Not Run', '***Timeout'), cast(k + 1 as int))"
    return P.ctest(text_of(numbers(spark, d), f"concat(' ', i + 1, '/37 Test  #', i + 1, ': t', pos, ' ..........', {word}, '    ', ms / 100, ' sec')")).select("doc", "name", "status", "seconds")


@query("junit", f"with {E}, t as (select *, row_number() over (partition by doc order by pos desc) = 1 and k = 3 as cut from e) select doc, case when p > 0 then 'C' || p || '#' else '' end || 't' || pos as test_id, case when k = 3 then case when cut then 'PASSED' else 'ERROR' end else {STATUS} end as status from t")
def junit(spark, d):
    """2.1.7, 2.1.8: by pattern, so that a report cut short inside its last case still yields rows."""
    inner = "element_at(array('', '<failure message=\"x\"/>', '<skipped/>', '<error type=\"e\">x</error>'), cast(k + 1 as int))"
    line = f"""concat('<testcase ', if(p > 0, concat('classname="C', p, '" '), ''), 'name="t', pos, '"', if(k = 0, '/>', concat('>', {inner}, '</testcase>')))"""
    docs = text_of(numbers(spark, d), line)
    cut = F.regexp_replace("text", r'<error type="e">x</error></testcase>$', "<err")
    return P.junit(docs.select("doc", F.concat(F.lit("<testsuite>"), cut).alias("text"))).select("doc", "test_id", "status")


@query("pytest_ids", f"with {E}, t as (select *, min(pos) filter (where i = 36) over (partition by doc) as banner from e) select distinct doc, case when p = 0 then 'tests/' else 'tests/sub/' end || 'test_a.py::test_' || i as test_id from t where (banner is null or pos < banner) and k < 3")
def pytest_ids(spark, d):
    """2.9.11: what a quiet collection lists up to its banner."""
    line = "case when i = 36 then '9 tests collected in 0.1s' when k = 3 then 'warning: something' else concat(if(p = 0, '', 'tests/sub/'), 'test_a.py::test_', i) end"
    return P.pytest_ids(text_of(numbers(spark, d), line), "tests").select("doc", "test_id")


@query("go_list", f"with {E}, t as (select *, min(pos) filter (where k = 3) over (partition by doc order by pos rows between current row and unbounded following) as ends from e), n as (select doc, pos, p from e where k = 3) select t.doc, t.pos, coalesce('pkg/p' || n.p, 'mod') || case when t.p = 0 then '/Test' when t.p = 1 then '/Example' else '/Fuzz' end || t.i as test_id from t left join n on t.doc = n.doc and t.ends = n.pos where t.k < 2")
def go_list(spark, d):
    """2.9.12: names come before the line of their package; benchmarks are left out."""
    line = "case when k = 3 then concat(if(ms % 2 = 0, 'ok  ', '?   '), '\\tpkg/p', p, '\\t0.1s') when k = 2 then concat('Benchmark', i) else concat(element_at(array('Test', 'Example', 'Fuzz'), cast(p + 1 as int)), i) end"
    rows = numbers(spark, d)
    found = P.go_list(text_of(rows, line), "mod")
    from pyspark.sql import Window

    at = rows.withColumn("line_no", F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1).select("doc", "line_no", F.col("pos").alias("at"))
    return found.join(at, (found["doc"] == at["doc"]) & (found["pos"] == at["line_no"])).select(found["doc"], F.col("at").alias("pos"), "test_id")


@query("cargo_list", f"with {E} select doc, 'm::t' || pos as test_id from e where k < 2 union all select doc, 'late' || i from e where k = 2 and p = 0")
def cargo_list(spark, d):
    """2.9.12: ``name: test`` lines; benches and status lines are left out."""
    line = "case when k < 2 then concat('m::t', pos, ': test') when k = 2 and p = 0 then concat('late', i, ': test  ') when k = 2 then concat('b', i, ': bench') else concat('Running unittests src/lib', i, ': test') end"
    return P.cargo_list(text_of(numbers(spark, d), line)).select("doc", "test_id")


@query("gtest_list", f"with {E}, t as (select *, last_value(case when k = 3 then pos end ignore nulls) over (partition by doc order by pos rows unbounded preceding) as suite from e) select doc, 'S' || suite || '.t' || pos as test_id from t where k < 3 and suite is not null")
def gtest_list(spark, d):
    """2.9.13: a binary's listing, tests indented below their suites, comments cut off."""
    line = "if(k = 3, concat('S', pos, '.'), concat('  t', pos, if(p = 0, '  # GetParam() = 4', '')))"
    return P.gtest_list(text_of(numbers(spark, d), line)).select("doc", "test_id")


@query("static_tests", f"with {E} select distinct doc, 'suite' || i || ' > it t' || pos as name from e where k = 0 union all select doc, 't' || pos from e where k = 1")
def static_tests(spark, d):
    """2.9.14, 2.9.33: test calls nest by indentation; comments and other calls do not count."""
    line = """case k when 0 then concat('describe("suite', i, '", () => {\\n  it("it t', pos, '", () => {});\\n  it("it t', pos, '", again);\\n});') when 1 then concat('test(`t', pos, '`, async () => {})') when 2 then concat('it.skip("t', pos, '", f)') else concat('// test("gone', pos, '")') end"""
    return P.static_tests(text_of(numbers(spark, d), line)).select("doc", "name")


@query("indent_tree", f"with {E}, t as (select *, last_value(case when k = 3 then pos end ignore nulls) over w as m, last_value(case when k = 2 then pos end ignore nulls) over w as c from e window w as (partition by doc order by pos rows unbounded preceding)) select doc, 'm' || m || '.py' || case when p > 0 then '::T' || c else '' end || '::test_' || pos as node from t where k < 2 and m is not null and (p = 0 or c > m)")
def indent_tree(spark, d):
    """2.6.11: a running value for each depth instead of a stack."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("pos")
    rows = numbers(spark, d)
    for k, name in ((3, "m"), (2, "c")):
        rows = rows.withColumn(name, F.last(F.when(F.col("k") == k, F.col("pos")), ignorenulls=True).over(w))
    line = "case when m is null then null when k = 3 then concat('  <Module m', pos, '.py>') when k = 2 then concat('    <Class T', pos, '>') when p = 0 then concat('    <Function test_', pos, '>') when c > m then concat('    <Class T', c, '>\\n      <Function test_', pos, '>') end"
    return P.indent_tree(text_of(rows, line)).select("doc", "node")


@query("eval_lines", f"with {E} select doc, 'r' || pos as name, case when k = 1 then 0 else ms / 10.0 end as runtime, case when k = 0 then i end as passed, case when k = 0 then 37 else i end as tests, case when k = 1 then 'INVENTORY_MISMATCH' else 'OK' end as status from e where k < 2")
def eval_lines(spark, d):
    """2.9.20."""
    line = "case k when 0 then concat('r', pos, ',', ms / 10, ',', i, '/37') when 1 then concat('INVENTORY_MISMATCH,r', pos, ',', i, ',5,2') when 2 then 'repo,runtime,num_passed/num_tests' else concat('noise,', i) end"
    return P.eval_lines(text_of(numbers(spark, d), line))


@query("sections", f"""with {E}, t as (select *, max(case when k = 3 then pos end) over (partition by doc order by pos rows unbounded preceding) as head from e)
select doc, 'head ' || head as section, coalesce(string_agg(case when k < 3 then 'body ' || pos end, chr(10) order by pos), '') as body from t where head is not null group by doc, head""")
def sections(spark, d):
    """2.9.21: the text below each heading, up to the next."""
    line = "if(k = 3, concat(element_at(array('# ', '## ', '### '), cast(p + 1 as int)), 'Head ', pos, if(p = 1, ' ##', '')), concat('body ', pos))"
    return P.sections(text_of(numbers(spark, d), line)).select("doc", "section", "body")


@query("verdicts", f"with {E} select doc, 'c' || i as id, k = 0 as passed, pos from e where i < 20 and doc % 7 > 0")
def verdicts(spark, d):
    """2.9.22: the JSON list in an answer; unknown ids are dropped, an answer without a list has none."""
    item = """concat('{"id": "c', i, '", "note": "[', pos, ']"', if(k = 0, ', "passed": true', if(k = 1, ', "passed": false', '')), ', "pos": ', pos, '}')"""
    docs = text_of(numbers(spark, d), item, glue=", ").select("doc", F.expr("if(doc % 7 = 0, 'no list', concat('Sure: [', text, '] done'))").alias("text"))
    return P.verdicts(docs, [f"c{i}" for i in range(20)]).select("doc", "id", "passed", "pos")


@query("edit_blocks", f"with {E}, t as (select *, row_number() over (partition by doc order by pos) - 1 as n from e where k < 3) select doc, n as k, 'src/f' || pos || '.py' as path, case when k = 0 then '' else 'old ' || i || chr(10) end as old, case when k = 2 then '```x' || chr(10) else '' end || 'new ' || ms || chr(10) as new from t")
def edits(spark, d):
    """2.9.15, 2.9.24: fences match by their length."""
    line = "if(k = 3, concat('some text ', i), concat('src/f', pos, '.py\\n', if(k = 2, '````', '```'), 'python\\n<<<<<<< SEARCH\\n', if(k = 0, '', concat('old ', i, '\\n')), '=======\\n', if(k = 2, '```x\\n', ''), 'new ', ms, '\\n>>>>>>> REPLACE\\n', if(k = 2, '````', '```')))"
    return P.edit_blocks(text_of(numbers(spark, d), line)).select("doc", F.col("k").cast("long").alias("k"), "path", "old", "new")


@query("think_and_code", f"with {E} select doc, 'think' as kind, 'hm ' || pos as body from e where k = 0 union all select doc, 'code', 'x = ' || pos || chr(10) from e where k = 1")
def think(spark, d):
    """2.9.16: blank thoughts do not count."""
    line = "case k when 0 then concat(if(p = 0, '<think> hm ', '<thinking>hm '), pos, if(p = 0, ' </think>', '</thinking>')) when 1 then concat('```python\\nx = ', pos, '\\n```') when 2 then '<think>  </think>' else 'text' end"
    text = text_of(numbers(spark, d), line)
    return P.think_blocks(text).select("doc", F.lit("think").alias("kind"), "body").unionByName(P.code_blocks(text).select("doc", F.lit("code").alias("kind"), "body"))


@query("error_gate", f"with {E}, a as (select doc, i, count(*) filter (where k = 0) as was, count(*) filter (where k = 1) as now from e group by doc, i) select doc, 'f' || i || '.rs' as file, now - was as more from a where now > was")
def error_gate(spark, d):
    """2.9.28, 2.9.23: files with more errors after than before."""
    line = "concat('f', i, '.rs:', pos, if(p = 0, ':2', ''), if(p = 1, ': fatal error: x', ': error y'))"
    other = "concat('f', i, '.rs:', pos, ':1: warning: z')"
    e = numbers(spark, d)
    before, after = (P.error_counts(text_of(e, f"if(k = {k}, {line}, {other})")) for k in (0, 1))
    return P.more_errors(before, after)


@query("pytest_summary", f"""with {E} select doc, pos, case when k = 2 then 0 else i + 1 end as passed, case when k = 1 then ms else 0 end as failed, case when k = 3 then 1 else 0 end as errors, case when p = 0 and k < 2 then 2 else 0 end as skipped, case k when 2 then 'NO_TESTS' when 3 then 'COLLECTION_ERROR' else 'OK' end as status from e""")
def summary(spark, d):
    """2.9.31."""
    text = "case k when 2 then 'no tests ran in 0.1s' when 3 then concat('ERROR collecting a.py\\n', i + 1, ' passed, 1 error in 0.1s') else concat('== ', if(k = 1, concat(ms, ' failed, '), ''), i + 1, ' passed', if(p = 0, ', 2 skipped', ''), ' in 1s ==') end"
    rows = numbers(spark, d).select(F.struct("doc", "pos").alias("doc"), F.expr(text).alias("text"), F.expr("cast(if(k = 2, 5, 1) as int)").alias("exit_code"))
    return P.pytest_summary(rows).select("doc.doc", "doc.pos", "passed", "failed", "errors", "skipped", "status")


def _histories(spark, d):
    """(doc, text): event lists; answers cite the action before them or one that never was."""
    head = """concat('{"kind":"', element_at(array('ActionEvent', 'ObservationEvent', 'ObservationEvent', 'MessageEvent'), cast(k + 1 as int)), '"', if(k < 3, concat(',"tool":"', if(p = 0, 'run', 'edit'), '"'), '')"""
    call = """case k when 0 then concat(',"tool_call_id":"c', i, '"') when 1 then concat(',"action_id":"c', i, '"') when 2 then concat(',"action_id":"z', i, '"') else '' end"""
    body = """case when k = 3 then '' when ms % 2 = 0 then concat(',"content":"say ', pos, '"') else concat(',"content":[{"text":"part ', pos, '"},{"text":"x"}]') end"""
    docs = text_of(numbers(spark, d), f"{head}, {call}, {body}, '}}')", glue=",")
    return docs.select("doc", F.concat(F.lit("["), "text", F.lit("]")).alias("text"))


@query("history_events", f"""with {E} select doc, row_number() over (partition by doc order by pos) - 1 as pos, case k when 0 then 'ActionEvent' when 3 then 'MessageEvent' else 'ObservationEvent' end as kind, case when k < 3 then case when p = 0 then 'run' else 'edit' end end as tool,
case k when 0 then 'c' || i when 1 then 'c' || i when 2 then 'z' || i end as call_id, case when k = 3 then '' when ms % 2 = 0 then 'say ' || pos else 'part ' || pos end as text from e""")
def history(spark, d):
    """2.9.18."""
    return P.history_events(_histories(spark, d)).select("doc", F.col("pos").cast("long").alias("pos"), "kind", "tool", "call_id", "text")


@query("observed_histories", f"""with {E}, a as (select doc, i, arg_max(case when p = 0 then 'run' else 'edit' end, pos) as tool from e where k = 0 group by doc, i), o as (select doc, pos, i, k, case when p = 0 then 'run' else 'edit' end as tool from e where k in (1, 2))
select 'orphan' as kind, o.doc as module, case when k = 1 then 'c' else 'z' end || o.i as id from o left join a on a.doc = o.doc and a.i = o.i and k = 1 where a.i is null union all select 'mismatch', o.doc, 'c' || o.i from o join a on a.doc = o.doc and a.i = o.i where k = 1 and a.tool <> o.tool""")
def observed(spark, d):
    """2.4.6-7 over parsed histories."""
    e = P.history_events(_histories(spark, d)).withColumnRenamed("doc", "module")
    actions, seen = e.filter("kind = 'ActionEvent'"), e.filter("kind = 'ObservationEvent'").withColumnRenamed("call_id", "action_id")
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), "module", F.col("action_id").alias("id"))
    return part(J.orphan_observations(seen, actions), "orphan").unionByName(part(J.mismatched_observations(seen, actions), "mismatch"))


@query("turn_events", "select conv_id as conv, turn, k.k, k.kind, (conv_id * 1000000 + turn * 1000 + k.ms)::bigint as ts_ms from conversations join (values ('user', 0, 'MessageEvent', 0), ('assistant', 0, 'ActionEvent', 10), ('assistant', 1, 'ObservationEvent', 50), ('assistant', 2, 'FinishEvent', 100)) as k(r, k, kind, ms) on k.r = case when role = 'user' then 'user' else 'assistant' end")
def turn_events(spark, d):
    """2.9.19."""
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", F.timestamp_millis(F.col("conv_id") * 1_000_000 + F.col("turn") * 1000).alias("ts"))
    return P.turn_events(rows)


@query("digests", "select conv_id, left(string_agg(role || ': ' || left(text, 40), chr(10) order by turn), 200) as digest from conversations group by conv_id")
def digests(spark, d):
    """2.9.26."""
    part = F.concat("role", F.lit(": "), F.substring("text", 1, 40))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("a")).select("conv_id", F.substring(F.array_join(F.transform("a", lambda x: x["p"]), "\n"), 1, 200).alias("digest"))


@query("balanced", f"with {E}, t as (select *, sum(case k when 0 then 1 when 1 then -1 else 0 end) over (partition by doc order by pos rows unbounded preceding) as n from e) select doc, min(n) >= 0 and arg_max(n, pos) = 0 as ok from t group by doc union all select doc + 1000000, count(*) filter (where i = 36) = 0 from e group by doc")
def balanced(spark, d):
    """2.9.25: braces in comments, also nested ones, strings, raw strings and characters do not count."""
    e = numbers(spark, d)
    odd = """element_at(array('x = "}"; // }', '/* { /* } */ { */ y', 'r#"{ " } }"# z', "'{' '}' b'}' 'a {}", '"\\\\" [ "', 'br##"}"#"##'), cast(i % 6 + 1 as int))"""
    signs = f"case k when 0 then '{{' when 1 then '}}' else {odd} end"
    paired = f"concat('fn f', pos, '() {{ ', {odd}, '\\n}}', if(i = 36, ' [', ''))"
    texts = text_of(e, signs).unionByName(text_of(e, paired).withColumn("doc", F.col("doc") + 1_000_000))
    return P.balanced(texts)


#: A source of one item an event; what ``k`` 2 and 3 stand on are tests.
ITEM = """concat(element_at(array('/// of ', '// {\\n#[inline]\\n// ', '#[test]\\n// ', '#[cfg(test)]\\n#[x]\\n// '), cast(k + 1 as int)), pos, '\\n', element_at(array('fn f', 'mod m', 'fn t', 'mod u'), cast(k + 1 as int)), pos, '() {\\n  let s = "}";\\n}')"""
ITEM_SQL = """(case k when 0 then '/// of ' when 1 then '// {' || chr(10) || '#[inline]' || chr(10) || '// ' when 2 then '#[test]' || chr(10) || '// ' else '#[cfg(test)]' || chr(10) || '#[x]' || chr(10) || '// ' end || pos || chr(10) ||
  case k when 0 then 'fn f' when 1 then 'mod m' when 2 then 'fn t' else 'mod u' end || pos || '() {' || chr(10) || '  let s = "}";' || chr(10) || '}')"""


@query("test_items", f"with {E} select doc, row_number() over (partition by doc order by pos) - 1 as pos, {ITEM_SQL} as item, k >= 2 as is_test from e")
def test_items(spark, d):
    """2.9.25: the items of a source and which of them are tests."""
    return P.test_items(text_of(numbers(spark, d), ITEM))


@query("restored_sources", f"""with {E}, m as (select doc, string_agg({ITEM_SQL}, chr(10) order by pos) filter (where k < 2) as own from e where pos % 2 = 0 group by doc), whole as (select doc, string_agg({ITEM_SQL}, chr(10) order by pos) as text from e where pos % 2 = 0 group by doc),
b as (select doc, string_agg({ITEM_SQL}, chr(10) order by pos) filter (where k >= 2) as tests from e where pos % 2 = 1 group by doc)
select doc, sha256(case when tests is null then text else coalesce(own, '') || chr(10) || chr(10) || tests || chr(10) end) as digest from whole join m using (doc) left join b using (doc)""")
def restored_sources(spark, d):
    """2.9.25: what a model wrote, with the tests of the base."""
    e = numbers(spark, d)
    out = P.restored_sources(text_of(e.filter("pos % 2 = 0"), ITEM), text_of(e.filter("pos % 2 = 1"), ITEM))
    return out.select("doc", F.sha2("text", 256).alias("digest"))


@query("sse_streams", f"""with {E}, t as (select *, case when doc % 3 = 0 and row_number() over (partition by doc order by pos desc) = 1 then 'done' when k = 3 and i = 36 then 'failed' end as ends from e)
select doc as stream, coalesce(string_agg(case when ends is null and k < 2 then 'w' || i || ' ' end, '' order by pos), '') as text, case when bool_or(coalesce(ends = 'failed', false)) then 'failed' when bool_or(coalesce(ends = 'done', false)) then 'complete' else 'truncated' end as outcome from t group by doc""")
def sse(spark, d):
    """2.11.2."""
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("pos"))) == 1
    rows = numbers(spark, d).withColumn("done", last & (F.col("doc") % 3 == 0))
    line = """case when done then 'data: {"type":"response.completed"}' when k = 3 and i = 36 then 'data: {"type":"response.failed"}' when k < 2 then concat('data: {"type":"response.output_text.delta","delta":"w', i, ' "}') when k = 2 then 'data: [DONE]' else ': keep-alive' end"""
    return P.sse_streams(rows.select(F.col("doc").alias("stream"), "pos", F.expr(line).alias("line")))


@query("marker_seen", f"with {E}, t as (select *, row_number() over (partition by doc order by pos) as n, count(*) over (partition by doc) as c from e) select doc as stream, coalesce(bool_or(i = 36 and k < 2), false) or bool_or(n = 1 and doc % 3 < 2 and c >= 6) as seen from t group by doc")
def markers(spark, d):
    """2.11.3: a marker that is split between many chunks; without its quotes or its line end it is none."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
    pieces = """element_at(if(doc % 3 = 0, array('{"ty', 'pe": "resp', '', 'onse', '.compl', 'eted"}'), if(doc % 3 = 1, array('event', ': resp', 'onse.', 'fai', 'led', ' {}'), array('x event', ': resp', 'onse.', 'fai', 'led', ' {}'))), n)"""
    chunk = f"""case when n <= 6 then {pieces} when i = 36 and k < 2 then '{{"type":"response.incomplete"}}' when k = 2 then 'event: response.completed' else concat(' ', i) end"""
    whole = """case when i = 36 and k < 2 and n <= 6 then concat(chunk, '\\nevent: response.failed', chunk) else chunk end"""
    rows = numbers(spark, d).withColumn("n", n).withColumn("chunk", F.expr(chunk))
    return P.marker_seen(rows.select(F.col("doc").alias("stream"), "pos", F.expr(whole).alias("chunk")), P.terminal_markers())


@query("pytest_reports", f"with {E} select doc, 't::' || pos as test_id, case when k = 1 then 'failed' else 'passed' end as outcome, ms / 1000.0 as duration from e where k < 2")
def reports(spark, d):
    """2.1.6: both layouts; tests without a call phase have no row."""
    outcome = "if(k = 1, 'failed', 'passed')"
    new = f"""if(k < 2, concat('{{"nodeid": "t::', pos, '", "call": {{"outcome": "', {outcome}, '", "duration": ', ms / 1000, '}}}}'), concat('{{"nodeid": "t::', pos, '"}}'))"""
    old = f"""concat('{{"nodeid": "t::', pos, '", "when": "', if(k < 2, 'call', 'setup'), '", "outcome": "', {outcome}, '", "duration": ', ms / 1000, '}}')"""
    docs = text_of(numbers(spark, d), f"if(doc % 2 = 0, {new}, {old})", glue=", ")
    return readers.pytest_report(docs.select("doc", F.expr("if(doc % 2 = 0, concat('{\"created\": 1.0, \"tests\": [', text, ']}'), concat('[', text, ']'))").alias("text")))


@query("pipeline_rewards", f"with {E} select pos as doc, s.n as stage, case when k < 3 and (s.n = 1 or s.n = 2 and k = 1 or s.n = 3 and k = 2) then (ms + s.n) / 2000.0 end as pass_rate from e, (values (1), (2), (3)) as s(n)")
def rewards(spark, d):
    """2.1.15: both layouts, and results that are no JSON."""
    stage = lambda n, name: f"""concat('"{name}": {{"pass_rate": ', (ms + {n}) / 2000, '}}')"""
    text = f"""case k when 0 then concat('{{"stages": {{', {stage(1, "stage1_draft")}, '}}}}') when 1 then concat('{{', {stage(1, "stage1")}, ', ', {stage(2, "stage2")}, '}}') when 2 then concat('{{', {stage(1, "stage1")}, ', ', {stage(3, "stage3")}, '}}') else '{{broken' end"""
    out = readers.pipeline_rewards(numbers(spark, d).select(F.col("pos").alias("doc"), F.expr(text).alias("text")))
    return out.withColumn("stage", F.col("stage").cast("long"))


@query("run_modules", f"with {E} select 'r' || doc as run, 'stage' || (p + 1) || '_x' as stage, 'm' || i as module, bool_or(k = 0) as done, bool_or(k = 1) as needs_retry, bool_or(k = 2) as has_output from e where k < 3 and i <> 5 group by doc, p, i")
def run_modules(spark, d):
    """2.1.9: folders of evaluations and other files do not count."""
    name = "element_at(array('.done', '.needs_retry', 'output.json', 'other.txt'), cast(k + 1 as int))"
    path = f"concat('/x/r', doc, '/stage', p + 1, if(i = 5, '_eval', '_x'), if(ms % 2 = 0, '/deep', ''), '/m', i, '/', {name})"
    return readers.run_modules(numbers(spark, d).select(F.expr(path).alias("path")))


@query("markdown_report", "select '| ' || r_regionkey || ' | ' || r_name || ' |' as value from region")
def markdown_report(spark, d):
    """2.2.4."""
    return writers.markdown_table(read(spark, d, "region"), ["r_regionkey", "r_name"])


@query("toml_lines", """with t as (select doc_id as task, source || ' "' || coalesce(lang, '') || '"' as a, case when doc_id % 3 > 0 then 'l1' || chr(10) || text || chr(9) || '\\' end as b from documents)
select task, 'a = "' || replace(a, '"', '\\"') || '"' as value from t union all select task, 'b = "' || replace(replace(replace(replace(replace(b, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '"' from t where b is not null""")
def toml(spark, d):
    """2.2.6: strings are escaped, nulls left out."""
    a = F.concat("source", F.lit(' "'), F.coalesce("lang", F.lit("")), F.lit('"'))
    b = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("l1\n"), "text", F.lit("\t\\")))
    return writers.toml_lines(read(spark, d, "documents").select(F.col("doc_id").alias("task"), a.alias("a"), b.alias("b")))


@query("split_constants", """select c_mktsegment as split, upper(c_mktsegment) || ' = [' || string_agg(distinct '"n' || (c_custkey % 7) || '"', ', ' order by '"n' || (c_custkey % 7) || '"') || ']' as line from customer group by c_mktsegment""")
def constants(spark, d):
    """2.2.6."""
    return writers.split_constants(read(spark, d, "customer").select(F.col("c_mktsegment").alias("split"), F.concat(F.lit("n"), (F.col("c_custkey") % 7).cast("string")).alias("name")))


@query("flattened_entries", """select case when c_custkey % 3 > 0 then 'i' || c_custkey else sha256(c_name || '/' || 'c' || c_nationkey) end as instance_id, '{"a":"' || c_mktsegment || '"}' as setup, case when c_custkey % 2 = 0 then '{}' else '{"c":"' || c_custkey || '"}' end as test from customer""")
def flattened(spark, d):
    """2.2.5: a missing id comes from the content, so that a retry gives the same."""
    rows = read(spark, d, "customer").select(
        F.expr("if(c_custkey % 3 > 0, concat('i', c_custkey), null)").alias("instance_id"), F.col("c_name").alias("repo"), F.expr("concat('c', c_nationkey)").alias("base_commit"),
        F.create_map(F.lit("a"), "c_mktsegment").alias("setup"), F.expr("if(c_custkey % 2 = 0, map(), map('c', cast(c_custkey as string)))").cast("map<string,string>").alias("test"),
    )
    return writers.flattened(rows).select("instance_id", "setup", "test")
