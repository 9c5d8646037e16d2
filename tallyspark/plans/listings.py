"""Listings of test binaries and runners, manifests, markers, imports and request bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import manifests as D
from tallyspark.functions import messages as M
from tallyspark.functions import text as X
from tallyspark.operators import dedup
from tallyspark.operators import listings as L
from tallyspark.plans.registry import query, read
from tallyspark.plans.rendered import E, numbers, text_of
from tallyspark.shipping import ship

N = "n as (select *, row_number() over (partition by doc order by pos) - 1 as line from e)"


@query("doctest_list", f"with {E}, {N} select doc, line as pos, 'case ' || i || ': ' || pos as test_id from n where k = 0")
def doctest_list(spark, d):
    """2.9.13."""
    line = "case k when 0 then concat('  case ', i, ': ', pos, ' ') when 1 then '[doctest] listing all test case names' when 2 then '=======' else element_at(array('', '----', 'test cases: 3'), cast(p + 1 as int)) end"
    return L.doctest_list(text_of(numbers(spark, d), line))


@query("catch2_list", f"with {E}, {N} select doc, line as pos, 'does ' || i || ' of ' || pos as test_id from n where k = 0")
def catch2_list(spark, d):
    """2.9.13: tags and counts are no tests."""
    line = "case k when 0 then concat('  does ', i, ' of ', pos) when 1 then '      [tag][other]' when 2 then 'All available test cases:' else element_at(array('3 test cases: all', 'Matching tests', '====='), cast(p + 1 as int)) end"
    return L.catch2_list(text_of(numbers(spark, d), line))


@query("boost_list", f"""with {E}, {N}, s as (select *, last_value(case when k = 0 then 'top' || i end ignore nulls) over w as top, max(case when k = 0 or k = 1 and p = 0 then line end) over w as at0, max(case when k = 1 and p > 0 then line end) over w as at1, last_value(case when k = 1 and p > 0 then 'sub' || i end ignore nulls) over w as sub
  from n window w as (partition by doc order by line rows unbounded preceding))
select doc, line + 1 as pos, concat_ws('/', coalesce(top, 'all'), case when at1 > coalesce(at0, -1) then sub end, 't' || pos) as test_id from s where k = 2
union all select doc, line + 1, concat_ws('/', coalesce(top, 'all'), 't' || pos) from s where k = 1 and p = 0""")
def boost_list(spark, d):
    """2.9.13: suites nest by indentation."""
    top = "concat('top', i, if(p = 0, '', ' '))"
    line = f"case when k = 0 then {top} when k = 1 and p > 0 then concat('    sub', i) when k = 1 then concat('    t', pos, '*') when k = 2 then concat('        t', pos, '* ') else ' ' end"
    return L.boost_list(text_of(numbers(spark, d), line).select("doc", F.concat(F.lit("all\n"), "text").alias("text")))


@query("jest_list", f"""with {E}, {N} select doc, line as pos, 'src/a' || i || case k when 0 then '.test.ts' when 1 then '.js' else ' b.spec.jsx' end as test_id from n where doc % 2 = 1 and k < 3
union all select doc, line, 'src/a' || i || '.test.ts' from n where doc % 2 = 0""")
def jest_list(spark, d):
    """2.9.12: lines of every other document, a JSON array of the rest."""
    line = "element_at(array(concat('/w/src/a', i, '.test.ts'), concat(' /w/src/a', i, '.js'), concat('/w/src/a', i, ' b.spec.jsx'), 'Determining test suites to run...'), cast(k + 1 as int))"
    rows = numbers(spark, d)
    array = text_of(rows.filter("doc % 2 = 0"), "concat('\"/w/src/a', i, '.test.ts\"')", glue=", ").select("doc", F.concat(F.lit("\n["), "text", F.lit("]")).alias("text"))
    return L.jest_list(text_of(rows.filter("doc % 2 = 1"), line).unionByName(array), "/w")


@query("vitest_list", f"with {E}, {N} select doc, line as pos, 'src/a' || i || '.ts > s > t' || pos as test_id from n where k < 3")
def vitest_list(spark, d):
    """2.9.12: entries without a name or a file are none."""
    entry = """concat('{"name": "', if(k = 3, '', concat('s > t', pos)), '", "file": "/w/src/a', i, '.ts", "x": [1]}')"""
    texts = text_of(numbers(spark, d), entry, glue=",").select("doc", F.concat(F.lit("\x1b[32m> list\x1b[0m\n["), "text", F.lit("]\ndone")).alias("text"))
    return L.vitest_list(texts, "/w")


@query("ctest_list", f"with {E}, {N} select doc, line as pos, 'T.' || i || '/' || pos as test_id from n where k > 0")
def ctest_list(spark, d):
    """2.9.12."""
    entry = """concat('{"name": "', if(k = 0, '', concat('T.', i, '/', pos)), '", "command": ["x", "', k, '"]}')"""
    return L.ctest_list(text_of(numbers(spark, d), entry, glue=",").select("doc", F.concat(F.lit('{"kind": "ctestInfo", "tests": ['), "text", F.lit("]}")).alias("text")))


@query("chat_round_trip", """with s as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn) filter (where text <> '') as text from conversations where role = 'system' group by conv_id),
o as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as n, role, text from conversations where role <> 'system')
select o.conv_id, o.n + case when s.text is null then 0 else 1 end as pos, o.role, o.text from o left join s using (conv_id) union all select conv_id, 0, 'system', text from s where text is not null""")
def chat_round_trip(spark, d):
    """2.10.14: conversations as chat requests, as response requests and as messages again."""
    rows = read(spark, d, "conversations")
    # a long text is sent in parts
    half = F.floor(F.length("text") / 2).cast("int")
    part = lambda a: F.struct(F.lit("text").alias("type"), a.alias("text"))
    parts = F.to_json(F.array(part(F.substring("text", F.lit(1), half)), part(F.substring("text", half + 1, F.length("text")))))
    content = F.when(F.col("turn") % 2 == 0, F.to_json(F.array("text"))).otherwise(F.concat(F.lit("["), parts, F.lit("]")))
    message = F.concat(F.lit('{"role": "'), "role", F.lit('", "content": '), F.expr("x"), F.lit("}"))
    rows = rows.withColumn("x", content).withColumn("x", F.substring("x", F.lit(2), F.length("x") - 2)).select("conv_id", "turn", message.alias("m"))
    asked = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("a"))
    chat = F.concat(F.lit('{"model": "m", "max_tokens": 9, "messages": ['), F.array_join(F.transform("a", lambda x: x["m"]), ", "), F.lit("]}"))
    back = asked.select("conv_id", F.posexplode(M.responses_to_messages(M.chat_to_responses(chat))).alias("pos", "m"))
    return back.select("conv_id", "pos", "m.role", "m.text")


MANIFEST_SQL = "spec as (select doc, pos, k, 'Pkg_' || i || '>=' || p || case when ms % 4 = 0 then '; python_version < \"3.' || (8 + i % 5) || '\"' else '' end as spec, 'pkg-' || i as name, ms % 4 > 0 or 10 < 8 + i % 5 as applies from e)"


@query("merged_dependencies", f"""with {E}, {MANIFEST_SQL}, f as (select *, case when k = 0 then 0 when k = 1 then 1 when k = 2 then 2 else 3 end as file, case when k in (0, 2) then 'runtime' else 'test' end as kind from spec)
select doc as project, kind, name, arg_min(spec, file * 100000000 + pos) as spec, arg_min(applies, file * 100000000 + pos) as applies from f group by doc, kind, name""")
def merged_dependencies(spark, d):
    """2.10.20, 2.10.24: of several manifests the first requirement of each name, and whether it applies to Python 3.10."""
    ship(spark)
    rows = numbers(spark, d)
    spec = "concat('Pkg_', i, '>=', p, if(ms % 4 = 0, concat('; python_version < \"3.', 8 + i % 5, '\"'), ''))"
    quoted = "concat(\"  '\", " + spec + ', "\'")'
    kinds = [
        (0, "a/pyproject.toml", quoted, ",\n", "[project]\nname = 'x'\ndependencies = [\n", "\n]\n"),
        (1, "a/setup.cfg", f"concat('  ', {spec})", "\n", "[options.extras_require]\ntest =\n", "\n"),
        (2, "a/setup.py", quoted, ",\n", "setup(name='x', install_requires=[\n", "\n])\n"),
        (3, "a/requirements-dev.txt", spec, "\n", "# tests\n-r requirements.txt\n\n", "\n"),
    ]
    files = None
    for n, path, line, glue, head, tail in kinds:
        one = text_of(rows.filter(F.col("k") == n), line, glue=glue).select("doc", F.lit(n).alias("file"), F.lit(path).alias("path"), F.concat(F.lit(head), "text", F.lit(tail)).alias("text"))
        files = one if files is None else files.unionByName(one)
    found = files.select("doc", "file", F.posexplode(D.manifest_dependencies(F.col("path"), F.col("text"))).alias("pos", "x"))
    named = found.select("doc", F.struct("file", "pos").alias("at"), "x.kind", "x.spec").withColumn("name", X.package_name(F.col("spec")))
    first = dedup.keep_first(named, ["doc", "kind", "name"], "at")
    return first.select(F.col("doc").alias("project"), "kind", "name", "spec", D.marker_applies(F.col("spec"), F.lit("3.10")).alias("applies"))


@query("required_imports", f"""with {E} select doc, 'm' || i as module, bool_or(k = 0 or k = 2) as required from e where k < 3 group by doc, i""")
def required_imports(spark, d):
    """2.10.16: imports that a try excuses are optional."""
    ship(spark)
    code = """case k when 0 then concat('def f', pos, '():\\n    from m', i, '.a import b as c') when 1 then concat('try:\\n    import m', i, '.x\\nexcept (ValueError, ImportError):\\n    pass') when 2 then concat('try:\\n    pass\\nexcept ImportError:\\n    import m', i)
      else concat('from . import z', i, '\\ns = "import y"') end"""
    return text_of(numbers(spark, d), code).select("doc", F.explode(D.source_imports(F.col("text"))).alias("x")).select("doc", "x.module", "x.required")
