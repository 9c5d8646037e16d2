"""Filter, validation, URL, page, diff and lint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import filters as P
from tallyspark.plans.registry import query, read
from tallyspark.plans.rendered import E, numbers, text_of
from tallyspark.sources import readers

@query("entry_issues", """with c as (select c_custkey as k, c_custkey % 2 = 0 as no_setup, c_custkey % 3 = 0 as no_test, c_custkey % 5 = 0 as bad_base, c_custkey % 7 = 0 as bad_version, c_custkey % 11 = 0 as no_version from customer)
select k, concat_ws(',', case when no_setup then 'missing setup' end, case when no_test then 'missing test' end, case when bad_base then 'bad base_commit' end, case when bad_version and not no_version then 'unknown version' end) as issues, not (no_setup or no_test or bad_base or bad_version and not no_version) as valid from c""")
def entries(spark, d):
    """2.3.1, 2.8.3."""
    k = F.col("c_custkey")
    pair = lambda key, value, there: F.when(there, F.struct(F.lit(key).alias("key"), value.alias("value")))
    always = F.lit(True)
    items = [pair(key, F.lit("x"), k % 2 > 0 if key == "setup" else k % 3 > 0 if key == "test" else always) for key in P.REQUIRED if not key.endswith("commit")]
    items += [pair("base_commit", F.when(k % 5 == 0, "xyz").otherwise(F.substring(F.sha1(k.cast("string")), 1, 12)), always), pair("reference_commit", F.sha1("c_name"), always)]
    items += [pair("version", F.when(k % 7 == 0, "2.7").otherwise("3.12"), k % 11 > 0)]
    rows = read(spark, d, "customer").select(k.alias("k"), F.map_from_entries(F.array_compact(F.array(*items))).alias("e"))
    issues = P.entry_issues(F.col("e"), ["3.10", "3.11", "3.12"])
    return rows.select("k", F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("valid"))


@query("customer_issues", r"select c_custkey, array_to_string(list_filter([case when c_acctbal < 0 then 'negative balance' end, case when not regexp_matches(c_name, '^Customer#\d{9}$') then 'bad name' end, case when c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') then 'segment' end], lambda x: x is not null), ',') as issues from customer")
def customers(spark, d):
    """2.3.1 over a whole table: the same issue arrays."""
    issues = P.issues({"negative balance": F.col("c_acctbal") < 0, "bad name": ~F.col("c_name").rlike(r"^Customer#\d{9}$"), "segment": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")})
    return read(spark, d, "customer").select("c_custkey", F.array_join(issues, ",").alias("issues"))


@query("valid_names", "select c_custkey, case c_custkey % 6 when 0 then 'own/r' || c_custkey when 1 then 'own/r/' || c_custkey when 2 then 'own r/' || c_custkey when 3 then null when 4 then 'O.b_c/d-' || c_custkey else c_mktsegment end as name, c_custkey % 6 in (0, 4) as ok from customer")
def names(spark, d):
    """2.3.2."""
    name = "element_at(array(concat('own/r', c_custkey), concat('own/r/', c_custkey), concat('own r/', c_custkey), null, concat('O.b_c/d-', c_custkey), c_mktsegment), cast(c_custkey % 6 + 1 as int))"
    return read(spark, d, "customer").select("c_custkey", F.expr(name).alias("name")).select("c_custkey", "name", P.valid_name(F.col("name")).alias("ok"))


@query("unblocked", "select s_suppkey as full_name from supplier where s_suppkey % 7 > 0 and s_acctbal > 0 and s_nationkey not in (3, 4) and s_suppkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def unblocked(spark, d):
    """2.3.3."""
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("full_name"), (F.col("s_suppkey") % 7 == 0).alias("fork"), (F.col("s_acctbal") <= 0).alias("archived"), F.col("s_nationkey").isin(3, 4).alias("disabled"))
    return P.unblocked(rows, read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("full_name"))).select("full_name")


@query("enriched", "select p_partkey, round(100.0 * p_size / (p_size + 20), 1) as pct, (p_brand = 'Brand#1' or p_type = 'ECONOMY') as has_docs from part where round(100.0 * p_size / (p_size + 20), 1) >= 50")
def enriched(spark, d):
    """2.3.4."""
    rows = read(spark, d, "part").select("p_partkey", F.create_map(F.lit("Python"), F.col("p_size").cast("long"), F.lit("C"), F.lit(20).cast("long")).alias("languages"), F.when(F.col("p_brand") == "Brand#1", "http://x").otherwise("").alias("homepage"), F.array(F.lower("p_type")).alias("topics"))
    return P.enriched(rows, "Python", 50.0, ["economy"]).select("p_partkey", "pct", "has_docs")


@query("candidate_score", """select p_partkey, round(least(p_retailprice * 20 / 1000, 30.0) + case when p_size < 10 then 10 when p_size < 30 then 5 else -5 end + case when p_partkey % 4 in (0, 1) then 8 when p_partkey % 4 = 2 then 2 else -10 end
+ 3 * (case when p_size % 2 = 0 then 1 else 0 end + case when p_size % 3 = 0 then 1 else 0 end) + case when contains(p_name, 'widget') then 3 else 0 end - case when contains(p_name, 'ring') then 8 else 0 end, 4) as score from part""")
def score(spark, d):
    """2.3.5: 5,000 and 30,000 kB, free licences, topics and words of libraries and of systems."""
    topics = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, F.lit("header-only")), F.when(F.col("p_size") % 3 == 0, F.lit("yaml")), F.lit("games")))
    words = F.concat_ws(" ", F.when(F.contains("p_name", F.lit("widget")), F.lit("A TOML thing")), F.when(F.contains("p_name", F.lit("ring")), F.lit("a Kernel")))
    licence = F.element_at(F.array(F.lit("mit"), F.lit("BSD-2-Clause"), F.lit("GPL-3.0"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", P.candidate_score(F.col("p_retailprice") * 20, F.when(F.col("p_size") < 10, 4999).when(F.col("p_size") < 30, 5000).otherwise(30_000), licence, topics, words).alias("score"))


@query("candidate_flags", "select p_partkey, p_partkey % 5 > 0 and p_size * 4 >= 50 as has_tests, p_partkey % 4 < 2 as has_build_system, p_partkey % 6 in (1, 2, 3) as compatible_jdk, p_partkey % 3 = 0 as has_license, true as is_active from part")
def flags(spark, d):
    """2.3.6."""
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values) + 1).cast("int"))
    tests, build = F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") * 4), pick("maven", "gradle", "ant", None)
    found = P.candidate_flags(tests, build, pick("8", "11", "17", "21", "22", None), pick("MIT", "", None))
    return read(spark, d, "part").select("p_partkey", *[flag.alias(name) for name, flag in found.items()])


@query("url_facts", r"select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path, contains(url, '#') as fragment, not (contains(url, '#') or regexp_matches(url, '^[a-z]+://[^?#]*/(login|signin|signup|logout|auth|account)(/|$|\?|#)') or regexp_matches(url, '[?&](next|redirect|return_to|continue)=')) as takes from pages")
def urls(spark, d):
    """2.3.7."""
    return read(spark, d, "pages").select("page_id", *[v.alias(k) for k, v in P.url_facts(F.col("url")).items()])


@query("page_flags", r"""select page_id, page_id % 8 in (0, 1, 2, 3) as soft_404, page_id % 8 = 4 as captcha, page_id % 8 = 5 as challenge, page_id % 8 = 6 as blank from pages""")
def page_flags(spark, d):
    """2.3.8: whole pages with one sign each: title, heading, phrase, first line; captcha, challenge, blank; none."""
    pages = read(spark, d, "pages")
    k = F.col("page_id") % 8
    html = F.concat(F.when(k == 0, "<title>Page  Not Found | x</title>").when(k == 1, "<h1 class='a'> 404 </h1>").when(k == 5, "<script src='/cdn-cgi/challenge-platform/x'></script>").when(k == 7, "<h1>404 ways</h1><title>Not found in time</title>").otherwise(""), F.when(k != 6, F.col("html")).otherwise(""))
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    text = F.when(k == 2, " We Couldn't find the page ").when(k == 3, "\n404 Not Found!\nGo home").when(k == 4, F.concat(plain, F.lit(" please verify you are a HUMAN"))).when(k == 6, " \n\t ").when(k == 7, F.concat(F.lit("404 ways\n"), plain)).otherwise(F.concat(F.lit("x "), plain))
    rows = pages.select("page_id", html.alias("html"), text.alias("t"))
    return rows.select("page_id", *[v.alias(n) for n, v in P.page_flags(F.col("html"), F.col("t")).items()])


#: Paths of a patch by shape, why it may not touch them, and the forms of a patch's head.
SHAPES = [
    ("src/m", ".rs", None), ("tests/t", ".rs", "file under a test directory (%s)"), ("pkg/test_", ".py", "test file (%b)"), ("cfg/jest.config.", "", "scoring/build/config file (%b)"),
    ("src/androidTest/A", ".kt", "file under a test source root (%s)"), ("lib/Foo", "Test.java", "test file (%b)"), ("target/b", ".rs", None), ("docs/x", ".md", None),
]
SHAPE_SQL = "case p_partkey % 8 " + " ".join(f"when {k} then '{a}' || p_partkey || '{b}'" for k, (a, b, _) in enumerate(SHAPES)) + " end"
REASON_SQL = "case p_partkey % 8 " + " ".join(f"when {k} then " + ("null" if r is None else f"'{r.split('%')[0]}' || " + ("path" if "%s" in r else "lower(string_split(path, '/')[-1])") + " || ')'") for k, (_, _, r) in enumerate(SHAPES)) + " end"
SHAPE = "concat(element_at(array({}), cast(p_partkey % 8 + 1 as int)), p_partkey, element_at(array({}), cast(p_partkey % 8 + 1 as int)))".format(*[", ".join(f"'{x[k]}'" for x in SHAPES) for k in (0, 1)])
SECTION = r"""case p_partkey div 8 % 5
  when 0 then concat('diff --git a/', path, ' b/', path, '\n--- a/', path, '\n+++ b/', path, '\n@@ -1 +1 @@\n+x')
  when 1 then concat('diff --git a/', path, ' b/', path, '\n--- a/', path, '\n+++ /dev/null')
  when 2 then concat('diff --git a/', path, ' b/moved', p_partkey, '.txt\nrename from a')
  when 3 then concat('--- ', path, '\t2024-01-01\n+++ ', path, '\t2024-01-02\n@@ -1 +1 @@')
  else concat('diff --git "a/', path, '" "b/', path, '"\n--- /dev/null\n+++ "b/', path, '"') end"""


def _paths(spark, d):
    return read(spark, d, "part").withColumn("path", F.expr(SHAPE))


@query("patched_paths", f"""with t as (select p_partkey, {SHAPE_SQL} as path from part) select p_partkey, path, {REASON_SQL} as reason from t union all select p_partkey, 'moved' || p_partkey || '.txt', null from t where p_partkey // 8 % 5 = 2""")
def paths(spark, d):
    """2.3.9, 2.3.18: changed, deleted, renamed, timed and quoted heads; the gate's reason for each path."""
    rows = _paths(spark, d).select("p_partkey", F.explode(P.patched_paths(F.expr(SECTION))).alias("path"))
    return rows.select("p_partkey", "path", P.cheat_reason(F.col("path")).alias("reason"))


@query("kept_sections", "select p_brand as k, count(*) filter (where p_partkey % 8 in (0, 1) and p_partkey // 8 % 5 < 3) as n, n = 0 as nothing from part group by p_brand")
def sections(spark, d):
    """2.3.10: sections of Rust files outside of build folders; quoted heads and lines before any head are no such sections."""
    rows = _paths(spark, d).select("p_brand", F.col("p_partkey").alias("pos"), F.expr(SECTION).alias("section"))
    kept = text_of(rows, F.col("section"), by="p_brand").select(F.col("p_brand").alias("k"), P.kept_sections(F.col("text"), ".rs").alias("p"))
    return kept.select("k", F.regexp_count("p", F.lit("diff --git")).cast("long").alias("n"), (F.col("p") == "\n\n").alias("nothing"))


@query("lint_kinds", f"with {E} select pos, case k when 0 then 'ENV' when 3 then 'UNKNOWN' else 'CODE' end as kind from e")
def lint(spark, d):
    """2.3.11."""
    line = "element_at(array(concat('a.py:', i, ': error: Import \"numpy', i, '\"  [reportMissingImports]'), concat('a.py:', i, ': Import \"mypkg', if(p = 0, '', '.sub'), '\" could not be resolved [reportMissingImports]'), 'a.py:3: bad type [reportGeneralTypeIssues]', concat(i, ' errors')), cast(k + 1 as int))"
    return numbers(spark, d).select("pos", P.lint_kind(F.expr(line), "mypkg").alias("kind"))


PREDICATES = [{"id": "p1", "kind": "pattern_present", "target": r"\bthe\b"}, {"id": "p2", "kind": "literal_absent", "target": "AKIA"}, {"id": "p3", "kind": "pattern_absent", "target": "[0-9]{3}"}, {"id": "p4", "kind": "pattern_present", "target": "(unclosed"}, {"id": "p5", "kind": "no_such_kind", "target": "x"}]


@query("predicates", r"select doc_id as code_id, 'p1' as predicate, regexp_matches(text, '\bthe\b') as passed from documents union all select doc_id, 'p2', not contains(text, 'AKIA') from documents union all select doc_id, 'p3', not regexp_matches(text, '[0-9]{3}') from documents union all select doc_id, 'p4', true from documents union all select doc_id, 'p5', true from documents")
def predicates(spark, d):
    """2.3.12, 2.12.3: broken patterns and unknown kinds pass."""
    return P.evaluate_predicates(read(spark, d, "documents").select(F.col("doc_id").alias("code_id"), F.col("text").alias("code")), PREDICATES)


@query("vacuous_predicates", r"select doc_id, 'p1' as id from documents where not regexp_matches(text, '\bthe\b') union all select doc_id, 'p2' from documents where contains(text, 'AKIA') union all select doc_id, 'p3' from documents where regexp_matches(text, '[0-9]{3}')")
def vacuous(spark, d):
    """2.3.13: each document as a counter-example; predicates that it passes are vacuous, broken ones always."""
    code = read(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("code_id"), F.col("text").alias("code"))
    return P.evaluate_predicates(code, PREDICATES).filter("not passed").select(F.col("code_id").alias("doc_id"), F.col("predicate").alias("id"))


@query("resolve_split", """with r as (select p_partkey as pos, 'i' || p_partkey as i, p_brand || '/' || replace(p_name, ' ', '-') as repo, 'orig/' || p_partkey as o, replace(p_name, ' ', '-') as b from part)
select split, b as basename, min(pos) as pos from r join (values ('all'), ('all_x'), ('lite'), ('i7'), ('Brand#2/red-widget'), ('red_widget'), ('orig/9'), ('none')) as s(split) on split like 'all%' or split = 'lite' and b in ('small-ring', 'blue-bolt') or split in (i, repo, o, b) or split = 'red_widget' and b = 'red-widget' group by split, b""")
def splits(spark, d):
    """2.3.14."""
    dash = F.replace("p_name", F.lit(" "), F.lit("-"))
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.expr("concat('i', p_partkey)").alias("instance_id"), F.concat_ws("/", "p_brand", dash).alias("repo"), F.expr("concat('orig/', p_partkey)").alias("original_repo"))
    out = None
    for name in ("all", "all_x", "lite", "i7", "Brand#2/red-widget", "red_widget", "orig/9", "none"):
        part = P.resolve_split(name, rows, {"lite": ["small-ring", "blue-bolt"]}).select(F.lit(name).alias("split"), "basename", "pos")
        out = part if out is None else out.unionByName(part)
    return out


@query("pin_status", """with v as (select 'k' || l_partkey as package, max(l_linenumber) as top, bool_or(l_linenumber = l_suppkey % 7 and l_quantity > 45) as gone from lineitem group by l_partkey), f as (select distinct 'k' || l_partkey as package, '1.' || l_linenumber as version from lineitem)
select 'k' || p_partkey as package, case when v.gone then 'dropped' when v.package is null or p_partkey % 9 = 0 then 'kept' when exists (select 1 from f where f.package = v.package and f.version = '1.' || (p_size % 7 + 1)) then 'kept' else 'warned' end as status from part left join v on v.package = 'k' || p_partkey""")
def pins(spark, d):
    """2.3.15."""
    pins = read(spark, d, "part").select(F.expr("concat('k', p_partkey)").alias("package"), F.expr("if(p_partkey % 9 = 0, null, concat('1.', p_size % 7 + 1))").alias("pin"))
    versions = read(spark, d, "lineitem").select(F.expr("concat('k', l_partkey)").alias("package"), F.expr("concat('1.', l_linenumber)").alias("version"), F.expr("l_linenumber = l_suppkey % 7 and l_quantity > 45").alias("gone"))
    return P.pin_status(pins, versions)


PATHS = [("src/a%.py", False, True), ("tests/test_a%.py", True, False), ("src/x%_test.go", True, False), ("docs/conf%.py", False, False), ("p%/setup.py", False, False), ("pkg/spec/a%.js", True, False), ("pkg/a%.test.ts", True, False), ("p%/conftest.py", True, False), ("pkg/mod/core%.py", False, True)]


@query("source_paths", "select p_partkey, replace(path, '%', p_partkey::varchar) as path, is_test, is_source from part join (values " + ", ".join(f"({k}, '{p}', {t}, {c})" for k, (p, t, c) in enumerate(PATHS)) + ") as t(k, path, is_test, is_source) on p_partkey % 9 = k")
def source_paths(spark, d):
    """2.3.16."""
    path = F.replace(F.element_at(F.array(*[F.lit(p) for p, *_ in PATHS]), (F.col("p_partkey") % 9 + 1).cast("int")), F.lit("%"), F.col("p_partkey").cast("string"))
    return read(spark, d, "part").select("p_partkey", path.alias("path")).select("p_partkey", "path", P.is_test_path(F.col("path")).alias("is_test"), P.is_source_path(F.col("path"), ".py").alias("is_source"))


@query("command_issues", "select o_orderkey as k, concat_ws(',', case when o_orderkey % 5 = 2 then 'empty' end, case when o_orderkey % 3 = 1 and o_orderkey % 5 <> 2 then 'sudo' end, case when o_orderkey % 5 in (2, 4) then 'no runner' end, case when o_orderkey % 7 = 3 and o_orderkey % 5 <> 2 then 'dangling operator' end) as issues from orders")
def commands(spark, d):
    """2.3.17."""
    base = "element_at(array('ctest --output-on-failure', 'make check', ' ', 'cargo test --all', 'echo '), cast(o_orderkey % 5 + 1 as int))"
    command = f"if(o_orderkey % 5 = 2, {base}, concat(if(o_orderkey % 3 = 1, 'sudo ', ''), {base}, if(o_orderkey % 7 = 3, ' &&', '')))"
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(P.command_issues(F.expr(command)), ",").alias("issues"))


@query("upload_decisions", "select c_custkey, (c_mktsegment = 'BUILDING') or (c_custkey % 2 = 0) as uploads from customer")
def uploads(spark, d):
    """2.3.19."""
    return read(spark, d, "customer").select("c_custkey", P.upload_decision(F.when(F.col("c_mktsegment") == "BUILDING", "ok").otherwise("failed"), F.col("c_custkey") % 2 == 0).alias("uploads"))


@query("repo_urls", "select c_name as library, case c_custkey % 5 when 0 then 'https' else 'http' end || '://github.com/own' || c_nationkey || '/r' || c_custkey || case c_custkey % 5 when 1 then '.git' else '' end as url, 'own' || c_nationkey as owner, 'r' || c_custkey as repo from customer where c_custkey % 5 in (0, 1)")
def repo_urls(spark, d):
    """2.1.12: other hosts, schemes and shorter paths are dropped."""
    tail = "concat('own', c_nationkey, '/r', c_custkey)"
    url = f"element_at(array(concat('https://github.com/', {tail}), concat('http://github.com/', {tail}, '.git'), concat('https://example.com/', {tail}), concat('ftp://github.com/', {tail}), concat('https://github.com/own', c_nationkey)), cast(c_custkey % 5 + 1 as int))"
    return readers.repo_urls(read(spark, d, "customer").select(F.col("c_name").alias("library"), F.expr(url).alias("url")))


@query("star_ranges", "select case when p_retailprice < 500 then '0..499' when p_retailprice < 1000 then '500..999' when p_retailprice < 5000 then '1000..4999' else '5000..' end as range, count(*) as n from part group by 1")
def star_ranges(spark, d):
    """2.1.14: the partition of a paged search."""
    return read(spark, d, "part").groupBy(readers.star_range(F.col("p_retailprice")).alias("range")).agg(F.count("*").alias("n"))
