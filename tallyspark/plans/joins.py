"""Join queries over orders, events, documents and small inline tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import joins as J
from tallyspark.plans.registry import query, read


@query("missing_inventory", "select o_orderkey as repo from orders where o_orderkey not in (select l_orderkey from lineitem)")
def missing_inventory(spark, d):
    """2.4.4: orders without line items."""
    return J.missing_inventory(read(spark, d, "orders").select(F.col("o_orderkey").alias("repo")), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("repo")))


@query("stale_inventory", """with p as (select doc_id, sha256(case when doc_id % 7 = 0 then text || 'x' else text end) as sha, case when doc_id % 5 = 0 then 'old' else 'c' || doc_id end as c from documents where doc_id % 11 > 0)
select d.doc_id as repo, case when d.text is null or sha256(d.text) <> p.sha then 'corrupt' when p.c <> 'c' || d.doc_id then 'drifted' when p.sha is null and p.c is null then 'no_provenance' end as reason
from documents d left join p using (doc_id) where reason is not null""")
def stale_inventory(spark, d):
    """2.4.5."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("repo"), F.col("text").alias("content"))
    commit = F.concat(F.lit("c"), F.col("repo").cast("string"))
    changed = F.when(F.col("repo") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    provenance = docs.filter("repo % 11 > 0").select("repo", F.sha2(changed, 256).alias("sha256"), F.when(F.col("repo") % 5 == 0, "old").otherwise(commit).alias("commit"))
    return J.stale_inventory(docs, provenance, docs.select("repo", commit.alias("reference_commit")))


def _actions(spark, d):
    return read(spark, d, "events").filter("event_type in ('click', 'view')").select(F.col("user_id").alias("module"), (F.col("event_id") % 50).alias("call_id"), F.col("event_type").alias("tool"), F.col("event_id").alias("pos"))


def _observations(spark, d):
    e = read(spark, d, "events").filter("event_type in ('error', 'purchase')")
    return e.select(F.col("user_id").alias("module"), F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 50).alias("action_id"), F.when(F.col("event_type") == "error", "click").otherwise("").alias("tool"), F.col("event_id").alias("pos"))


ACT = "act as (select user_id as module, event_id % 50 as call_id, event_type as tool, event_id as pos from events where event_type in ('click', 'view'))"
OBS = "obs as (select user_id as module, case when event_id % 9 > 0 then event_id % 50 end as action_id, case when event_type = 'error' then 'click' else '' end as tool, event_id as pos from events where event_type in ('error', 'purchase'))"


@query("orphan_observations", f"with {ACT}, {OBS} select module, action_id, pos from obs where action_id is not null and not exists (select 1 from act where act.module = obs.module and act.call_id = obs.action_id)")
def orphans(spark, d):
    """2.4.6."""
    return J.orphan_observations(_observations(spark, d), _actions(spark, d)).select("module", "action_id", "pos")


@query("mismatched_observations", f"with {ACT}, {OBS}, last as (select module, call_id, arg_max(tool, pos) as t from act group by module, call_id) select obs.module, obs.pos, obs.tool, last.t as action_tool from obs join last on obs.module = last.module and obs.action_id = last.call_id where obs.tool <> '' and last.t <> '' and obs.tool <> last.t")
def mismatched(spark, d):
    """2.4.7."""
    return J.mismatched_observations(_observations(spark, d), _actions(spark, d)).select("module", "pos", "tool", "action_tool")


@query("hallucinated_actions", "select user_id as module, event_type as tool, event_id as pos from events where event_type not in ('signup') and not (user_id % 2 = 0 and event_type in ('click', 'view')) and not (user_id % 3 = 0 and event_type = 'error')")
def hallucinated(spark, d):
    """2.4.8."""
    actions = read(spark, d, "events").select(F.col("user_id").alias("module"), F.col("event_type").alias("tool"), F.col("event_id").alias("pos"))
    users = actions.select("module").distinct()
    declared = users.filter("module % 2 = 0").select("module", F.explode(F.array(F.lit("click"), F.lit("view"))).alias("tool")).unionByName(users.filter("module % 3 = 0").select("module", F.lit("error").alias("tool")))
    return J.hallucinated_actions(actions, declared, spark.createDataFrame([("signup",)], "tool string")).select("module", "tool", "pos")


@query("anchor_verdicts", """with g as (select doc_id as test, quality = 1 as ok from labels where doc_id % 2 = 0), s as (select doc_id as test, toxic = 1 as ok from labels where doc_id % 3 = 0), u as (select doc_id as test, quality = 1 as ok from labels where doc_id % 5 = 0)
select coalesce(g.test, s.test, u.test) as test, g.ok as golden, s.ok as stub, u.ok as solution, case when not coalesce(g.ok, false) then 'wrong_oracle' when coalesce(s.ok, false) then 'non_discriminating' else 'sound' end as verdict
from g full join s on g.test = s.test full join u on coalesce(g.test, s.test) = u.test""")
def anchors(spark, d):
    """2.4.9, 2.8.1."""
    labels = read(spark, d, "labels")
    side = lambda n, c: labels.filter(f"doc_id % {n} = 0").select(F.col("doc_id").alias("test"), (F.col(c) == 1).alias("ok"))
    return J.anchor_verdicts(side(2, "quality"), side(3, "toxic"), side(5, "quality"))


@query("valid_criteria", """select c.doc_id as criterion, case when c.doc_id % 4 = 0 then 'not_anchorable' when g.quality is null or s.toxic is null then 'unknown' when g.quality <> 1 then 'golden_fails' when s.toxic = 1 then 'stub_passes' else 'sound' end as reason, reason in ('not_anchorable', 'unknown', 'sound') as kept
from documents c left join labels g on c.doc_id = g.doc_id left join (select * from labels where doc_id % 3 > 0) s on c.doc_id = s.doc_id""")
def criteria(spark, d):
    """2.4.10."""
    labels = read(spark, d, "labels")
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("criterion"), (F.col("doc_id") % 4 > 0).alias("anchorable"))
    return J.valid_criteria(rows, labels.select(F.col("doc_id").alias("criterion"), (F.col("quality") == 1).alias("ok")), labels.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("criterion"), (F.col("toxic") == 1).alias("ok")))


@query("file_pairs", "select coalesce(a.k, b.k) as key, case when a.k is null then 'status_only' when b.k is null then 'data_only' else 'both' end as state from (select p_partkey as k from part where p_size > 10) a full join (select distinct l_partkey as k from lineitem where l_quantity > 45) b on a.k = b.k")
def file_pairs(spark, d):
    """2.4.11."""
    return J.file_pairs(read(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("key")), read(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("key")).distinct())


@query("nearest_ancestor", """with u as (select p_partkey as unit, 'a' || (p_partkey % 5) as a, 'b' || (p_partkey % 7) as b from part), f as (select distinct 'f' || (s_suppkey % 3) as file, case when s_suppkey % 2 = 0 then 'a' || (s_suppkey % 5) else 'a' || (s_suppkey % 5) || '/b' || (s_suppkey % 7) end as dir from supplier)
select unit, coalesce((select min(file) from f where dir = a || '/b' || (unit % 7)), (select min(file) from f where dir = a)) as file from u""")
def nearest(spark, d):
    """2.4.12, 2.1.10."""
    part = lambda p, n, c: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    units = read(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.concat_ws("/", part("a", 5, "p_partkey"), part("b", 7, "p_partkey"), F.lit("c")).alias("path"))
    deep = F.concat_ws("/", part("a", 5, "s_suppkey"), part("b", 7, "s_suppkey"))
    files = read(spark, d, "supplier").select(part("f", 3, "s_suppkey").alias("file"), F.when(F.col("s_suppkey") % 2 == 0, part("a", 5, "s_suppkey")).otherwise(deep).alias("dir")).distinct()
    return J.nearest_ancestor(units, files)


@query("supported_versions", """with v as (select n_nationkey as project, p_size as version from nation, (select distinct p_size from part)), s as (select s_nationkey as project, s_suppkey % 10 as lo, case when s_suppkey % 3 = 0 then null else s_suppkey % 10 + 6 end as hi from supplier)
select v.project, v.version, coalesce(bool_and(version >= lo and (hi is null or version < hi)), true) as ok from v left join s using (project) group by v.project, v.version""")
def versions(spark, d):
    """2.4.13: every declared range must hold a version."""
    sizes = read(spark, d, "part").select(F.col("p_size").alias("version")).distinct()
    supported = read(spark, d, "nation").select(F.col("n_nationkey").alias("project"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("version")).join(sizes, "version", "left_semi")
    signals = read(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), (F.col("s_suppkey") % 10).alias("lo"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 10 + 6).alias("hi"))
    return J.supported_versions(supported, signals)


PATTERNS = {"the": " the ", "und": " und ", "hex": "[0-9a-f]{16,}", "mail": r"[\w.]+@[\w.]+", "numbers": r"\d+", "shout": "[A-Z]{4,}", "pipes": r" \| "}


@query("pattern_counts", " union all ".join(f"select '{k}' as name, sum(len(regexp_extract_all(text, '{p}')))::bigint as n, coalesce((select string_agg(p, ',' order by p) from (select 'd' || lpad(doc_id::varchar, 6, '0') as p from documents where regexp_matches(text, '{p}') order by p limit 5)), '') as files from documents" for k, p in PATTERNS.items()))
def pattern_counts(spark, d):
    """2.4.14, 2.5.18."""
    texts = read(spark, d, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("path"), "text")
    return J.pattern_counts(texts, PATTERNS)


NEEDLES = "n as (select item_id * 10 + k as needle_id, case k when 0 then text when 1 then left(text, 3) when 2 then left(text, 12) when 3 then left(text, 40) when 4 then right(text, 25) else '' end as needle from benchmark, (values (0), (1), (2), (3), (4), (5)) as t(k))"
DIFFS = """diffs as (select doc_id as run, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when i % 3 = 1 then '+++' when i % 3 = 2 then '+ ' else '+//' end || x), chr(10)) as diff, case when doc_id % 2 = 0 then text else left(text, 200) end as body from documents)"""


@query("leaked_needles", f"with {NEEDLES} select d.doc_id as text_id, n.needle_id from documents d join n on n.needle <> '' and contains(d.text, n.needle)")
def leaked(spark, d):
    """2.4.15: whole benchmark items, their first 3, 12 and 40 characters, and their ends, inside documents."""
    b = read(spark, d, "benchmark")
    part = lambda k, needle: b.select((F.col("item_id") * 10 + k).alias("needle_id"), needle.alias("needle"))
    needles = part(0, F.col("text"))
    for k, needle in enumerate((F.substring("text", 1, 3), F.substring("text", 1, 12), F.substring("text", 1, 40), F.right("text", F.lit(25)), F.lit("")), 1):
        needles = needles.unionByName(part(k, needle))
    return J.leaked_needles(read(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), needles)


@query("leak_guard", f"""with {DIFFS}, lines as (select distinct run, trim(l[2:]) as code from (select run, unnest(string_split(diff, chr(10))) as l from diffs) where l[1:1] = '+' and l[1:3] <> '+++'),
good as (select * from lines where length(code) >= 24 and not (code[1:2] in ('//', '/*') or code[1:1] in ('#', '*')))
select d.run, count(code) filter (where contains(d.body, code)) as leaked, count(code) filter (where contains(d.body, code)) >= 3 as violates from diffs d left join good using (run) group by d.run""")
def leak_guard(spark, d):
    """2.4.15: three or more substantive lines of the golden change in a truth text."""
    docs = read(spark, d, "documents")
    diff = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, "+++").when(i % 3 == 1, "+ ").otherwise("+//"), x)), "\n")
    body = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 200))
    return J.leak_guard(docs.select(F.col("doc_id").alias("run"), diff.alias("diff")), docs.select(F.col("doc_id").alias("run"), body.alias("body")))


@query("uncovered_files", "select l_orderkey as run, string_agg(distinct 'p' || l_partkey, ',' order by 'p' || l_partkey) as missing, count(distinct l_partkey) as n_missing from lineitem where l_quantity > 40 and (l_orderkey, l_partkey) not in (select l_orderkey, l_partkey from lineitem where l_returnflag = 'N') group by l_orderkey")
def uncovered(spark, d):
    """2.4.16, 2.8.3."""
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), "l_quantity", "l_returnflag")
    return J.uncovered_files(items.filter("l_quantity > 40").select("run", "path"), items.filter("l_returnflag = 'N'").select("run", "path"))


@query("tampered", "select p_partkey as path, p_size > 45 as vanished from part where p_size > 45 or p_partkey % 13 = 0")
def tampered(spark, d):
    """2.4.17."""
    part = read(spark, d, "part")
    before = part.select(F.col("p_partkey").alias("path"), F.col("p_name").alias("content"))
    after = part.filter("p_size <= 45").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 13 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("content"))
    return J.tampered(before, after)


@query("fifo_zip", """with t as (select conv_id as unit, turn, length(text) % 3 as markers from conversations), h as (select *, sum(markers) over (partition by unit order by turn) as hi, lead(turn) over (partition by unit order by turn) is null as last from t),
e as (select unit, unnest(range(1, total + 3)) as k from (select unit, sum(markers)::bigint as total from t group by unit))
select e.unit, e.k, 'e' || e.k as edit, h.turn from e join h on e.unit = h.unit and e.k > hi - markers and (last or e.k <= hi)""")
def fifo(spark, d):
    """2.4.18: more edits than markers; the last turn takes the rest."""
    turns = read(spark, d, "conversations").select(F.col("conv_id").alias("unit"), "turn", (F.length("text") % 3).alias("markers"))
    edits = turns.groupBy("unit").agg(F.sum("markers").alias("total")).select("unit", F.explode(F.sequence(F.lit(1), F.col("total") + 2)).alias("k")).select("unit", "k", F.concat(F.lit("e"), F.col("k").cast("string")).alias("edit"))
    return J.fifo_zip(turns, edits)


@query("inventory_key", "select p_partkey, array_to_string(list_transform(string_split(p_name || '.JS', '.'), lambda x: lower(x)), '-') as key from part")
def inventory_key(spark, d):
    """2.1.5."""
    from tallyspark.functions.text import inventory_key as key

    return read(spark, d, "part").select("p_partkey", key(F.concat("p_name", F.lit(".JS"))).alias("key"))
