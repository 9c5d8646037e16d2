"""Order-sensitive, sort, distinct and set queries over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import dedup as D
from tallyspark.operators import graphs as G
from tallyspark.operators import windows as W
from tallyspark.plans.registry import query, read
from tallyspark.plans.rendered import E, numbers


def events(spark, d):
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("adjacent_dedup", "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is distinct from event_type")
def adjacent(spark, d):
    """2.6.1."""
    return W.collapse_adjacent(events(spark, d), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("clamp_timestamps", """with e as (select event_id, user_id % 10 as unit, case when event_id % 17 > 0 then epoch_us(date_trunc('hour', ts)) end as t from events), n as (select *, count(t) over (partition by unit order by event_id) as n from e)
select event_id, unit, case when t is not null then max(t - n) over (partition by unit order by event_id rows unbounded preceding) + n end as clamped from n""")
def clamp(spark, d):
    """2.6.2: times that repeat or fall are raised by a microsecond."""
    rows = events(spark, d).select("event_id", (F.col("user_id") % 10).alias("unit"), F.when(F.col("event_id") % 17 > 0, F.date_trunc("hour", "ts")).alias("t"))
    return W.clamp_timestamps(rows, ["unit"], ["event_id"], "t").select("event_id", "unit", "clamped")


@query("apportion", """with l as (select l_orderkey as k, l_linenumber as i, case when l_orderkey % 9 = 0 then 0 else l_quantity::bigint end as w, (l_orderkey % 1000) as t from lineitem), r as (select *, row_number() over (partition by k order by i, w) as n, sum(w) over (partition by k)::bigint as s, count(*) over (partition by k) as c from l),
b as (select *, case when s > 0 then t * w // s else 0 end as base, case when s > 0 then t * w % s else 0 end as rest from r), q as (select *, t - sum(base) over (partition by k) as lft, row_number() over (partition by k order by rest desc, n desc) as rk from b)
select k, n, (case when s > 0 then base + case when rk <= lft then 1 else 0 end when n = c then t else 0 end)::bigint as share from q""")
def apportion(spark, d):
    """2.6.3: largest remainders, ties to the later row."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.when(F.col("l_orderkey") % 9 == 0, 0).otherwise(F.col("l_quantity").cast("long")).alias("w"), (F.col("l_orderkey") % 1000).alias("t"))
    return W.apportion(rows, ["k"], ["i", "w"], "w", "t", place="n").select("k", "n", "share")


@query("stage_regression", "with s as (select o_custkey as run, o_orderkey as stage, case when o_orderstatus <> 'P' then (o_totalprice / 100000)::bigint end as p, o_custkey % 3 as t from orders), l as (select *, p < lag(p) over (partition by run order by stage) as dr from s where p is not null) select run, case when count(*) >= 2 then coalesce(bool_or(dr), false) end as regressed, case when count(*) >= 2 then count(distinct t) = 1 end as constant_tests from l group by run")
def regression(spark, d):
    """2.6.4."""
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("stage"), F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 100000).cast("long")).alias("num_passed"), (F.col("o_custkey") % 3).alias("num_tests"))
    return W.stage_regression(rows)


@query("never_rises", "with m as (select user_id, event_type, event_id, value > lag(value) over (partition by user_id, event_type order by event_id) as r from events) select user_id, event_type, count(*) as turns, min(event_id) filter (where r) as first_rise, min(event_id) filter (where r) is null as holds from m group by user_id, event_type having count(*) >= 2")
def monotone(spark, d):
    """2.6.5."""
    return W.never_rises(events(spark, d), ["user_id", "event_type"], "event_id", "value")


@query("cumulative_cost", "select user_id, event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as cumulative from events")
def cumulative(spark, d):
    """2.6.6."""
    return W.cumulative(events(spark, d), ["user_id"], ["ts", "event_id"], "value", "cumulative").select("user_id", "event_id", "cumulative")


@query("best_of_k", "with s as (select l_orderkey as task, l_partkey * 10 + l_linenumber as sample, case when l_orderkey % 5 = 0 then 0.0 else l_discount end as rate from lineitem) select task, (select sample from s t where t.task = s.task order by rate desc, sample limit 1) as best, greatest(0, max(rate)) as best_rate from s group by task")
def best(spark, d):
    """2.6.7."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("sample"), F.when(F.col("l_orderkey") % 5 == 0, 0.0).otherwise(F.col("l_discount")).alias("rate"))
    return W.best_of(rows, ["task"], "sample", "rate")


@query("duplicate_keys", "select doc_id, count(*) over (partition by lang, source, n_chars) > 1 as duplicate from documents")
def duplicates(spark, d):
    """2.6.8."""
    return W.duplicate_keys(read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source", "n_chars"]).select("doc_id", "duplicate")


@query("first_and_last", "select conv_id, arg_min(length(text), turn) filter (where role = 'user') as first_value, arg_max(length(text), turn) filter (where role = 'assistant') as last_value from conversations group by conv_id")
def picks(spark, d):
    """2.6.9."""
    rows = read(spark, d, "conversations").withColumn("n", F.length("text").cast("long"))
    return W.first_and_last(rows, ["conv_id"], "turn", "n", F.col("role") == "user", F.col("role") == "assistant")


@query("line_blocks", r"with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line from documents), b as (select *, sum(case when regexp_matches(line, '^[A-Z][a-z]*\.') then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding)::bigint as block from l) select doc_id, block, count(*) as n_lines, sum(length(line))::bigint as n_chars from b group by doc_id, block")
def line_blocks(spark, d):
    """2.6.10: a block starts at each marker line."""
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    out = W.blocks(rows, ["doc_id"], "pos", F.col("line").rlike(r"^[A-Z][a-z]*\."))
    return out.groupBy("doc_id", F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("role_runs", f"""with {E}, f as (select *, sum(case when i = 7 then 1 else 0 end) over w % 2 = 1 as fenced from e window w as (partition by doc order by pos rows unbounded preceding)),
r as (select *, last_value(case when not fenced and i <> 7 and k < 2 then case k when 0 then 'USER' else 'ASSISTANT' end end ignore nulls) over (partition by doc order by pos rows unbounded preceding) as role from f),
n as (select *, role is distinct from lag(role) over (partition by doc order by pos) as new from r)
select doc, pos, role, sum(new::int) over (partition by doc order by pos rows unbounded preceding)::bigint as run from n""")
def role_runs(spark, d):
    """2.6.10, 2.9.17: roles carried forward, not into code fences."""
    text = "case when i = 7 then '```' when k = 0 then concat('USER hello ', i) when k = 1 then concat('ASSISTANT hi ', i) else concat('more ', i) end"
    rows = numbers(spark, d).withColumn("text", F.expr(text))
    return W.role_runs(rows, ["doc"], "pos", F.nullif(F.regexp_extract("text", "^(USER|ASSISTANT) ", 1), F.lit(""))).select("doc", "pos", "role", "run")


@query("rising_errors", "with s as (select user_id, event_id, value, value - lag(value) over w as dv from events window w as (partition by user_id order by event_id)), l as (select *, min(dv) over w as lo, count(dv) over w as n from s window w as (partition by user_id order by event_id rows between 1 preceding and current row)) select user_id, event_id, coalesce(n = 2 and lo >= 1 and value >= 5, false) as alarm from l")
def rising(spark, d):
    """2.6.12, 2.11.6 in a batch."""
    return W.rising_errors(events(spark, d), ["user_id"], "event_id", "value", k=2).select("user_id", "event_id", "alarm")


@query("resume_points", "select o_custkey as run, min(o_orderkey) filter (where o_orderstatus = 'O') as resume_at from orders group by o_custkey")
def resume(spark, d):
    """2.6.13."""
    return W.resume_points(read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("stage"), F.when(F.col("o_orderstatus") != "O", F.lit(1)).alias("result")))


@query("highest_stage", "select l_partkey as module, arg_max('p' || l_orderkey || '.' || l_linenumber, l_orderkey * 10 + l_linenumber) as patch, max(l_orderkey * 10 + l_linenumber) as stage from lineitem group by l_partkey")
def highest(spark, d):
    """2.6.13, 2.5.22."""
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("module"), F.concat(F.lit("p"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("patch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stage"))
    return W.highest_stage(rows)


@query("repeated_errors", f"""with {E}, n as (select *, case when k = 0 then row_number() over (partition by doc, k, i % 5 order by pos) end as nth from e),
s as (select *, last_value(case when k = 0 then nth = 1 when k = 3 then true end ignore nulls) over (partition by doc order by pos rows unbounded preceding) as keep from n) select doc, pos from s where coalesce(keep, true)""")
def repeated(spark, d):
    """2.9.27: an error line that came before goes, with what follows it up to a blank line."""
    text = "case k when 0 then concat('a', i % 5, '.ts: error TS1') when 3 then '' else concat('  detail ', i) end"
    keyed = numbers(spark, d).withColumn("text", F.expr(text)).withColumn("key", F.nullif(F.regexp_extract("text", r"^(\S+: error \w+)", 1), F.lit("")))
    return W.repeated_errors(keyed, ["doc"], "pos", "key").select("doc", "pos")


@query("distinct_then_top", "with f as (select *, row_number() over (partition by p_name, p_brand order by p_partkey) as n from part) select p_partkey, p_name, p_brand, p_size from f where n = 1 order by p_size desc, p_partkey limit 100")
def distinct_top(spark, d):
    """2.7.2."""
    return D.first_then_top(read(spark, d, "part"), ["p_name", "p_brand"], "p_partkey", "p_size", 100).select("p_partkey", "p_name", "p_brand", "p_size")


@query("duplicate_groups", r"with f as (select trim(regexp_replace(lower(n), '[-_./]+', '-', 'g'), '-') as key, n as name, files, p_partkey as k from (select p_partkey, case p_partkey % 3 when 0 then replace(p_name, ' ', '-') when 1 then upper(replace(p_name, ' ', '_')) else '.' || replace(p_name, ' ', '/') end || '_' || (p_partkey % 50) as n, p_size as files from part)), g as (select *, row_number() over w as place, count(*) over (partition by key) as n, first_value(name) over w as winner from f window w as (partition by key order by files desc, contains(name, '-') desc, name desc, k)) select key, name as loser, winner from g where n > 1 and place > 1")
def duplicate_groups(spark, d):
    """2.7.3."""
    k = F.col("p_partkey") % 3
    name = lambda sep: F.replace("p_name", F.lit(" "), F.lit(sep))
    folder = F.when(k == 0, name("-")).when(k == 1, F.upper(name("_"))).otherwise(F.concat(F.lit("."), name("/")))
    rows = read(spark, d, "part").select(F.concat(folder, F.lit("_"), (F.col("p_partkey") % 50).cast("string")).alias("name"), F.col("p_size").alias("files"))
    return D.duplicate_groups(rows)


@query("distinct_patches", "select sha256(text) as digest, min(doc_id) as first_pos, count(*) as n from documents group by text")
def patches(spark, d):
    """2.7.4."""
    return D.distinct_patches(read(spark, d, "documents").select(F.col("text").alias("patch"), F.col("doc_id").alias("pos")))


@query("version_order", f"with {E} select doc, pos, row_number() over (partition by doc order by k, i, p, pos) as place from e")
def version_order(spark, d):
    """2.7.5."""
    from pyspark.sql import Window

    rows = numbers(spark, d).withColumn("version", F.expr("concat(k, '.', i, '.', p, if(ms % 2 = 0, 'rc1', ''))"))
    return rows.select("doc", "pos", F.row_number().over(Window.partitionBy("doc").orderBy(D.version_key(F.col("version")), "pos")).cast("long").alias("place"))


@query(
    "import_levels",
    """with recursive parts as (select p_partkey as p from part), edges as (select p as src, p // 2 as dst from parts where p % 11 > 0 and p >= 2),
lv(node, level) as (
  select p, case when p % 97 = 5 then 1 else 0 end from parts
  union all select e.src, lv.level + 1 from edges e join lv on e.dst = lv.node
)
select node, max(level) as level, false as broken from lv group by node
union all select -2 * p - k, 0, true from parts, (values (0), (1)) as g(k) where p % 97 = 5""",
)
def levels(spark, d):
    """2.7.7: levels of an import graph; each cycle of three nodes holds another of two."""
    part = read(spark, d, "part").select(F.col("p_partkey").alias("p"))
    tree = part.filter("p % 11 > 0 and p >= 2").select(F.col("p").alias("src"), F.floor(F.col("p") / 2).alias("dst"))
    p, g, h = F.col("p"), -2 * F.col("p"), -2 * F.col("p") - 1
    ring = F.explode(F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in ((p, g), (g, p), (g, h), (h, p), (h, g))]))
    loops = part.filter("p % 97 = 5").select(ring.alias("e")).select("e.*")
    nodes = part.select(p.alias("node")).union(loops.select("src"))
    return G.import_levels(nodes, tree.unionByName(loops))


@query("alias_keys", """with r as (select p_partkey as pos, 'i' || p_size as instance_id, p_brand || '/' || replace(p_name, ' ', '-') as repo, replace(p_name, ' ', '_') as original_repo, replace(p_name, ' ', '-') as base from part)
select alias, min(pos) as pos from (select instance_id as alias, pos from r union all select repo, pos from r union all select original_repo, pos from r union all select base, pos from r) group by alias""")
def aliases(spark, d):
    """2.8.1, 2.3.14."""
    dash = F.replace("p_name", F.lit(" "), F.lit("-"))
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("i"), F.col("p_size").cast("string")).alias("instance_id"), F.concat_ws("/", "p_brand", dash).alias("repo"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("original_repo"))
    return D.alias_keys(rows)


@query("narrowed_versions", """with t as (select p_partkey as k, p_size % 8 as a, p_partkey % 4 as b from part), v as (select k, unnest([1, 2, 3]) as v, a, b from t),
one as (select *, v >= a as in_a, (a <= 3) as some_a from v), two as (select k, v, b, case when some_a then in_a else true end as ok from one),
three as (select *, v <= b as in_b, bool_or(ok and v <= b) over (partition by k) as some_b from two)
select k, string_agg(v::varchar, ',' order by v) as versions from three where ok and (not some_b or in_b) group by k""")
def narrowed(spark, d):
    """2.8.2: narrowed to each set wherever that leaves something."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("array(1, 2, 3)").alias("a"), F.expr("filter(array(0, 1, 2, 3, 9), x -> x >= p_size % 8)").alias("b"), F.expr("filter(array(1, 2, 3), x -> x <= p_partkey % 4)").alias("c"))
    return rows.select("k", F.array_join(D.narrowed(F.col("a"), F.col("b"), F.col("c")).cast("array<string>"), ",").alias("versions"))


@query("duplicate_ids", "select source as repo, count(*) - count(distinct text) as n_dup from documents group by source")
def duplicate_ids(spark, d):
    """2.8.4."""
    return read(spark, d, "documents").groupBy(F.col("source").alias("repo")).agg((F.count("*") - F.count_distinct("text")).alias("n_dup"))
