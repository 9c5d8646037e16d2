"""Scans and sinks over files that are written from table rows first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.plans.registry import query, read
from tallyspark.plans.rendered import E, numbers, text_of
from tallyspark.sources import pdf, readers, search, writers
from tallyspark.sources.shared import Scratch


def _files(spark, rows, key: str) -> str:
    """One text file for each key, from (key, text) of one row a key, a line end after it; the folder that holds them."""
    path = Scratch(spark, "files", lasting=True).path()
    rows.select(key, "text").write.partitionBy(key).text(path)
    return path


def _entries(spark, d):
    """(nation, text): the suppliers of each nation as entries, in four containers; the bare one holds the first alone."""
    s = read(spark, d, "supplier")
    entry = lambda x: F.struct(F.concat(F.lit("i"), x["s_suppkey"]).alias("instance_id"), x["s_name"].alias("repo"), F.create_map(F.lit("python"), x["s_nationkey"].cast("string")).alias("setup"))
    rows = s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_nationkey"))), entry).alias("a"))
    a, form = F.to_json("a"), F.col("nation") % 4
    wrapped = F.concat(F.lit('{"'), F.element_at(F.array(F.lit("data"), F.lit("entries"), F.lit("instances")), form + 1), F.lit('":'), a, F.lit("}"))
    text = F.when(form == 3, F.when(F.col("nation") < 10, a).otherwise(F.to_json(F.get("a", F.lit(0))))).otherwise(wrapped)
    return rows.select("nation", text.alias("text"))


FORMS = "s as (select *, row_number() over (partition by s_nationkey order by s_suppkey) as n, s_nationkey % 4 = 3 and s_nationkey >= 10 as bare from supplier)"


@query("dataset_scan", f"with {FORMS} select 'i' || s_suppkey as instance_id, s_name as repo, s_nationkey::varchar as python from s where n = 1 or not bare")
def dataset_scan(spark, d):
    """2.1.1, 2.1.3: every entry of all files, whatever container holds it."""
    out = readers.dataset(spark, _files(spark, _entries(spark, d), "nation") + "/*/*")
    return out.select("instance_id", "repo", F.col("setup")["python"].alias("python"))


@query("first_records", f"with {FORMS} select s_nationkey::varchar as nation, case when bool_or(bare) then 1 else count(*) end as records, 'i' || min(s_suppkey) as instance_id from s group by s_nationkey")
def first_records(spark, d):
    """2.1.2: the first entry of each file, with the number of its entries."""
    out = readers.first_records(spark, _files(spark, _entries(spark, d), "nation") + "/*/*")
    return out.select(F.regexp_extract("file", "nation=([^/]+)/", 1).alias("nation"), "records", F.col("first.instance_id").alias("instance_id"))


#: Caps small enough for the logs of nations to meet both.
LOG_CAP, LOGS_CAP = 60_000, 400_000
LOG_SIZES = "l as (select n_nationkey as nation, n_nationkey * 7 % 25 * 3000 + 1 as n from nation)"


@query("log_scan", f"""with {LOG_SIZES}, b as (select *, coalesce(sum(case when n <= {LOG_CAP} then n else 0 end) over (order by nation::varchar rows between unbounded preceding and 1 preceding), 0) as before from l)
select nation::varchar as nation, case when before >= {LOGS_CAP} then 'after_cap' when n > {LOG_CAP} then 'too_large' else 'read' end as state, case when before < {LOGS_CAP} and n <= {LOG_CAP} then n end as n_chars from b""")
def log_scan(spark, d):
    """2.1.11: files over one cap and those behind the other keep a row that says so."""
    rows = read(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.repeat(F.lit("x"), (F.col("n_nationkey") * 7 % 25 * 3000).cast("int")).alias("text"))
    out = readers.logs(spark, _files(spark, rows, "nation"), LOG_CAP, LOGS_CAP)
    return out.select(F.regexp_extract("path", "nation=([^/]+)/", 1).alias("nation"), "state", F.length("text").alias("n_chars"))


@query("jsonl_appends", "select case when event_id % 5 = 0 then 'audit' else 'output' end as side, user_id, 2 * count(*) as n, 2 * sum(event_id) as ids from events group by 1, 2")
def jsonl_appends(spark, d):
    """2.2.1: two appends; records with a capture mismatch stand on the audit side."""
    path = Scratch(spark, "appends", lasting=True).path()
    rows = read(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 == 0, True).when(F.col("event_id") % 5 == 1, False).alias("capture_mismatch"))
    for _ in range(2):
        writers.append_jsonl(rows, path)
    schema = "event_id long, user_id long"
    side = lambda s: spark.read.schema(schema).json(f"{path}/{s}").select(F.lit(s).alias("side"), "event_id", "user_id")
    return side("audit").unionByName(side("output")).groupBy("side", "user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("inventory_files", "select distinct (user_id % 20)::varchar as key, 'T' || event_id % 37 as test_id from events")
def inventory_files(spark, d):
    """2.2.3, 2.1.4: sorted ids as bz2 text, one folder a key, read again."""
    ids = read(spark, d, "events").select((F.col("user_id") % 20).cast("string").alias("key"), F.concat(F.lit("T"), F.col("event_id") % 37).alias("test_id")).distinct()
    path = Scratch(spark, "inventory", lasting=True).path()
    writers.write_inventory(ids, path)
    return spark.read.schema("value string, key string").text(path).select(F.col("key"), F.col("value").alias("test_id"))


@query("pdf_pages", f"with {E} select doc, p as page, string_agg('w' || i || ' (a) ' || chr(92) || ' ' || pos, chr(10) order by pos) as text from e group by doc, p")
def pdf_pages(spark, d):
    """2.1.13: a file of three pages for each user, its lines in the order they are shown."""
    line = r"concat('0 -14 Td (w', i, ' (a) \\\\ ', pos, ') Tj')"
    streams = text_of(numbers(spark, d).withColumn("at", F.struct("doc", "p")), line, by="at").select("at.*", F.concat(F.lit("BT /F1 12 Tf\n"), "text", F.lit("\nET")).alias("body"))
    number = lambda base: (F.col("p") + base).cast("string")
    one = F.concat(number(10), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R /Contents "), number(20), F.lit(" 0 R >>\nendobj\n"), number(20), F.lit(" 0 obj\n<< /Length "), F.length("body").cast("string"), F.lit(" >>\nstream\n"), "body", F.lit("\nendstream\nendobj\n"))
    files = streams.select("doc", "p", one.alias("one")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("p", "one"))).alias("a"))
    kids = F.array_join(F.transform("a", lambda x: F.concat((x["p"] + 10).cast("string"), F.lit(" 0 R"))), " ")
    head = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids ["), kids, F.lit("] >>\nendobj\n"))
    content = F.concat(head, F.array_join(F.transform("a", lambda x: x["one"]), ""), F.lit("trailer\n<< /Root 1 0 R >>\n%%EOF"))
    pages = pdf.pdf_pages(files.select("doc", F.encode(content, "ISO-8859-1").alias("content")))
    # pages of a file are counted from 0, whichever of the three it has
    kept = files.select("doc", F.posexplode(F.transform("a", lambda x: x["p"])).alias("page", "p"))
    return pages.join(kept, ["doc", "page"]).select("doc", F.col("p").alias("page"), "text")


@query(
    "search_ranges",
    """with recursive r(lo, hi, n) as (
  select 0, 4096, count(*) from part where p_retailprice < 4096
  union all select h.lo, h.hi, (select count(*) from part where floor(p_retailprice) >= h.lo and floor(p_retailprice) < h.hi)
  from (select r.lo + k * (r.hi - r.lo) // 2 as lo, r.lo + (k + 1) * (r.hi - r.lo) // 2 as hi from r, (values (0), (1)) as t(k) where n > 40 and r.hi - r.lo > 1) as h
)
select lo, hi, n, n > 40 as over from r where n > 0 and (n <= 40 or hi - lo = 1)""",
)
def search_ranges(spark, d):
    """2.1.14: the ranges of a search that shows forty hits."""
    return search.search_ranges(read(spark, d, "part").select(F.floor("p_retailprice").alias("price")), "price", 40, 12)
