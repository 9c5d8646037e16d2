"""Scans: datasets, inventories, reports, logs and run folders, through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.sources.shared import Scratch

ENTRY = "instance_id string, repo string, original_repo string, base_commit string, reference_commit string, src_dir string, setup map<string,string>, test map<string,string>"


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """Entries of one or many JSON files: a list, or one wrapped in data, entries or instances."""
    wrapped = ", ".join(f"{k} array<struct<{', '.join(f.replace(' ', ':', 1) for f in _fields())}>>" for k in ("data", "entries", "instances"))
    rows = spark.read.option("multiLine", True).schema(f"{ENTRY}, {wrapped}").json(path)
    inner = F.coalesce("data", "entries", "instances")
    listed = rows.filter(inner.isNotNull()).select(F.posexplode(inner).alias("pos", "e")).select("e.*")
    return rows.filter(inner.isNull()).drop("data", "entries", "instances").unionByName(listed)


def _fields() -> list[str]:
    return ["instance_id string", "repo string", "original_repo string", "base_commit string", "reference_commit string", "src_dir string", "setup map<string,string>", "test map<string,string>"]


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(key, kind, test_id) of bz2 lists, one id a line; ``name#fail_to_pass`` and ``name#pass_to_pass`` are two kinds of one key."""
    rows = spark.read.text(path).select(F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+?)(?:\.txt)?\.bz2$", 1).alias("file"), F.trim("value").alias("test_id"))
    parts = F.split("file", "#")
    return rows.filter("test_id <> ''").select(F.get(parts, F.lit(0)).alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("all")).alias("kind"), "test_id")


def pytest_report(docs: DataFrame) -> DataFrame:
    """(doc, test_id, outcome, duration) of both report layouts; of several results the last holds."""
    call = "struct<outcome:string,duration:double>"
    new = docs.filter(F.col("text").rlike(r'^\s*\{')).select("doc", F.posexplode(F.from_json("text", f"created double, tests array<struct<nodeid:string,call:{call}>>")["tests"]).alias("pos", "t"))
    new = new.filter("t.call is not null").select("doc", "pos", F.col("t.nodeid").alias("test_id"), "t.call.outcome", "t.call.duration")
    old = docs.filter(F.col("text").rlike(r"^\s*\[")).select("doc", F.posexplode(F.from_json("text", "array<struct<nodeid:string,`when`:string,outcome:string,duration:double>>")).alias("pos", "t"))
    old = old.filter("t.`when` = 'call'").select("doc", "pos", F.col("t.nodeid").alias("test_id"), "t.outcome", "t.duration")
    return new.unionByName(old).groupBy("doc", "test_id").agg(F.max_by(F.struct("outcome", "duration"), "pos").alias("r")).select("doc", "test_id", "r.outcome", "r.duration")


def surefire(spark: SparkSession, path: str) -> DataFrame:
    """(test_id, status) of Surefire XML files; malformed files are passed over."""
    schema = "_classname string, _name string, failure string, error string, skipped string"
    rows = spark.read.format("xml").option("rowTag", "testcase").option("mode", "DROPMALFORMED").option("nullValue", "\0").schema(schema).load(path)
    status = F.when(F.col("failure").isNotNull(), "FAILED").when(F.col("error").isNotNull(), "ERROR").when(F.col("skipped").isNotNull(), "SKIPPED").otherwise("PASSED")
    return rows.select(F.concat_ws("#", "_classname", "_name").alias("test_id"), status.alias("status"))


def first_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, records, first): the first entry of each JSON file, and how many it has.

    A file holds a list, an object with one in entries, instances or data, or a bare object.
    """
    entry = "struct<" + ",".join(f.replace(" ", ":", 1) for f in _fields()) + ">"
    files = spark.read.text(path, wholetext=True).select(F.url_decode(F.input_file_name()).alias("file"), F.trim("value").alias("value"))
    wrapped = F.from_json("value", f"entries array<{entry}>, instances array<{entry}>, data array<{entry}>")
    bare = F.from_json("value", ", ".join(_fields()))
    listed = F.when(F.col("value").startswith("["), F.from_json("value", f"array<{entry}>"))
    entries = files.select("file", F.coalesce(listed, wrapped["entries"], wrapped["instances"], wrapped["data"], F.array(bare)).alias("e"))
    return entries.select("file", F.size("e").alias("records"), F.get("e", F.lit(0)).alias("first"))


#: The files of a log scan, and its caps on one file and on all.
LOG_FILES = r"\.(log|txt|stderr|stdout)$"
FILE_CAP, TOTAL_CAP = 50 << 20, 500 << 20


def log_files(spark: SparkSession, path: str, file_cap: int = FILE_CAP, total_cap: int = TOTAL_CAP) -> DataFrame:
    """(path, length, state) of log files: ``read``, ``too_large``, or ``after_cap`` for those that
    follow, in the order of paths, once the files read reach ``total_cap`` bytes.

    Sizes are summed up in ranges of paths, so no task sees all of them; no content is read.
    Empty files are no part of a scan.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    found = found.filter(F.col("path").rlike(LOG_FILES)).withColumn("counted", F.when(F.col("length") <= file_cap, F.col("length")).otherwise(0))
    # folders and names compare one by one, as a walk of the folders would meet them
    found = found.withColumn("parts", F.split("path", "/")).repartitionByRange("parts").withColumn("part", F.spark_partition_id())
    found = Scratch(spark, "logs", lasting=True).saved(found)
    by_part, inside = Window.orderBy("part"), Window.partitionBy("part").orderBy("parts")
    ends = found.groupBy("part").agg(F.sum("counted").alias("n")).withColumn("base", F.sum("n").over(by_part) - F.col("n")).drop("n")
    before = F.col("base") + F.sum("counted").over(inside) - F.col("counted")
    state = F.when(before >= total_cap, "after_cap").when(F.col("length") > file_cap, "too_large").otherwise("read")
    return found.join(ends, "part").select("path", "length", state.alias("state"))


def logs(spark: SparkSession, path: str, file_cap: int = FILE_CAP, total_cap: int = TOTAL_CAP) -> DataFrame:
    """(path, state, text) of log files; a file beyond a cap keeps its row, without text."""
    state = log_files(spark, path, file_cap, total_cap)
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("path").rlike(LOG_FILES) & (F.col("length") <= file_cap))
    texts = texts.select("path", F.decode("content", "utf-8").alias("text"))
    wanted = state.filter("state = 'read'").select("path")
    return state.select("path", "state").join(texts.join(wanted, "path", "left_semi"), "path", "left")


def run_modules(files: DataFrame) -> DataFrame:
    """(run, stage, module, done, needs_retry, has_output) from the paths of a run's files."""
    p = r"([^/]+)/(stage\d+[^/]*)/(?:.*/)?([^/]+)/([^/]+)$"
    parts = files.select(*[F.regexp_extract("path", p, k).alias(n) for k, n in ((1, "run"), (2, "stage"), (3, "module"), (4, "name"))]).filter("stage <> ''").filter(~F.col("stage").endswith("_eval"))
    flag = lambda name: F.bool_or(F.col("name") == name)
    out = parts.groupBy("run", "stage", "module").agg(flag(".done").alias("done"), flag(".needs_retry").alias("needs_retry"), flag("output.json").alias("has_output"))
    return out.filter("done or needs_retry or has_output")


def candidates_csv(spark: SparkSession, path: str, hosts: tuple[str, ...] = ("github.com",)) -> DataFrame:
    """(library, url, owner, repo) of a CSV with a header; other hosts and schemes are dropped."""
    rows = spark.read.csv(path, header=True, enforceSchema=False, schema="library string, url string")
    return repo_urls(rows, hosts)


def repo_urls(rows: DataFrame, hosts: tuple[str, ...] = ("github.com",)) -> DataFrame:
    parts = F.split(F.regexp_replace(F.try_parse_url("url", F.lit("PATH")), r"^/|/$|\.git$", ""), "/")
    good = F.try_parse_url("url", F.lit("HOST")).isin(*hosts) & F.try_parse_url("url", F.lit("PROTOCOL")).isin("https", "http")
    return rows.filter(good & (F.size(parts) >= 2)).select("library", "url", F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("repo"))


def star_range(stars: Column) -> Column:
    """The range of a paged search that a candidate falls in."""
    return F.when(stars < 500, "0..499").when(stars < 1000, "500..999").when(stars < 5000, "1000..4999").otherwise("5000..")


def pipeline_rewards(docs: DataFrame) -> DataFrame:
    """(doc, stage, pass_rate) of stage records, nested or flat; malformed ones give nulls."""
    rec = "struct<pass_rate:double>"
    j = F.from_json("text", f"stages struct<stage1_draft:{rec},stage2_lint:{rec},stage3_tests:{rec}>, stage1 {rec}, stage2 {rec}, stage3 {rec}")
    rows = docs.select("doc", j.alias("j"))
    rate = lambda a, b: F.coalesce(F.col(f"j.stages.{a}.pass_rate"), F.col(f"j.{b}.pass_rate"))
    pairs = F.array(*[F.struct(F.lit(k).alias("stage"), rate(a, f"stage{k}").alias("pass_rate")) for k, a in ((1, "stage1_draft"), (2, "stage2_lint"), (3, "stage3_tests"))])
    return rows.select("doc", F.explode(pairs).alias("p")).select("doc", "p.*")
