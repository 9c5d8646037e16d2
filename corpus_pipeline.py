"""A corpus pipeline: quality rules, language ID, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir), docs being the whole output of the stage
before, and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import langid, minhash, packing, quality, secret_scan
from tallyspark.sources.shared import Scratch

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    added = [c for c in quality.judged(docs.limit(0)).columns if c not in docs.columns]
    return quality.judged(docs).filter("kept").drop(*added).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus' labels teach, by a score that
    texts of other languages do not reach; where it has no labels, every document."""
    picked = langid.labelled(docs)
    profiles = langid.train_on(picked)
    if not profiles.langs:
        return docs
    least = langid.least_score(picked, profiles)
    known = langid.identify(docs, profiles, lang_col="_lang", score_col="_score")
    return known.filter((F.col("_lang") != "und") & (F.col("_score") >= least)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates: five words, 80 in 100."""
    return minhash.one_of_each(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars to match."""
    found = secret_scan.scan(docs, secret_scan.trained(docs), spans_col="_spans")
    found = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("_spans")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("packing", packing_stage),
]

#: Trained profiles, MinHash, models and packing have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, lasting = Scratch(spark, "pipeline"), Scratch(spark, "pipeline-out", lasting=True)
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = (lasting if k == len(STAGES) else scratch).saved(stage(spark, docs, sf_dir))
    scratch.clear()
    return docs
