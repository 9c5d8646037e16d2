"""The queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import bpe, fill_middle, fingerprint, html_extract, langid, merkle, minhash, packing, quality, ring, secret_scan, simhash, token_counts
from tallyspark.llm.common import table


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": _over("documents", bpe.round_trip),
        "op2_html": _over("pages", html_extract.page_texts),
        "op3_minhash": _over("documents", minhash.near_duplicates),
        "op4_langid": _over("documents", langid.languages),
        "op5_fingerprint": _over("documents", fingerprint.fingerprints),
        "op6_sharding": _over("documents", ring.sharded),
        "op7_secrets": _over("documents", secret_scan.secrets),
        "op8_token_counts": _over("documents", token_counts.document_counts),
        "op9_packing": _over("documents", packing.packed),
        "op10_quality": _over("documents", quality.document_quality),
        "op11_fill_middle": _over("documents", fill_middle.middles),
        "op12_simhash": _over("documents", simhash.near_fingerprints),
        "op13_merkle": _over("documents", merkle.verified_rows),
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_quality": quality.oracle_sql(), "op11_fill_middle": fill_middle.oracle_sql(), "op13_merkle": merkle.oracle_sql()}
