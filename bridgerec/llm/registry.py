"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from bridgerec.llm import queries as q
from bridgerec.llm import oracle
from bridgerec.llm.staging import ship_package

NAMES = [
    "op1_ngram_jaccard",
    "op2_sentencepiece_codec",
    "op3_token_counts",
    "op4_token_files",
    "op5_decontaminate",
    "op6_warc_audit",
    "op7_toxicity",
    "op8_embedding_near_dups",
    "op9_suffix_dedup",
    "op10_quality",
    "op11_exact_dedup",
    "op12_conversation_repair",
    "op13_spelling_variants",
]


def _with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _with_package(getattr(q, n)) for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return oracle.build()
