"""The corpus pipeline: what a raw corpus goes through before training.

Every stage takes and returns a frame of documents; its output is written as Parquet
and read again as the next stage's input, so a lost executor never costs more than the
stage at hand.  The last stage returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bridgerec.llm.decontaminate import drop_contaminated
from bridgerec.llm.ngram_jaccard import drop_near_duplicates
from bridgerec.llm.queries import table, vocabulary
from bridgerec.llm.sentencepiece_codec import sentencepiece_codec
from bridgerec.llm.staging import Stage, ship_package
from bridgerec.llm.suffix_dedup import drop_repeats
from bridgerec.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5."""
    ship_package(spark)
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), Stage(spark, "toxicity")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links."""
    ship_package(spark)
    return drop_near_duplicates(docs, Stage(spark, "ngram-jaccard"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages of 50 words or more stay in their first place alone."""
    ship_package(spark)
    out = drop_repeats(docs, Stage(spark, "suffix-dedup"))
    if "n_chars" in out.columns:
        counted = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
        out = out.withColumn("n_chars", counted)
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    ship_package(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), Stage(spark, "decontaminate"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document."""
    ship_package(spark)
    return sentencepiece_codec(docs, vocabulary("piece_bpe_32k.model"), decoded=False, digests=True)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: The stages are beyond SQL (a trained model, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    between = Stage(spark, "pipeline")
    for name, stage in STAGES:
        docs = between.write(stage(spark, docs, sf_dir), name)
    return docs
