"""Queries that apply the operators to their whole tables.

``TOKENIZER_DIR`` is the one parameter taken from outside: the folder of the
public vocabulary files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bridgerec.llm.conversation_repair import conversation_repair, damaged
from bridgerec.llm.decontaminate import contamination
from bridgerec.llm.embed_dedup import embedding_near_dups
from bridgerec.llm.exact_dedup import exact_dedup
from bridgerec.llm.ngram_jaccard import ngram_jaccard_join
from bridgerec.llm.quality import fit_quality, quality_scores
from bridgerec.llm.sentencepiece_codec import sentencepiece_codec
from bridgerec.llm.spelling_variants import spelling_variants
from bridgerec.llm.staging import Stage
from bridgerec.llm.suffix_dedup import repeated_passages
from bridgerec.llm.token_counts import token_counts
from bridgerec.llm.token_files import as_uri, read_token_files, write_token_files
from bridgerec.llm.toxicity import fit_toxicity, toxicity_scores
from bridgerec.llm.warc import audit, copy_replica, merkle_levels, read_warc, write_warc

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    return os.path.join(TOKENIZER_DIR, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "ngram-jaccard")
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), stage).select(
        "doc_id", "n_shingles", "component_id", "class_id"
    )


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec(docs, vocabulary("piece_bpe_32k.model"), ids=False, decoded=False, digests=True)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = as_uri(Stage(spark, "token-files").path("shards"))
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, folder, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_token_files(manifest, ids=False)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = contamination(docs, items, Stage(spark, "decontaminate"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC files and copied to a second folder, where the copy of
    every page whose id leaves 13 when divided by 97 is damaged on purpose; the audit of
    the two must find these records and no others."""
    stage = Stage(spark, "warc")
    first, second = (as_uri(stage.path(x)) for x in ("first", "second"))
    index = write_warc(table(spark, sf_dir, "pages"), first, stage)
    copy_replica(index, first, second, flip=F.col("page_id") % 97 == 13)
    bad = audit(merkle_levels(index, first, stage, "ours"), merkle_levels(index, second, stage, "theirs"))
    damaged = index.join(bad.select("file", F.col("node").alias("place")), ["file", "place"]).groupBy("page_id").count()
    damaged = damaged.select(F.col("page_id").alias("bad_id"), F.lit(True).alias("hit"))
    read = read_warc(index, first).join(damaged, F.col("page_id").eqNullSafe(F.col("bad_id")), "left")
    return read.select("page_id", "payload_sha256", "n_bytes", F.coalesce("hit", F.lit(False)).alias("damaged"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), Stage(spark, "toxicity"))
    return toxicity_scores(docs, model)


def op8_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dups(table(spark, sf_dir, "embeddings"), Stage(spark, "embed-dedup"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"), Stage(spark, "suffix-dedup"))
    return found.select("doc_id", F.explode("repeated").alias("s"), "later").select(
        "doc_id",
        F.col("s.start").alias("start_word"),
        F.col("s.end").alias("end_word"),
        F.exists("later", lambda x: (x.start < F.col("s.end")) & (x.end > F.col("s.start"))).alias("is_later"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), Stage(spark, "quality"))
    return quality_scores(docs, model)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), Stage(spark, "exact-dedup")).drop("doc")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(damaged(table(spark, sf_dir, "conversations")), Stage(spark, "conversation-repair"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), Stage(spark, "spelling-variants"))
