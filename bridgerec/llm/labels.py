"""Labelled rows for the classifiers: folds and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled_ids(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, label)`` of the ids that have a label of 0 or 1 and are not held out; an id
    with both counts as 1."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    return rows.groupBy("id").agg(F.max("label").alias("label"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(text, label)`` of at most ``per_class`` labelled ids a class that are not
    held out, the ones with the smallest hashes of their ids.  An id with both labels
    counts as 1; ids without a document and labels other than 0 and 1 are left out."""
    rows = labelled_ids(labels, label_col, id_col)
    picked = [rows.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return text.join(F.broadcast(picked[0].unionAll(picked[1])), "id").select("text", "label")
