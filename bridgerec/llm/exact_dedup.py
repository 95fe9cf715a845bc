"""Exact duplicates by sorting the contents.

Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``.
Rows are range-partitioned by splitters that Spark samples from the normalised bytes (their
first ``HEAD`` bytes, then their sha256, so a sampled key and a splitter are small however
long the texts) and sorted there by an external sort, which puts equal texts side by side,
the row that stays first.  Each row is compared with the one before it, byte by byte.

The rows of one text are told apart by length, id and a row number, so splitters also fall
inside a large group of copies and it spreads over many tasks.  A run that touches the border
of a task may go on in the next one: a task hands on one summary for its first and one for its last
run, and summaries with the same bytes are joined.  There are at most two a task.

Defined cases: null counts as the empty text; empty texts are equal to each other and to
texts of white space alone; of equal texts the row with the most code points stays, then
the one with the smallest id (null ids last), then the one that is read first, so
repeated rows leave one; ``keep_id`` is null if all ids of a group are; an empty
table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bridgerec.llm.staging import Stage, fresh_name, maybe_broadcast, row_key

#: Bytes of a normalised text in a sort key; the digest orders texts that agree in them.
HEAD = 64

_OUT = pa.schema(
    [
        ("id", pa.int64()),
        ("doc", pa.int64()),
        ("digest", pa.binary()),
        ("keep_id", pa.int64()),
        ("size", pa.int64()),
        ("first", pa.bool_()),
        ("border", pa.int64()),
        ("shorter", pa.int64()),
        ("place", pa.int64()),
        ("norm", pa.binary()),
    ]
)
_DDL = (
    "id long, doc long, digest binary, keep_id long, size long, first boolean, "
    "border long, shorter long, place long, norm binary"
)


@dataclass
class _Run:
    """Rows of one text that end a batch; the text may go on in the next one."""

    digest: bytes
    norm: pa.Scalar
    shorter: int
    place: int
    keep: int | None
    ids: list[pa.Array] = field(default_factory=list)
    docs: list[pa.Array] = field(default_factory=list)

    def table(self, border: int | None) -> pa.RecordBatch:
        ids, docs = pa.concat_arrays(self.ids), pa.concat_arrays(self.docs)
        n = len(ids)
        first = np.zeros(n, bool)
        first[0] = True
        cols = [
            ids,
            docs,
            pa.array([self.digest] * n, pa.binary()),
            pa.array([self.keep] * n, pa.int64()),
            pa.array(np.full(n, n)),
            pa.array(first),
            pa.array([border] * n, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([*cols, *(pa.nulls(n, f.type) for f in list(_OUT)[7:])], schema=_OUT)

    def summary(self, border: int) -> pa.RecordBatch:
        row = [None, None, self.digest, self.keep, sum(map(len, self.ids)), None, border, self.shorter, self.place, self.norm.as_py()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _OUT, strict=True)], schema=_OUT)


def _same_as_before(batch: pa.RecordBatch, before: _Run | None) -> np.ndarray:
    """Whether each row's normalised text is that of the row before it."""
    digest, norm = batch.column("digest"), batch.column("norm")
    packed = np.frombuffer(b"".join(digest.to_pylist()), np.uint64).reshape(len(digest), -1)
    same = np.zeros(len(digest), bool)
    same[1:] = (packed[1:] == packed[:-1]).all(axis=1)
    for i in np.flatnonzero(same).tolist():
        same[i] = norm[i].as_buffer().equals(norm[i - 1].as_buffer())
    if before is not None and before.digest == digest[0].as_py():
        same[0] = before.norm.as_buffer().equals(norm[0].as_buffer())
    return same


def _inner(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """The rows of whole runs; ``starts`` are their first rows and the end of the last."""
    a, b = int(starts[0]), int(starts[-1])
    sizes = np.diff(starts)
    first = np.zeros(b - a, bool)
    first[starts[:-1] - a] = True
    ids = batch.column("id")
    cols = [
        ids.slice(a, b - a),
        batch.column("doc").slice(a, b - a),
        batch.column("digest").slice(a, b - a),
        ids.take(pa.array(np.repeat(starts[:-1], sizes))),
        pa.array(np.repeat(sizes, sizes)),
        pa.array(first),
    ]
    return pa.RecordBatch.from_arrays([*cols, *(pa.nulls(b - a, f.type) for f in list(_OUT)[6:])], schema=_OUT)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the row that stays and the size of their run, and the summaries of border runs."""
    part = TaskContext.get().partitionId()
    open_run: _Run | None = None
    at_start = True

    def closed(run: _Run, border: int | None) -> Iterator[pa.RecordBatch]:
        yield run.table(border)
        if border is not None:
            yield run.summary(border)

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(~_same_as_before(batch, open_run))
        ids, docs, n = batch.column("id"), batch.column("doc"), batch.num_rows
        goes_on = int(starts[0]) if len(starts) else n
        if open_run is not None:
            open_run.ids.append(ids.slice(0, goes_on))
            open_run.docs.append(docs.slice(0, goes_on))
        if not len(starts):
            continue
        if open_run is not None:
            yield from closed(open_run, 2 * part if at_start else None)
            at_start = False
        if at_start and len(starts) > 1:  # the task's first run ends in its first batch
            yield from closed(_begin(batch, int(starts[0]), int(starts[1])), 2 * part)
            at_start, starts = False, starts[1:]
        if len(starts) > 1:
            yield _inner(batch, starts)
        open_run = _begin(batch, int(starts[-1]), n)
    if open_run is not None:
        yield from closed(open_run, 2 * part + (not at_start))


def _begin(batch: pa.RecordBatch, a: int, b: int) -> _Run:
    value = {c: batch.column(c)[a] for c in ("digest", "norm", "shorter", "place", "id")}
    run = _Run(value["digest"].as_py(), value["norm"], value["shorter"].as_py(), value["place"].as_py(), value["id"].as_py())
    run.ids.append(batch.column("id").slice(a, b - a))
    run.docs.append(batch.column("doc").slice(a, b - a))
    return run


def exact_dedup(docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, doc)`` for each row of ``docs``;
    ``doc`` stands for the row, see :func:`~bridgerec.llm.staging.row_key`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.regexp_replace(text, r"[\x20\x09-\x0D]", "").cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        row_key(id_col, text_col).alias("doc"),
        (-F.char_length(text)).cast("long").alias("shorter"),
        F.monotonically_increasing_id().alias("place"),
        norm.alias("norm"),
    )
    rows = rows.withColumn("digest", F.unhex(F.sha2("norm", 256))).withColumn("head", F.substring("norm", 1, HEAD))
    last = [F.col("shorter"), F.col("id").asc_nulls_last(), F.col("place")]
    dealt = rows.repartitionByRange("head", "digest", *last).sortWithinPartitions("head", "digest", "norm", *last)
    found = dealt.select("id", "doc", "shorter", "place", "norm", "digest").mapInArrow(_runs, _DDL)
    found = stage.write(found, "runs")

    best = Window.partitionBy("digest", "norm").orderBy("shorter", F.col("keep_id").asc_nulls_last(), "place")
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = found.filter("norm is not null").select(
        F.col("border").alias("at"),
        F.first("keep_id").over(whole).alias("border_keep"),
        F.sum("size").over(whole).alias("border_size"),
        (F.row_number().over(best) == 1).alias("border_first"),
    )
    # at most two rows a task of the sort, of a few numbers each
    rows = found.filter("norm is null").join(F.broadcast(borders), F.col("border") == F.col("at"), "left")
    inner = F.col("at").isNull()
    return rows.select(
        F.col("id").alias(id_col),
        F.when(inner, F.col("keep_id")).otherwise(F.col("border_keep")).alias("keep_id"),
        F.when(inner, F.col("size")).otherwise(F.col("border_size")).alias("group_size"),
        (F.col("first") & (inner | F.col("border_first"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "doc",
    )


def drop_exact_copies(docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of each group of equal texts that :func:`exact_dedup` keeps,
    all columns as they were."""
    key, more = fresh_name(docs, "doc_key"), fresh_name(docs, "doc_copies")
    found = stage.write(exact_dedup(docs, stage, id_col, text_col), "found")
    stay = found.filter("kept").select(F.col("doc").alias(key))
    copies = found.groupBy(F.col("doc").alias(key)).agg(F.count("*").alias(more)).filter(F.col(more) > 1)
    few = stage.write(copies.join(stay, key, "left_semi").select(key), "twice")
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(stay, key, "left_semi")
    if not few.isEmpty():  # rows that agree in id and text are told apart by nothing: one of them stays
        few = maybe_broadcast(few)
        kept = kept.join(few, key, "left_anti").unionByName(kept.join(few, key, "left_semi").dropDuplicates([key]))
    return kept.drop(key)
