"""Repeated passages by a sparse suffix array over words.

A passage is ``min_words`` or more consecutive words that also stand somewhere
else, in another text or the same one.

1. Of every window of ``min_words`` words the position of its smallest 16-word
   gram (the leftmost, if some are equal) is retained as a suffix.  Equal windows
   retain the same position, so no repeat is missed, and about one position in
   eighteen remains.
2. Grams are counted, adding up inside tasks before the shuffle.  Suffixes whose
   gram stands nowhere else are dropped; a Bloom filter of bounded size carries the
   repeated grams to the texts, and what it lets through wrongly only costs time.
3. A retained suffix is extended to the left and right by the windows that retain
   it.  Suffixes are sorted by gram, the windows of equal grams by hash and by place,
   and neighbours are compared: equal neighbours are a match, and the first of them
   is the first occurrence.
4. A gram that more than ``GROUP`` suffixes share is not sorted in one task: its
   windows are counted by hash, again adding up inside tasks first.
5. Matched windows are merged into the maximal passages of each text.

Words are runs of bytes other than space and 0x09-0x0D, compared without the case
of A-Z.  The first occurrence of a window is the one with the smallest id (null
ids last), then text, then position.

Defined cases: null texts and texts of fewer than ``min_words`` words hold no
passage; rows that agree in id and text repeat each other, share one result and
neither is later; equal ids with different texts are different documents; an empty
table gives an empty table; only the named columns are read, and ``drop_repeats``
returns every other column as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgerec.llm.blocks import row_blocks, text_bytes, whole_groups
from bridgerec.llm.chunk_table import ChunkTable
from bridgerec.llm.staging import Stage, fresh_name, maybe_broadcast, row_key, shuffle_partitions
from bridgerec.llm.word_hash import SPACED, window_hashes, words_of

#: Words of a gram whose hash selects positions.
GRAM = 16
#: Positions of one gram that are sorted together.
GROUP = 1 << 15

#: Bits of the Bloom filter for each repeated gram, and its largest size.
BITS_EACH, MOST_BITS = 16, 1 << 29


def owners(words: np.ndarray, counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``counts`` words, one after another in ``words``: the starts of
    all windows, the position each retains, and the hash of the gram there."""
    if len(words) < min_words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = window_hashes(words, GRAM)
    width, span = min_words - GRAM + 1, 1
    least, value = np.arange(len(grams)), grams

    def smaller(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(y < x, b, a), np.minimum(x, y)

    while span * 2 <= width:
        least, value = smaller(least[:-span], least[span:], value[:-span], value[span:])
        span *= 2
    n, skip = len(grams) - width + 1, width - span
    least, value = smaller(least[:n], least[skip : skip + n], value[:n], value[skip : skip + n])
    starts = np.arange(n)
    starts = starts[starts + min_words <= np.repeat(np.cumsum(counts), counts)[:n]]  # inside its own text
    return starts, least[starts], value[starts]


def _cells(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return grams & np.uint64(bits - 1), (grams >> np.uint64(29)) & np.uint64(bits - 1)


def _bloom(grams: DataFrame, stage: Stage, name: str) -> np.ndarray:
    """A Bloom filter, packed to bytes, of ``grams(gram)``.  The tasks' filters are written, as a
    task that both makes and merges them would run two Python workers."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * max(1, grams.count()) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for c in _cells(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(cells, (c >> np.uint64(3)).astype(np.int64), (1 << (c & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()])], names=["cells"])

    cells = stage.write(grams.mapInArrow(run, "cells binary"), name)
    whole = cells.rdd.map(lambda r: np.frombuffer(r[0], np.uint8)).treeReduce(np.bitwise_or, depth=3)
    stage.drop(name)
    return whole


def _held(bloom: np.ndarray, grams: np.ndarray) -> np.ndarray:
    out = np.ones(len(grams), bool)
    for c in _cells(grams, len(bloom) * 8):
        out &= (bloom[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, doc): doc stands for the row in all later tables."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("doc", row_key("id", "text"))


def _grams(rows: DataFrame, min_words: int) -> DataFrame:
    """(gram) of every retained position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ChunkTable.leave()
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in row_blocks(offsets):
                words, _, _, counts = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SPACED)
                _, owner, gram = owners(words, counts, min_words)
                first = np.ones(len(owner), bool)
                first[1:] = owner[1:] != owner[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64))], names=["gram"])

    return rows.select("text").mapInArrow(run, "gram long")


def _suffixes(rows: DataFrame, min_words: int, repeated: Broadcast, hot: Broadcast) -> DataFrame:
    """(gram, hot, id, doc, start, windows): the suffixes whose gram is repeated, with
    the hashes of the windows that retain them, which start at ``start`` and after."""
    names = ["gram", "hot", "id", "doc", "start", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ChunkTable.leave()
        for batch in batches:
            ids, docs = batch.column(0), batch.column(2)
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_blocks(offsets):
                words, _, _, counts = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SPACED)
                starts, owner, gram = owners(words, counts, min_words)
                keep = _held(repeated.value, gram)
                starts, owner, gram = starts[keep], owner[keep], gram[keep]
                if not len(starts):
                    continue
                first = np.ones(len(owner), bool)
                first[1:] = owner[1:] != owner[:-1]
                cuts = np.append(np.flatnonzero(first), len(owner))
                gram, begins = gram[first], np.cumsum(counts) - counts
                row = np.repeat(np.arange(a, b), counts)[owner[first]]
                keys = window_hashes(words, min_words)[starts]
                packed = pa.BinaryArray.from_buffers(
                    pa.binary(), len(gram), [None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(keys)]
                )
                cols = [
                    pa.array(gram.view(np.int64)),
                    pa.array(_held(hot.value, gram)),
                    ids.take(pa.array(row)),
                    docs.take(pa.array(row)),
                    pa.array((starts[first] - begins[row - a]).astype(np.int32)),
                    packed,
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, "gram long, hot boolean, id long, doc long, start int, windows binary")


def _matches(suffixes: DataFrame) -> DataFrame:
    """(id, doc, start, found, later): bit i of ``found`` tells that the window at
    start + i stands elsewhere too, of ``later`` that its first occurrence is elsewhere."""
    schema = "id long, doc long, start int, found long, later long"

    def flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of all windows, the row of each and its place in the row."""
        windows = table.column("windows").combine_chunks()
        size = pc.binary_length(windows).to_numpy().astype(np.int64) // 8
        keys = np.frombuffer(b"".join(windows.to_pylist()), np.uint64)
        return keys, np.repeat(np.arange(len(size)), size), np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ChunkTable.leave()
        for table, _ in whole_groups(batches, 1):
            yield compare(table)

    def compare(table: pa.Table) -> pa.RecordBatch:
        by_place = [("id", "ascending"), ("doc", "ascending"), ("start", "ascending")]  # null ids go last
        table = table.take(pc.sort_indices(table, by_place)).combine_chunks()
        keys, row, at = flat(table)
        order = np.argsort(keys, kind="stable")  # equal windows stay in the order of their places
        same = keys[order][1:] == keys[order][:-1]
        found, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        found[order[1:]] |= same
        found[order[:-1]] |= same
        doc, start = table.column("doc").to_numpy(), table.column("start").to_numpy()
        head = order[np.maximum.accumulate(np.where(np.append(False, same), 0, np.arange(len(order))))]
        later[order] = (doc[row[order]] != doc[row[head]]) | ((start[row] + at)[order] != (start[row] + at)[head])
        bit = np.uint64(1) << at.astype(np.uint64)
        masks = []
        for on in (found, later & found):
            mask = np.zeros(table.num_rows, np.uint64)
            np.bitwise_or.at(mask, row[on], bit[on])
            masks.append(mask)
        hit = pa.array(masks[0] != 0)
        cols = [table.column(c).combine_chunks() for c in ("id", "doc", "start")]
        cols += [pa.array(m.view(np.int64)) for m in masks]
        return pa.RecordBatch.from_arrays(cols, names=["id", "doc", "start", "found", "later"]).filter(hit)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys, row, at = flat(table)
            cols = [batch.column(i).take(pa.array(row)) for i in (2, 3)]
            cols += [pa.array((table.column("start").to_numpy()[row] + at).astype(np.int32)), pa.array(keys.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "doc", "start", "window"])

    parts = shuffle_partitions(suffixes.sparkSession)
    few = suffixes.filter("not hot").repartition(parts, "gram").sortWithinPartitions("gram")
    many = suffixes.filter("hot").mapInArrow(windows, "id long, doc long, start int, window long")
    here = F.struct(F.coalesce("id", F.lit(np.iinfo(np.int64).max)).alias("id"), "doc", "start")
    counted = many.groupBy("window").agg(F.count("*").alias("n"), F.min(here).alias("first")).filter("n > 1")
    one = F.lit(1).cast("long")
    counted = many.join(counted, "window").select(
        "id", "doc", "start", one.alias("found"), F.when(here != F.col("first"), one).otherwise(0).alias("later")
    )
    return few.mapInArrow(neighbours, schema).unionAll(counted)


def repeated_passages(
    docs: DataFrame, stage: Stage, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc, doc_id, repeated, later)`` for each document with a passage.

    ``repeated`` and ``later`` are arrays of ``(start, end)`` in words: the maximal
    runs covered by windows that stand elsewhere too, and by windows whose first
    occurrence is elsewhere.  ``doc`` stands for the row (see :func:`drop_repeats`).
    """
    if not GRAM <= min_words < GRAM + 64:  # a suffix's windows are the bits of a mask
        raise ValueError(f"min_words must be from {GRAM} to {GRAM + 63}")
    rows = _documents(docs, id_col, text_col)
    spark = docs.sparkSession
    counts = _grams(rows, min_words).groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1")
    counts = stage.write(counts, "grams")
    repeated = {"repeated": counts, "hot": counts.filter(F.col("m") > GROUP)}
    filters = [spark.sparkContext.broadcast(_bloom(c.select("gram"), stage, f"cells-{k}")) for k, c in repeated.items()]
    # written, so the texts are read once for cold and hot grams and no task runs two Python workers
    found = _matches(stage.write(_suffixes(rows, min_words, *filters), "suffixes"))
    by_doc = found.groupBy("doc").agg(
        F.min("id").alias("id"), F.collect_list(F.struct("start", "found", "later")).alias("at")
    )
    spans = "array<struct<start: int, end: int>>"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(starts: np.ndarray) -> list[dict]:
            if not len(starts):
                return []
            starts = np.unique(starts)
            cut = np.flatnonzero(starts[1:] > starts[:-1] + min_words) + 1
            return [{"start": int(p[0]), "end": int(p[-1]) + min_words} for p in np.split(starts, cut)]

        arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        bits = np.arange(min_words - GRAM + 1, dtype=np.uint64)
        for batch in batches:
            both: list[tuple] = []
            for start, *masks in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True):
                start = start.values.to_numpy().astype(np.int64)
                row = []
                for mask in masks:
                    on = (mask.values.to_numpy().view(np.uint64)[:, None] >> bits) & np.uint64(1) == 1
                    which, at = np.nonzero(on)
                    row.append(runs(start[which] + at))
                both.append(tuple(row))
            cols = [pa.array([x[k] for x in both], arrow) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc", id_col, "repeated", "later"])

    flat = by_doc.select("doc", "id", "at.start", "at.found", "at.later")
    return flat.mapInArrow(merge, f"doc long, {id_col} long, repeated {spans}, later {spans}")


def drop_repeats(
    docs: DataFrame, stage: Stage, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with every passage cut out of the texts where it is not the first
    occurrence.  The white space after a cut goes with it; all rows stay."""
    spans = stage.write(repeated_passages(docs, stage, min_words, id_col, text_col), "spans")
    stage.drop("suffixes")
    key, cuts = fresh_name(docs, "doc_key"), fresh_name(docs, "doc_cuts")
    spans = maybe_broadcast(spans.filter(F.size("later") > 0), "1 + size(later)").select(
        F.col("doc").alias(key), F.col("later").alias(cuts)
    )
    keyed = docs.withColumn(key, row_key(id_col, text_col)).join(spans, key, "left").drop(key)
    at = keyed.columns.index(text_col)
    out = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ChunkTable.leave()
        for batch in batches:
            texts, later = batch.column(at), batch.column(batch.num_columns - 1)
            hit = np.flatnonzero(~np.asarray(later.is_null()))
            new = texts.to_pylist()
            for k in hit.tolist():
                raw = new[k].encode()
                data = np.frombuffer(raw, np.uint8)
                _, starts, _, _ = words_of(data, np.array([0, len(data)]), SPACED)
                begins = np.append(starts, len(raw))
                parts, done = [], 0
                for span in later[k].as_py():
                    parts.append(raw[done : begins[span["start"]]])
                    done = int(begins[span["end"]])
                new[k] = (b"".join(parts) + raw[done:]).decode()
            cols = [pa.array(new, texts.type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return keyed.mapInArrow(cut, out)
