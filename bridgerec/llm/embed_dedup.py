"""Near duplicates of embeddings by random-hyperplane hashing.

A vector's bucket in a table is the signs of its products with some random
hyperplanes.  The number of planes follows from the number of vectors, so that a
bucket of unrelated vectors stays small, and the number of tables from the chance
``MISS`` that a pair exactly at the threshold shares no bucket.  Vectors of a bucket
are compared exactly, by cosine in double precision; a pair is counted in the first
table in which it meets.  Equal vectors are one class with a count from the start.

Buckets over ``TILE`` classes fall into blocks, whose pairs go to different tasks.  A
tile hands on only a count of links a class and the edges of a spanning forest, never
its pairs; components are those of the forests.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, not even with each other; vectors of different lengths
do not link; repeated rows are vectors of their own and link with each other; null ids
are kept but never name a component unless it has no other; an empty table gives an
empty table; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgerec.llm.blocks import whole_groups
from bridgerec.llm.components import connected_components
from bridgerec.llm.staging import Stage, shuffle_partitions

#: The chance to miss a pair exactly at the threshold.
MISS = 0.0005
#: Unrelated vectors that share a bucket, about; classes of a bucket that one tile compares.
BUCKET, TILE = 32, 1024
SEED = 20


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Planes of a table and number of tables for ``n`` vectors."""
    bits = min(31, max(4, math.ceil(math.log2(max(2, n) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


@lru_cache(maxsize=4)
def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _signed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(class, dim, mult, vector, buckets) of the classes, vectors as packed doubles of
    largest component 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v.values.to_numpy()) for v in batch.column(2)]
            dims = np.array([len(v) for v in vectors], np.int32)
            buckets: list = [None] * len(vectors)
            packed: list = [None] * len(vectors)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.stack([vectors[i] for i in at])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                signs = (x @ _planes(dim, bits, tables) > 0).reshape(len(at), tables, bits)
                codes = (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                for i, v, c in zip(at.tolist(), x, codes, strict=True):
                    packed[i], buckets[i] = v.tobytes(), c
            cols = [pa.array(dims), batch.column(1), pa.array(packed, pa.binary()), pa.array(buckets, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *cols], names=["class", "dim", "mult", "vector", "buckets"]
            )

    return classes.select("class", "mult", "v").mapInArrow(
        run, "class long, dim int, mult long, vector binary, buckets array<int>"
    )


def _labels(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row reaches in a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(signed: DataFrame, threshold: float) -> DataFrame:
    """(class, other, n): links of a class counted in a tile, and a class that it is linked to."""
    placed = signed.select("class", "dim", "mult", "vector", "buckets", F.posexplode("buckets").alias("t", "bucket"))
    sizes = signed.select("dim", F.posexplode("buckets").alias("t", "bucket")).groupBy("dim", "t", "bucket").agg(F.count("*").alias("m"))
    sizes = sizes.filter("m > 1").withColumn("k", F.ceil(F.col("m") / TILE).cast("int")).drop("m")
    rows = placed.join(sizes, ["dim", "t", "bucket"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    keys = ["dim", "t", "bucket", "i", "j"]
    rows = rows.select(
        "dim", "t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "class", "mult", "vector", "buckets",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, len(keys)):
            dim, t, i, j = (table.column(c).to_numpy() for c in ("dim", "t", "i", "j"))
            own, cls, mult = (table.column(c).to_numpy() for c in ("own", "class", "mult"))
            buckets = table.column("buckets").combine_chunks().values.to_numpy().reshape(len(own), -1)
            vectors = table.column("vector").combine_chunks()
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                x = np.frombuffer(b"".join(vectors.slice(a, b - a).to_pylist())).reshape(b - a, dim[a])
                size = np.sqrt((x * x).sum(axis=1))
                linked = (x @ x.T) / (size[:, None] * size[None, :]) >= threshold
                np.fill_diagonal(linked, False)
                if i[a] != j[a]:  # pairs inside a block have a tile of their own
                    linked &= own[a:b, None] != own[None, a:b]
                one, two = np.nonzero(np.triu(linked))
                for k in range(0, len(one), 1 << 16):
                    x1, x2 = one[k : k + (1 << 16)], two[k : k + (1 << 16)]
                    before = (buckets[a + x1, : t[a]] == buckets[a + x2, : t[a]]).any(axis=1)  # met in an earlier table
                    linked[x1[before], x2[before]] = linked[x2[before], x1[before]] = False
                hit = np.flatnonzero(linked.any(axis=1))
                if len(hit):
                    part = linked[np.ix_(hit, hit)]
                    here = cls[a:b][hit]
                    out.append((here, here[_labels(part)], part @ mult[a:b][hit]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["class", "other", "n"])

    parts = shuffle_partitions(signed.sparkSession)
    tiles = rows.repartition(parts, *keys).sortWithinPartitions(*keys)
    return tiles.mapInArrow(run, "class long, other long, n long")


def embedding_near_dups(
    vectors: DataFrame, stage: Stage, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: other vectors with a cosine of at
    least ``threshold``, the smallest id that links lead to, and whether it is its own."""
    v = F.transform(F.col(vector_col), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    usable = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).withColumn("class", F.when(usable, F.xxhash64("v")))
    classes = rows.filter("class is not null").groupBy("class").agg(
        F.min("id").alias("first"), F.count("*").alias("mult"), F.any_value("v").alias("v")
    )
    classes = stage.write(classes, "classes")
    signed = stage.write(_signed(classes, *plan(classes.count(), threshold)), "signed")
    found = stage.write(_compared(signed, threshold), "found")
    links = found.groupBy("class").agg(F.sum("n").alias("others"))
    linked = connected_components(found.select(F.col("class").alias("a"), F.col("other").alias("b")), stage)
    named = classes.select("class", "first", "mult").join(links, "class", "left")
    named = named.join(linked.toDF("class", "linked"), "class", "left").withColumn("linked", F.coalesce("linked", "class"))
    least = named.groupBy("linked").agg(F.min("first").alias("component"))
    named = named.join(least, "linked").select("class", (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n"), "component")
    component = F.coalesce("component", "id")
    return rows.select("id", "class").join(named, "class", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
