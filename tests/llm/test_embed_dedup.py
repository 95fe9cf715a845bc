"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
from brute import Union

from bridgerec.llm import embed_dedup as ed
from bridgerec.llm.staging import Stage


def check(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in enumerate(vectors)]
    got = ed.embedding_near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, class int"), Stage(spark, "t"))
    u, n = Union(len(vectors)), [0] * len(vectors)
    usable = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for a in usable:
        for b in usable:
            if a < b and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                    u.join(a, b)
                    n[a] += 1
                    n[b] += 1
    want = {(i, n[i], u.find(i), u.find(i) == i) for i in range(len(vectors))}
    assert {tuple(r) for r in got.collect()} == want
    return n


def clusters(seed, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(40):
        centre = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 6)):
            out.append((centre + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.1])).astype(np.float32).tolist())
    return out


def test_clusters(spark):
    assert sum(check(spark, clusters(7))) > 20


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(ed, "TILE", 3)
    monkeypatch.setattr(ed, "BUCKET", 1000)
    check(spark, clusters(8))


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    check(
        spark,
        [None, [], [0, 0], [0, -0.0], [1, None], [1, nan], [inf, 1], [1, 1], [2, 2], [1, 1], [1, 1, 0], [1e300, 1e300], [1e-300, 1e-300],
         [-1, -1], [1, 1.5], [0.0, 1], [-0.0, 1]],
    )


def test_null_ids_and_empty_table(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [5.0, 5.0]), (4, [5.0, 5.0]), (None, [9.0, -9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in ed.embedding_near_dups(vectors, Stage(spark, "t")).collect()), key=str)
    assert got == sorted([(4, 1, 4, True)] * 2 + [(None, 0, None, True)] + [(None, 1, None, True)] * 2, key=str)
    assert ed.embedding_near_dups(vectors.limit(0), Stage(spark, "t")).count() == 0


def test_recall_at_the_threshold():
    """Pairs exactly at the threshold share a bucket of some table."""
    rng = np.random.default_rng(9)
    for n in (500, 50_000, 10_000_000):
        bits, tables = ed.plan(n, 0.95)
        x = rng.standard_normal((400, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((400, 64))
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        planes = ed._planes(64, bits, tables)
        same = ((x @ planes > 0) == (y @ planes > 0)).reshape(400, tables, bits).all(axis=2).any(axis=1)
        assert same.mean() >= 0.99
