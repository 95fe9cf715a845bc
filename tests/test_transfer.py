"""Transfer operators: brute-force checks on small inputs and a planted
low-rank cross-domain data set where transfer must beat the mean."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bridgerec.operators import factorize as FZ
from bridgerec.operators import metrics as M
from bridgerec.operators import transfer as TR
from bridgerec.plans import pipelines as P
from bridgerec.sources import ratings as R
from conftest import ratings_df


def test_binned_similarity(spark):
    df = spark.createDataFrame([(1, 2, 0.0), (1, 3, -1.0), (2, 3, 0.0)], "u1 int, u2 int, sim double")
    out = {(r["u1"], r["u2"]): r["sim"] for r in TR.bin_similarity(df).collect()}
    # min -1, max 0, interval 0.4: -1 -> 1, 0 -> 3
    assert out == {(1, 2): 3.0, (1, 3): 1.0, (2, 3): 3.0}
    assert TR.bin_similarity(df.limit(0)).count() == 0


def test_blend_only_shared_ids(spark):
    s = spark.createDataFrame([(1, [1.0, 1.0]), (9, [5.0, 5.0])], "id int, features array<double>")
    t = spark.createDataFrame([(1, [3.0, 3.0]), (2, [7.0, 7.0])], "id int, features array<double>")
    out = {r["id"]: r["features"] for r in TR.blend_factors(s, t, 0.5).collect()}
    assert out == {1: [2.0, 2.0], 2: [7.0, 7.0]}


def test_mix_is_inner_join(spark):
    a = ratings_df(spark, [(1, 1, 2.0), (1, 2, 3.0)]).withColumnRenamed("rating", "prediction")
    b = ratings_df(spark, [(1, 1, 4.0)]).withColumnRenamed("rating", "prediction")
    out = TR.mix_predictions(a, b, 0.8, 1.2).collect()
    assert len(out) == 1 and out[0]["prediction"] == pytest.approx(0.8 * 2 + 0.2 * 5.2)


def test_merge_memberships_target_wins(spark):
    s = spark.createDataFrame([(1, 0), (2, 1)], "id int, cluster int")
    t = spark.createDataFrame([(1, 5)], "id int, cluster int")
    out = {r["id"]: r["cluster"] for r in TR.merge_memberships(s, t).collect()}
    assert out == {1: 5, 2: 1}


def test_cluster_lookup_drops_unclustered_and_clamps(spark):
    pairs = ratings_df(spark, [(1, 1, 0.0), (1, 2, 0.0), (3, 1, 0.0)])
    uc = spark.createDataFrame([(1, 0)], "id int, cluster int")
    ic = spark.createDataFrame([(1, 0), (2, 1)], "id int, cluster int")
    cb = spark.createDataFrame([(0, 0, -0.2), (0, 1, 0.5)], "uc int, ic int, rating double")
    out = {(r["user_id"], r["item_id"]): r["prediction"] for r in TR.cluster_lookup(pairs, uc, ic, cb).collect()}
    assert out == {(1, 1): 1.0, (1, 2): 0.5}


def test_merge_codebooks_offsets_target(spark):
    s = spark.createDataFrame([(0, 0, 1.0)], "uc int, ic int, rating double")
    t = spark.createDataFrame([(0, 1, 2.0)], "uc int, ic int, rating double")
    out = sorted(tuple(r) for r in TR.merge_codebooks(s, t, 150).collect())
    assert out == [(0, 0, 1.0), (150, 151, 2.0)]


def test_diag_refine_moves_towards_fit(spark):
    ratings = ratings_df(spark, [(1, 1, 4.0), (2, 2, 2.0)])
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, features array<double>")
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, features array<double>")
    d = TR.diag_refine(ratings, users, items, [1.0, 1.0], iters=3, alpha=0.1, lam=0.0)
    assert d[0] > 1.0 and d[1] > 1.0


def _planted(spark, seed=11, users=60, items_s=40, items_t=40, rank=3):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(users, rank))
    qs = rng.normal(size=(items_s, rank))
    qt = rng.normal(size=(items_t, rank))
    src, train, test = [], [], []
    for u in range(users):
        for i in range(items_s):
            if rng.random() < 0.6:
                src.append((u, 2 * i, float(np.clip(3 + p[u] @ qs[i] + rng.normal(0, 0.1), 1, 5))))
        for i in range(items_t):
            r = float(np.clip(3 + p[u] @ qt[i] + rng.normal(0, 0.1), 1, 5))
            x = rng.random()
            if x < 0.25:
                train.append((u, 2 * i + 1, r))
            elif x < 0.45:
                test.append((u, 2 * i + 1, r))
    return R.CrossDomainData(
        all=ratings_df(spark, src + train + test),
        source=ratings_df(spark, src),
        target_train=ratings_df(spark, train),
        target_test=ratings_df(spark, test),
    )


def _mean_rmse(d):
    mu = d.target_train.agg(F.avg("rating")).first()[0]
    return d.target_test.select(F.sqrt(F.avg((F.col("rating") - F.lit(mu)) ** 2))).first()[0]


def test_planted_pool_beats_mean(spark):
    d = _planted(spark)
    base = _mean_rmse(d)
    pooled = R.pool(d.source, d.target_train)
    m = FZ.als_fit(pooled, 3, 15, 0.05)
    rmse = M.rmse(FZ.predict_pairs(d.target_test, m), d.target_test).first()["rmse"]
    assert rmse < 0.8 * base


def test_planted_blend_pipeline_beats_mean(spark):
    d = _planted(spark)
    base = _mean_rmse(d)
    r = P.blend(d, rank=3, k=4, shift=0.0, als_iters=15, lam=0.05).first()
    assert r["rmse"] < base and r["n_joined"] > 0


def test_planted_cluster_merge_runs(spark):
    d = _planted(spark)
    r = P.cluster_merge(d, rank=3, als_iters=5, k_source=5, k_target=4, cluster_rank=3).first()
    assert r["n_joined"] > 0 and not math.isnan(r["rmse"])


def test_planted_svd_pipelines_run(spark):
    d = _planted(spark)
    assert P.diag_codebook(d, k=3, rank=3, als_iters=5).first()["n_test"] == d.target_test.count()
    assert P.diag_codebook(d, k=3, rank=3, als_iters=5, refine_iters=2).first()["n_test"] > 0
    assert P.svd_transfer(d, k=3).first()["n_joined"] > 0


def test_reference_flags(spark):
    d = _planted(spark)
    r1 = P.svd_transfer(d, k=3, target_matrix="source").first()
    assert r1["n_test"] == d.target_test.count()
    r2 = P.pool_mix(d, rank=3, als_rank=3, k=4, als_iters=5, item_assign="user").first()
    assert r2["n_joined"] > 0


def test_diagonal_is_solved_exactly(spark):
    rng = np.random.default_rng(2)
    u, v, true = rng.random((30, 4)), rng.random((25, 4)), np.array([4.0, 3.0, 2.0, 1.0])
    rows = [(i, j, float((u[i] * v[j]) @ true)) for i in range(30) for j in range(25) if (i + j) % 3]
    users, items = (
        spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(m)], "id int, features array<double>") for m in (u, v)
    )
    ratings = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    assert np.allclose(TR.diag_solve(ratings, users, items, 4, 0.0), true)
    lam = 0.1
    d = np.array(TR.diag_solve(ratings, users, items, 4, lam))
    x = np.array([u[i] * v[j] for i, j, _ in rows])
    r = np.array([r for _, _, r in rows])
    assert np.abs(x.T @ (x @ d - r) / len(r) + lam * d).max() < 1e-9
    assert TR.diag_solve(ratings.limit(0), users, items, 4, lam) == [0.0] * 4


def test_cluster_branch_counts_in_pool_mix(spark, monkeypatch):
    """The codebook's predictions are in the mixed rating, not only their coverage."""
    d = _planted(spark)
    pairs = d.target_test.select("user_id", "item_id")
    for name, value in (("als", 3.0), ("cluster", 1.0)):
        fixed = pairs.withColumn("prediction", F.lit(value))
        if name == "als":
            monkeypatch.setattr(FZ, "predict_pairs", lambda *args, fixed=fixed: fixed)
        else:
            monkeypatch.setattr(P, "_cluster_branch", lambda *args, fixed=fixed, **kwargs: fixed)
    r = P.pool_mix(d, rank=2, als_iters=1).first()
    expect = d.target_test.select(F.avg(F.abs(F.col("rating") - F.lit(0.8 * 3.0 + 0.2 * 1.0)))).first()[0]
    assert r["mae_test_n"] == pytest.approx(expect)
