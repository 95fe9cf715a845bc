"""Property tests for the estimators (no SQL oracle for these)."""

import time
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bridgerec.operators import cluster as C
from bridgerec.operators import factorize as FZ
from bridgerec.operators import svd as SVD
from bridgerec.plans import pipelines as P
from bridgerec.session import materialize, materialize_step, release
from conftest import ratings_df


def _lowrank(seed=0, users=40, items=30, rank=3, density=0.5):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(users, rank))
    q = rng.normal(size=(items, rank))
    rows = []
    for u in range(users):
        for i in range(items):
            if rng.random() < density:
                rows.append((u + 1, i + 1, float(3 + p[u] @ q[i] / 2)))
    return rows


def test_als_same_seed_repeats(spark):
    df = ratings_df(spark, _lowrank())
    a = FZ.als_fit(df, 3, 5, 0.1, seed=7).users.orderBy("id").collect()
    b = FZ.als_fit(df, 3, 5, 0.1, seed=7).users.orderBy("id").collect()
    assert [r["features"] for r in a] == [r["features"] for r in b]


def test_als_sends_vectors_to_few_blocks_and_more_only_for_more_ratings(spark, monkeypatch):
    df, seen = ratings_df(spark, _lowrank(density=1.0)), []
    set_blocks = FZ.ALS.setNumBlocks
    monkeypatch.setattr(FZ.ALS, "setNumBlocks", lambda self, n: seen.append(n) or set_blocks(self, n))
    for small, most in ((FZ.SMALL_RATINGS, FZ.BLOCK_RATINGS), (1000, FZ.BLOCK_RATINGS), (1000, 200)):
        monkeypatch.setattr(FZ, "SMALL_RATINGS", small)
        monkeypatch.setattr(FZ, "BLOCK_RATINGS", most)
        m = FZ.als_fit(df, 2, 1, 0.1)
        assert m.users.count() == 40 and m.items.count() == 30
    assert seen == [16, 4, 6]  # 1200 ratings


def _dense(df, res, rows, cols):
    a, u, v = np.zeros((rows, cols)), np.zeros((rows, len(res.s))), np.zeros((cols, len(res.s)))
    for r in df.collect():
        a[r["user_id"], r["item_id"]] += r["rating"]
    for r in res.U.collect():
        u[r["id"]] = r["features"]
    for r in res.V.collect():
        v[r["id"]] = r["features"]
    return a, u, np.array(res.s), v


def _check_svd(df, k, rows, cols, **options):
    res = FZ.truncated_svd(df, k, **options)
    a, u, s, v = _dense(df, res, rows, cols)
    assert s == pytest.approx(np.linalg.svd(a, compute_uv=False)[:k], rel=1e-6)
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-6 and np.abs(v.T @ v - np.eye(k)).max() < 1e-8
    assert np.abs(a @ v - u * s).max() < 1e-6 * s[0] and np.abs(a.T @ u - v * s).max() < 1e-6 * s[0]
    return res


def test_svd_of_a_low_rank_matrix(spark):
    df = ratings_df(spark, _lowrank(users=30, items=25, rank=4, density=0.6))
    _check_svd(df, 4, 31, 26)


def test_svd_of_a_flat_spectrum_needs_several_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(u, i, float(rng.integers(1, 6))) for u in range(150) for i in range(120) if rng.random() < 0.3]
    df = ratings_df(spark, rows)
    one = _check_svd(df, 6, 150, 120, block=8)
    two = FZ.truncated_svd(df.repartition(7), 6, block=8)
    assert two.s == pytest.approx(one.s, rel=1e-9)


def _size_bits(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length()


def test_steps_of_an_svd_have_no_more_tasks_than_packed_rows(spark, monkeypatch):
    key = "spark.sql.shuffle.partitions"
    seen, step, before = [], SVD.Entries.step, spark.conf.get(key)

    def counted(self, state, m, width):
        out = step(self, state, m, width)
        seen.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(SVD.Entries, "step", counted)
    rng = np.random.default_rng(4)
    rows = [(u, i, rng.random()) for u in range(30) for i in range(20) if rng.random() < 0.5]
    spark.conf.set(key, "40")
    try:
        FZ.truncated_svd(ratings_df(spark, rows), 2, block=4)
        assert spark.conf.get(key) == "40" and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    finally:
        spark.conf.set(key, before)
    assert set(seen) == {SVD.GROUPS}


def test_size_estimates_do_not_grow_with_the_steps_of_an_svd(spark, monkeypatch):
    seen, step = [], SVD.Entries.step
    monkeypatch.setattr(SVD.Entries, "step", lambda self, state, m, width: seen.append(_size_bits(state)) or step(self, state, m, width))
    rng = np.random.default_rng(2)
    rows = [(u, i, float(rng.normal())) for u in range(60) for i in range(50)]
    FZ.truncated_svd(ratings_df(spark, rows), 2, block=4)
    assert len(seen) > 3 and max(seen) <= 64, seen


def test_size_estimates_do_not_grow_with_the_gradient_epochs(spark):
    m = FZ.fit_gradient(ratings_df(spark, _lowrank(users=10, items=8)), 2, 4, alpha=0.05)
    assert _size_bits(m.users) <= 64 and _size_bits(m.items) <= 64
    assert m.users.count() == 10 and m.items.count() == 8


def test_svd_in_one_task_takes_no_jobs_a_step(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i * 3, j * 2, float(rng.integers(1, 6))) for i in range(90) for j in range(70) if rng.random() < 0.3]
    df = ratings_df(spark, rows)
    spread = FZ.truncated_svd(df, 5, block=8)
    monkeypatch.setattr(SVD.Entries, "step", None)
    here = _check_svd(df, 5, 268, 139, block=8, one_task=SVD.ONE_TASK)
    assert here.s == pytest.approx(spread.s, rel=1e-9)
    for a, b in ((here.U, spread.U), (here.V, spread.V)):
        x, y = (np.array([r.features for r in t.orderBy("id").collect()]) for t in (a, b))
        assert np.allclose(np.abs((x * y).sum(axis=0)), 1, atol=1e-6)  # up to the sign
    with pytest.raises(ValueError, match="no convergence"):
        FZ.truncated_svd(df, 3, block=4, max_iters=2, one_task=SVD.ONE_TASK)


def test_steps_of_an_svd_delete_their_files(spark, monkeypatch):
    """At most the start, a basis, a product and the next basis are kept at a time."""
    files, step = [], SVD.Entries.step

    def counted(self, state, m, width):
        folder = Path(spark.sparkContext._jvm.java.net.URI(spark.sparkContext.getCheckpointDir()).getPath())
        files.append({f.name for f in folder.iterdir()})
        return step(self, state, m, width)

    monkeypatch.setattr(SVD.Entries, "step", counted)
    rng = np.random.default_rng(8)
    rows = [(i, j, float(rng.integers(1, 6))) for i in range(80) for j in range(60) if rng.random() < 0.3]
    FZ.truncated_svd(ratings_df(spark, rows), 3, block=4)
    assert len(files) > 5 and all(len(later - files[0]) <= 1 for later in files[1:])


def test_svd_raises_instead_of_returning_less(spark):
    df = ratings_df(spark, [(1, 1, 1.0), (2, 1, 2.0), (1, 2, 2.0), (2, 2, 4.0)])  # rank 1
    assert len(FZ.truncated_svd(df, 1).s) == 1
    for k in (2, 3):
        with pytest.raises(ValueError):
            FZ.truncated_svd(df, k)
    rng = np.random.default_rng(8)
    rows = [(u, i, float(rng.normal())) for u in range(80) for i in range(60)]
    with pytest.raises(ValueError, match="convergence"):
        FZ.truncated_svd(ratings_df(spark, rows), 3, block=4, max_iters=2)


def test_svd_keeps_sparse_ids_and_adds_repeated_pairs(spark):
    rows = [(1, 1, 2.0), (3, 2, 1.0), (4, 1, 3.0), (7, 3, 4.0), (7, 1, 0.5), (7, 1, 0.5)]
    res = _check_svd(ratings_df(spark, rows), 2, 8, 4)
    assert sorted(r["id"] for r in res.U.collect()) == [1, 3, 4, 7]
    assert sorted(r["id"] for r in res.V.collect()) == [1, 2, 3]


def test_als_does_not_depend_on_the_partitions(spark):
    df = ratings_df(spark, _lowrank(seed=3))
    one, two = (
        {r["id"]: r["features"] for r in FZ.als_fit(df.repartition(n), 3, 8, 0.1, seed=7).users.collect()} for n in (2, 9)
    )
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-6) for k in one)


def test_kmeans_few_distinct_points(spark):
    df = spark.createDataFrame([(i, [0.0, 0.0] if i % 2 else [1.0, 1.0]) for i in range(10)], "id int, features array<double>")
    fit = C.kmeans_fit(df, 9, 10)
    assert fit.centres.count() <= 9
    a = {r["id"]: r["cluster"] for r in C.kmeans_assign(df, fit).collect()}
    assert len({a[i] for i in range(0, 10, 2)}) == 1 and len({a[i] for i in range(1, 10, 2)}) == 1
    assert a[0] != a[1]


def test_nearest_centre_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(50, 4))
    cen = rng.normal(size=(6, 4))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id int, features array<double>")
    centres = spark.createDataFrame([(c, [float(x) for x in cen[c]]) for c in range(6)], C.CENTRE_SCHEMA)
    got = {r["id"]: r["cluster"] for r in C.assign(df, centres).collect()}
    want = {i: int(np.argmin(((cen - p) ** 2).sum(axis=1))) for i, p in enumerate(pts)}
    assert got == want


def test_nearest_centre_tie_goes_to_smaller_id(spark):
    df = spark.createDataFrame([(0, [0.0])], "id int, features array<double>")
    centres = spark.createDataFrame([(4, [1.0]), (2, [-1.0])], C.CENTRE_SCHEMA)
    assert C.assign(df, centres).first()["cluster"] == 2


def test_many_centres_are_packed_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "PACK", 2)
    monkeypatch.setattr(C, "BROADCAST_PACKS", 1)
    test_nearest_centre_matches_brute_force(spark)
    test_nearest_centre_tie_goes_to_smaller_id(spark)


def test_cluster_ratings_of_equal_centres(spark):
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], C.CENTRE_SCHEMA)
    got = {(r["uc"], r["ic"]): r["rating"] for r in C.cluster_ratings(c, c).collect()}
    assert got == {(0, 0): 1.0, (0, 2): 0.0, (2, 0): 0.0, (2, 2): 4.0}


def test_hot_item_is_split_and_sums_stay_right(spark):
    rows = [(u, 1, float(u % 5 + 1)) for u in range(1, 300)] + [(u, u % 9 + 2, 3.0) for u in range(1, 300)]
    df = ratings_df(spark, rows)
    model = FZ.init_factors(df, 2)
    got = FZ.gradient_epoch(df, model, 0.01, 0.1, "sum")
    p = {r["id"]: np.array(r["features"]) for r in model.users.collect()}
    q = {r["id"]: np.array(r["features"]) for r in model.items.collect()}
    step = sum((r - p[u] @ q[i]) * p[u] - 0.1 * q[i] for u, i, r in rows if i == 1)
    new = {r["id"]: np.array(r["features"]) for r in got.items.collect()}
    assert np.allclose(new[1], q[1] + 0.01 * step)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lazy = FZ.gradient_epoch(df, model, 0.01, 0.1, "sum", checkpoint=False)
        plan = lazy.items._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [k for k in range(len(plan)) if plan.startswith("Join [item_id", k) or plan.startswith("Join [_salt", k)]
    assert "_salt" in plan and "hashpartitioning(side" in plan
    assert plan.index("hashpartitioning(side") < plan.index("_salt"), joins  # an exchange between the join and the sums


def test_gradient_training_error_falls(spark):
    df = ratings_df(spark, _lowrank(seed=1))

    def train_rmse(model):
        p = FZ.predict_pairs(df, model)
        return p.join(df, ["user_id", "item_id"]).select(
            F.sqrt(F.avg((F.col("prediction") - F.col("rating")) ** 2))
        ).first()[0]

    m1 = FZ.fit_gradient(df, 3, 1, alpha=0.01, lam=0.01, step="sum")
    m5 = FZ.fit_gradient(df, 3, 5, alpha=0.01, lam=0.01, step="sum")
    assert train_rmse(m5) < train_rmse(m1)


def test_biased_gradient_and_als_models(spark):
    df = ratings_df(spark, _lowrank(seed=2))
    mg = FZ.fit_biased(df, 3, 3, 0.01, solver="gradient", step="mean")
    ma = FZ.fit_biased(df, 3, 3, 0.1, solver="als", als_iters=5)
    for m in (mg, ma):
        assert m.biased and set(m.users.columns) == {"id", "features", "bias"}
        assert FZ.predict_pairs(df, m).count() == df.count()


def test_mean_step_stays_bounded_for_a_hot_user(spark):
    # one user holds most of the ratings: summed steps would blow up, mean steps do not
    rows = [(1, i, 5.0) for i in range(1, 400)] + [(u, 1, 1.0) for u in range(2, 20)]
    df = ratings_df(spark, rows)
    m = FZ.fit_gradient(df, 4, 3, alpha=0.5, lam=0.01, step="mean")
    mx = m.users.select(F.max(F.array_max(F.transform("features", lambda x: F.abs(x))))).first()[0]
    assert mx < 10


def test_predictions_can_be_limited(spark):
    df = ratings_df(spark, [(1, 1, 5.0), (2, 1, 1.0)])
    users = spark.createDataFrame([(1, [4.0]), (2, [-1.0])], "id int, features array<double>")
    items = spark.createDataFrame([(1, [2.0])], "id int, features array<double>")
    p = {r["user_id"]: r["prediction"] for r in FZ.predict_pairs(df, FZ.FactorModel(users, items), clamp=(1, 5)).collect()}
    assert p == {1: 5.0, 2: 1.0}


def test_svd_invariants_turn_false_for_a_loose_fit(spark):
    rows = P.svd_invariants(spark, "/root/testdata/sf0.001", tol=1e6).collect()
    assert not all(r["fits_back"] for r in rows)
    assert all(all(r) for r in P.svd_invariants(spark, "/root/testdata/sf0.001").drop("k").collect())


def test_svd_of_rows_too_long_for_a_group(spark, monkeypatch):
    monkeypatch.setattr(SVD, "GROUP_ENTRIES", 20)  # decided by the driver
    rng = np.random.default_rng(9)
    pairs = [(1, j) for j in range(60)] + [(i, j) for i in range(2, 40) for j in rng.choice(60, 6, replace=False).tolist()]
    _check_svd(ratings_df(spark, [(i, j, rng.integers(1, 6)) for i, j in pairs]), 3, 40, 60, block=5)


def test_a_group_multiplies_a_bounded_number_of_entries_at_a_time():
    rng = np.random.default_rng(3)
    n, columns, width = 300_000, 1_000, 24
    v, at, starts = rng.normal(size=n), rng.integers(0, columns, n).astype(np.int32), np.array([0, 200_000, 200_001, 262_144])
    x = rng.normal(size=(columns, width))
    data = {"at": at, "v": v, "starts": starts.astype(np.int64), "turn": np.argsort(at, kind="stable").astype(np.int64)}
    pack = pa.table({c: pa.array([d.tobytes()], pa.binary()) for c, d in data.items()})
    sent = pa.table({"blk": pa.array([1, 0], pa.int32()), "x": pa.array([x[400:].tobytes(), x[:400].tobytes()], pa.binary())})
    tracemalloc.start()
    y = SVD._product(pack, sent, width)[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = v[:, None] * x[at]
    assert np.allclose(y, np.add.reduceat(whole, starts, axis=0))
    assert peak < whole.nbytes  # it was twice that and more


def test_multiplying_moves_only_vectors(spark):
    df = ratings_df(spark, [(u, i, 1.0 + (u + i) % 3) for u in range(40) for i in range(30) if (u * i) % 3])
    a = df.selectExpr("user_id i", "item_id j", "rating v")
    SVD.ship_package(spark)
    entries = SVD.Entries(a, 8)
    state = SVD._start(a.selectExpr("j id").distinct(), 8, 4, 1).selectExpr("blk", "ids", "z x")
    plan = entries.step(state, 4, 4)._jdf.queryExecution().executedPlan().toString()
    for kept in ("lists", "to#"):  # the packed entries and what each group needs are not exchanged
        at = plan.index("Scan ExistingRDD[grp" if kept == "lists" else "Scan ExistingRDD[to")
        above = plan[:at].rstrip(" \n+-:").splitlines()[-2:]
        assert not any("Exchange" in line for line in above), above


def test_equation_check_fails_for_other_factors(spark):
    rng = np.random.default_rng(8)
    d = ratings_df(spark, [(u, i, float(rng.integers(1, 6))) for u in range(20) for i in range(15) if rng.random() < 0.6])
    m = FZ.als_fit(d, 3, 10, 0.1)
    assert [r.solved for r in P._solved(d, m, 3, 0.1).select("solved").distinct().collect()] == [True]
    m.users = m.users.select("id", F.transform("features", lambda x: x * 1.02).alias("features"))
    assert not any(r.solved for r in P._solved(d, m, 3, 0.1).collect())


def test_only_hot_items_are_copied_in_an_epoch(spark, monkeypatch):
    rows = [(u, 0, 1.0 + u % 5) for u in range(60)] + [(u, 1 + u % 6, 1.0 + u % 4) for u in range(60)]
    ratings = spark.createDataFrame(rows, "user_id int, item_id int, rating double")

    def factors():
        m = FZ.fit_gradient(ratings, 3, 2, 0.05, 0.01)
        return {(s, r.id): r.features for s, t in (("u", m.users), ("i", m.items)) for r in t.collect()}

    plain = factors()
    items = FZ.init_factors(ratings, 3).items.withColumnRenamed("id", "item_id")
    assert FZ._salted(ratings, items, FZ.hot_items(ratings))[1].count() == 7
    monkeypatch.setattr(FZ, "HOT_RATINGS", 20)
    rated, copies = FZ._salted(ratings, items, FZ.hot_items(ratings))
    assert copies.count() == FZ.SALTS + 6
    assert rated.filter("item_id = 0").select("_salt").distinct().count() > 4
    assert rated.join(copies, ["item_id", "_salt"]).count() == len(rows)
    salted = factors()
    assert plain.keys() == salted.keys()
    assert all(abs(a - b) < 1e-12 for k in plain for a, b in zip(plain[k], salted[k], strict=True))


def test_als_has_tasks_for_many_cores_and_keeps_few_shuffles(spark, monkeypatch):
    assert [FZ.als_blocks(n) for n in (14_400_000, 86_000_000, 480_000_000)] == [24, 24, 30]
    assert 16 <= FZ.als_blocks(FZ.SMALL_RATINGS + 1) <= 24
    seen, fit = [], FZ.ALS.fit
    monkeypatch.setattr(FZ.ALS, "fit", lambda self, data: seen.append(self.getCheckpointInterval()) or fit(self, data))
    FZ.als_fit(ratings_df(spark, _lowrank()), 2, 2)
    assert seen == [1]


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle")}


def test_shuffles_of_a_written_frame_leave_the_disks(spark):
    df = spark.range(1000).selectExpr("id % 7 as k", "id").repartition(5, "k").groupBy("k").agg(F.sum("id").alias("s"))
    before = _shuffle_files(spark)
    rows = {tuple(r) for r in materialize(df).collect()}
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and rows == {tuple(r) for r in df.collect()}


def test_released_frames_have_no_files(spark):
    for write in (materialize, materialize_step):
        df = write(spark.range(5))
        folder = Path(spark._jvm.java.net.URI(df._checkpoint).getPath())
        assert folder.exists()
        after = write(df.selectExpr("id + 1 as id"))
        release(df, df, spark.range(1))
        assert not folder.exists() and after.count() == 5
