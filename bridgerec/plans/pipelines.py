"""End-to-end pipelines (the reference's experiment programs) and the
estimator queries that have no SQL oracle.

Every pipeline reads the driver tables, derives the rating tables once (written
to the checkpoint folder, so retries and later stages start from there), fits
its models with Spark ML / the gradient epochs, scores **only the test pairs**
(never the full user x item product) and returns a one-row metrics DataFrame.
Parameters default to the reference's values; ``solver="als"`` replaces the
sequential SGD loops (same count-weighted L2 objective, see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bridgerec.functions import vectors as V
from bridgerec.operators import cluster as C
from bridgerec.operators import factorize as FZ
from bridgerec.operators import metrics as M
from bridgerec.operators import similarity_transfer as ST
from bridgerec.operators import svd as SVD
from bridgerec.operators import transfer as TR
from bridgerec.plans import queries as Q
from bridgerec.session import materialize
from bridgerec.sources import ratings as R

KEYS = ["user_id", "item_id"]


def load(spark: SparkSession, sf_dir: str) -> R.CrossDomainData:
    """Derived rating tables, written once to the checkpoint folder: a pipeline runs
    many jobs over them."""
    return R.split_tables(materialize(R.load_cross_domain(spark, sf_dir).all))


def _report(pred: DataFrame, test: DataFrame, denominator: str) -> DataFrame:
    m = M.error_metrics(pred, test)
    col = "rmse_joined" if denominator == "joined" else "rmse_test_n"
    return m.select(F.col(col).alias("rmse"), "mae_test_n", "n_joined", "n_test")


# ----------------------------------------------------------- Q1, Q2


def lfm(d: R.CrossDomainData, rank=30, iters=20, lam=0.01, alpha=0.01, solver="als", als_iters=FZ.ALS_ITERS) -> DataFrame:
    """Single-domain latent-factor model; RMSE over joined rows."""
    m = FZ.fit_lfm(d.target_train, rank, iters, lam, solver, alpha, als_iters=als_iters)
    return _report(FZ.predict_pairs(d.target_test, m), d.target_test, "joined")


def biassvd(d: R.CrossDomainData, rank=50, iters=50, lam=0.01, alpha=0.01, solver="als", als_iters=FZ.ALS_ITERS) -> DataFrame:
    """Biased model mu + b_u + b_i + p.q; RMSE over joined rows, MAE over test rows."""
    m = FZ.fit_biased(d.target_train, rank, iters, lam, solver, alpha, als_iters=als_iters)
    return _report(FZ.predict_pairs(d.target_test, m), d.target_test, "joined")


# ---------------------------------------------------- cluster branch


def _cluster_branch(pooled: DataFrame, test: DataFrame, rank: int, k: int, iters: int = 20,
                    als_iters: int = FZ.ALS_ITERS, als_reg: float = 0.1, item_assign: str = "item", seed: int = 42) -> DataFrame:
    """ALS on the pooled ratings, KMeans on user and item factors, codebook of
    centre products, codebook value for every test pair with both clusters."""
    als = FZ.als_fit(pooled, rank, als_iters, als_reg, seed)
    users = materialize(als.users)
    items = materialize(als.items)
    ku = C.kmeans_fit(users, k, iters, seed)
    ki = C.kmeans_fit(items, k, iters, seed)
    ucl = C.kmeans_assign(users, ku)
    icl = C.kmeans_assign(items, ki if item_assign == "item" else ku)
    codebook = C.cluster_ratings(ku.centres, ki.centres)
    return TR.cluster_lookup(test, ucl, icl, codebook, clamp=False)


def pool_mix(d: R.CrossDomainData, rank=30, iters=100, lam=0.001, alpha=0.01, als_rank=30, k=35,
             weight=0.8, shift=0.0, solver="als", als_iters=FZ.ALS_ITERS, item_assign="item") -> DataFrame:
    """Pool source and target, factorise; mix with the cluster-codebook
    prediction; RMSE over the mixed (joined) rows.  ``weight`` is the one that the reference names (D12);
    with the 1 that it runs, the cluster branch would only restrict coverage."""
    pooled = materialize(R.pool(d.source, d.target_train, distinct=True))
    m = FZ.fit_lfm(pooled, rank, iters, lam, solver, alpha, als_iters=als_iters)
    p1 = FZ.predict_pairs(d.target_test, m)
    p2 = _cluster_branch(pooled, d.target_test, als_rank, k, item_assign=item_assign)
    mixed = TR.mix_predictions(p1, p2, weight, shift)
    return _report(mixed, d.target_test, "joined")


def blend(d: R.CrossDomainData, rank=15, iters=100, lam=0.001, alpha=0.01, a=0.5, k=30,
          weight=1.0, shift=1.2, solver="als", als_iters=FZ.ALS_ITERS, item_assign="item") -> DataFrame:
    """Factorise each domain, blend shared users' factors into the target,
    predict; mix with the pooled cluster branch."""
    ms = FZ.fit_lfm(d.source, rank, iters, lam, solver, alpha, als_iters=als_iters)
    mt = FZ.fit_lfm(d.target_train, rank, iters, lam, solver, alpha, als_iters=als_iters)
    users = TR.blend_factors(ms.users, mt.users, a)
    p1 = FZ.predict_pairs(d.target_test, FZ.FactorModel(users, mt.items, rank=rank))
    pooled = materialize(R.pool(d.source, d.target_train, distinct=True))
    p2 = _cluster_branch(pooled, d.target_test, rank, k, item_assign=item_assign)
    return _report(TR.mix_predictions(p1, p2, weight, shift), d.target_test, "joined")


# ---------------------------------------------------------- SVD based


def diag_codebook(d: R.CrossDomainData, k=10, rank=10, iters=100, lam=0.001, alpha=0.01, refine_iters=0,
                  solver="als", als_iters=FZ.ALS_ITERS) -> DataFrame:
    """Truncated SVD of the source; its singular values (optionally refined
    against one-hot memberships) rescale the target factors; prediction
    sum_k p_k d_k q_k / 100 capped at 5; RMSE over all test rows."""
    svd = FZ.truncated_svd(d.source, k, one_task=SVD.ONE_TASK)
    diag = svd.s
    if refine_iters > 0:
        u1 = svd.U.select("id", V.one_hot_argmax("features").alias("features"))
        v1 = svd.V.select("id", V.one_hot_blockmax("features").alias("features"))
        diag = TR.diag_refine(d.source, u1, v1, diag, refine_iters)
    if len(diag) != rank:
        raise ValueError(f"k = {len(diag)} singular values can't scale factors of rank {rank}")
    m = FZ.fit_lfm(d.target_train, rank, iters, lam, solver, alpha, als_iters=als_iters)
    p = TR.diag_predict(d.target_test, m.users, m.items, diag)
    p = p.select(*KEYS, V.scale_cap("prediction", 100.0, 5.0).alias("prediction"))
    return _report(p, d.target_test, "test")


def svd_transfer(d: R.CrossDomainData, k=30, target_matrix="target") -> DataFrame:
    """Source U with the target's singular values and V; running clamp over
    the factor terms; RMSE over all test rows.  ``target_matrix="source"``
    reproduces the reference, which decomposes the source matrix twice."""
    src = FZ.truncated_svd(d.source, k, one_task=SVD.ONE_TASK)
    tgt = FZ.truncated_svd(d.target_train if target_matrix == "target" else d.source, k, one_task=SVD.ONE_TASK)
    s = F.array(*[F.lit(x) for x in tgt.s])
    u = src.U.select(F.col("id").alias("user_id"), F.col("features").alias("_p"))
    v = tgt.V.select(F.col("id").alias("item_id"), F.col("features").alias("_q"))
    j = d.target_test.select(*KEYS).join(u, "user_id").join(v, "item_id")
    p = j.select(*KEYS, V.running_clamp(V.scaled_terms("_p", s, "_q")).alias("prediction"))
    return _report(p, d.target_test, "test")


# ------------------------------------------------------ cluster merge


def cluster_merge(d: R.CrossDomainData, rank=30, als_iters=FZ.ALS_ITERS, als_reg=0.001, k_source=150, k_target=75,
                  km_iters=20, cluster_rank=30, cluster_iters=70, cluster_lam=0.001, alpha=0.01,
                  solver="als", item_assign="item", seed=42) -> DataFrame:
    """Cluster each domain's ALS factors, merge the two codebooks (target ids
    moved by k_source), factorise the merged codebook with the biased model,
    and predict each test pair from its user and item cluster; asymmetric
    clamp; RMSE over joined rows."""
    fits = {}
    for name, ratings, k in (("s", d.source, k_source), ("t", d.target_train, k_target)):
        m = FZ.als_fit(ratings, rank, als_iters, als_reg, seed)
        users, items = materialize(m.users), materialize(m.items)
        ku, ki = C.kmeans_fit(users, k, km_iters, seed), C.kmeans_fit(items, k, km_iters, seed)
        fits[name] = (users, items, ku, ki)
    cbs = {n: C.cluster_ratings(f[2].centres, f[3].centres) for n, f in fits.items()}
    codebook = materialize(TR.merge_codebooks(cbs["s"], cbs["t"], k_source))
    cb_ratings = codebook.select(F.col("uc").alias("user_id"), F.col("ic").alias("item_id"), "rating")
    cm = FZ.fit_biased(cb_ratings, cluster_rank, cluster_iters, cluster_lam, solver, alpha, als_iters=als_iters)

    def members(name, side):
        users, items, ku, ki = fits[name]
        table = users if side == "user" else items
        model = ku if (side == "user" or item_assign == "user") else ki
        a = C.kmeans_assign(table, model)
        return TR.offset_clusters(a, k_source, cols=("cluster",)) if name == "t" else a

    ucl = TR.merge_memberships(members("s", "user"), members("t", "user"))
    icl = TR.merge_memberships(members("s", "item"), members("t", "item"))
    pairs = d.target_test.select(*KEYS).join(
        ucl.select(F.col("id").alias("user_id"), F.col("cluster").alias("uc")), "user_id"
    ).join(icl.select(F.col("id").alias("item_id"), F.col("cluster").alias("ic")), "item_id")
    scored = FZ.predict_pairs(pairs.select(F.col("uc").alias("user_id"), F.col("ic").alias("item_id")).distinct(), cm)
    p = pairs.join(
        scored.select(F.col("user_id").alias("uc"), F.col("item_id").alias("ic"), "prediction"), ["uc", "ic"]
    ).select(*KEYS, V.clamp_asym("prediction").alias("prediction"))
    return _report(p, d.target_test, "joined")


# ------------------------------------------------- similarity transfer


def similarity_transfer(d: R.CrossDomainData, rank=100, iters=70, lam=0.0001, alpha=0.01, sim_iters=5, neighbours=None,
                        items="fitted", item_lam=0.1, solver="als", als_iters=FZ.ALS_ITERS) -> DataFrame:
    """Factorise the source, factorise the binned similarities of all pairs of its users, predict the target's test
    pairs by these users' factors; RMSE over all test rows.  ``items="fitted"`` fits the target's items against the
    transferred users; ``items="own"`` takes them from a factorisation of the target by itself, as the reference
    does, whose factors have no common axes with the users'."""
    ms = FZ.fit_lfm(d.source, rank, iters, lam, solver, alpha, als_iters=als_iters)
    users = materialize(ST.similarity_factors(materialize(ms.users), rank, sim_iters, lam, neighbours))
    if items == "fitted":
        q = ST.fit_items(d.target_train, users, rank, item_lam)
    elif items == "own":
        q = FZ.fit_lfm(d.target_train, rank, iters, lam, solver, alpha, als_iters=als_iters).items
    else:
        raise ValueError(items)
    p = FZ.predict_pairs(d.target_test, FZ.FactorModel(users, q, rank=rank))
    return _report(p, d.target_test, "test")


# ------------------------------------------------------------ Q9 demo


def eval_demo(d: R.CrossDomainData, n=5, rank=10, lam=0.1) -> DataFrame:
    """Precision/recall at n of an ALS model's scores on the test pairs."""
    m = FZ.als_fit(d.target_train, rank, reg=lam)
    return M.precision_recall(FZ.predict_pairs(d.target_test, m), d.target_test, n)


# ------------------------------------------------- registered queries


def q_lfm(spark, sf_dir):
    return lfm(load(spark, sf_dir))


def q_biassvd(spark, sf_dir):
    return biassvd(load(spark, sf_dir))


def q_pool_mix(spark, sf_dir):
    return pool_mix(load(spark, sf_dir))


def q_blend(spark, sf_dir):
    return blend(load(spark, sf_dir))


def q_diag_codebook(spark, sf_dir):
    return diag_codebook(load(spark, sf_dir))


def q_svd_transfer(spark, sf_dir):
    return svd_transfer(load(spark, sf_dir))


def q_cluster_merge(spark, sf_dir):
    return cluster_merge(load(spark, sf_dir))


def q_similarity_transfer(spark, sf_dir):
    return similarity_transfer(load(spark, sf_dir))


def q_eval_demo(spark, sf_dir):
    return eval_demo(load(spark, sf_dir))


def _checked(report: DataFrame) -> DataFrame:
    return report.select(*[V.rounded(c).alias(c) for c in ("rmse", "mae_test_n")], "n_joined", "n_test")


def _gradient() -> dict:
    """Parameters of the checked programs: epochs from fixed factors, which DuckDB runs too."""
    return dict(rank=Q.EPOCH_RANK, iters=Q.PROGRAM_ITERS, alpha=Q.PROGRAM_ALPHA, lam=Q.EPOCH_LAMBDA, solver="gradient")


def lfm_program(spark, sf_dir):
    return _checked(lfm(load(spark, sf_dir), **_gradient()))


def biassvd_program(spark, sf_dir):
    return _checked(biassvd(load(spark, sf_dir), **_gradient()))


def pool_mix_program(spark, sf_dir):
    return _checked(pool_mix(load(spark, sf_dir), als_rank=Q.EPOCH_RANK, k=Q.BUCKETS, weight=1.0, als_iters=2, **_gradient()))


def blend_program(spark, sf_dir):
    return _checked(blend(load(spark, sf_dir), a=Q.BLEND_A, k=Q.BUCKETS, als_iters=2, **_gradient()))


def als_factors(spark, sf_dir):
    d = load(spark, sf_dir)
    return FZ.long_factors(FZ.als_fit(d.target_train, 10))


def als_predict(spark, sf_dir):
    d = load(spark, sf_dir)
    return FZ.predict_pairs(d.target_test, FZ.als_fit(d.target_train, 10))


def kmeans_assign(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")
    )
    return C.kmeans_assign(e, C.kmeans_fit(e, 10, 20))


def svd_factors(spark, sf_dir):
    d = load(spark, sf_dir)
    svd = FZ.truncated_svd(d.target_train, 8)
    u = svd.U.select(F.lit("U").alias("part"), "id", F.posexplode("features").alias("f", "value"))
    v = svd.V.select(F.lit("V").alias("part"), "id", F.posexplode("features").alias("f", "value"))
    s = spark.createDataFrame([("s", -1, i, x) for i, x in enumerate(svd.s)], "part string, id int, f int, value double")
    return u.unionByName(v).unionByName(s)


def svd_invariants(spark, sf_dir, tol=1e-6):
    """One row a triplet: whether u and v have length 1 and are orthogonal to the others, and
    A v = s u and A^T u = s v, to 2e-6."""
    k = 8
    d = load(spark, sf_dir)
    svd = FZ.truncated_svd(d.target_train, k, tol=tol)
    entries = d.target_train.select(F.col("user_id").alias("i"), F.col("item_id").alias("j"), F.col("rating").alias("v"))
    sums = []
    for own, other, out, back in ((svd.U, svd.V, "i", "j"), (svd.V, svd.U, "j", "i")):
        image = SVD.times(entries, other.select("id", F.col("features").alias("x")), out, back, k)
        both = own.join(image, "id")
        off = [F.sum(F.pow(F.col("x")[f] - F.lit(svd.s[f]) * F.col("features")[f], 2)).alias(f"{out}_off{f}") for f in range(k)]
        gram = [F.sum(F.col("features")[f] * F.col("features")[g]).alias(f"{out}_{f}_{g}") for f in range(k) for g in range(k)]
        sums.append(both.agg(*off, *gram))
    row = sums[0].crossJoin(sums[1])  # one row each
    small = F.lit(2e-6)

    def square(side: str, f: int):
        others = [F.abs(F.col(f"{side}_{f}_{g}")) for g in range(k) if g != f]
        return (F.abs(F.col(f"{side}_{f}_{f}") - 1) < small) & (F.greatest(*others) < small)

    cells = [
        F.struct(
            F.lit(f).alias("k"),
            square("i", f).alias("unit_u"),
            square("j", f).alias("unit_v"),
            (F.sqrt(f"i_off{f}") < small * F.lit(svd.s[0])).alias("fits"),
            (F.sqrt(f"j_off{f}") < small * F.lit(svd.s[0])).alias("fits_back"),
        )
        for f in range(k)
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def svd_energy(spark, sf_dir):
    """The singular values of the items' ratings added up over 16 groups of users: all 16 of
    them, whose squares add up to the squares of the entries, so none was missed."""
    groups = 16
    d = load(spark, sf_dir)
    pooled = d.target_train.groupBy((F.col("user_id") % groups).cast("int").alias("user_id"), "item_id").agg(F.sum("rating").alias("rating"))
    svd = FZ.truncated_svd(pooled, groups)
    return spark.createDataFrame([(len(svd.s), float(sum(x * x for x in svd.s)))], "n_values long, energy double").select(
        "n_values", F.round("energy", 2).alias("energy")
    )


def _solved(ratings: DataFrame, m: FZ.FactorModel, rank: int, reg: float) -> DataFrame:
    """(user_id, solved): whether each user's factors solve their normal equation given the items':
    sum q (q.p - r) + reg n p = 0, relative to sum |r q|."""
    j = ratings.join(m.users.select(F.col("id").alias("user_id"), F.col("features").alias("p")), "user_id")
    j = j.join(m.items.select(F.col("id").alias("item_id"), F.col("features").alias("q")), "item_id")
    e = V.dot("p", "q") - F.col("rating")
    term = F.zip_with("q", "p", lambda q, p: q * e + F.lit(reg) * p)
    scale = F.aggregate("q", F.lit(0.0), lambda a, x: a + F.abs(x * F.col("rating")))
    g = j.select("user_id", term.alias("t"), scale.alias("w")).groupBy("user_id").agg(
        *[F.sum(F.col("t")[f]).alias(f"t{f}") for f in range(rank)], F.sum("w").alias("w")
    )
    worst = F.greatest(*[F.abs(F.col(f"t{f}")) for f in range(rank)])
    return g.select("user_id", (worst <= F.lit(1e-3) * F.col("w")).alias("solved"))


def als_user_equations(spark, sf_dir):
    """Whether each user's ALS factors solve their normal equation given the items'."""
    rank, reg = 10, 0.1
    d = load(spark, sf_dir)
    return _solved(d.target_train, FZ.als_fit(d.target_train, rank, reg=reg), rank, reg)


def bias_als_equations(spark, sf_dir):
    """The users' biases of the biased model, and whether their factors solve the normal equation of what
    mean and biases leave of the ratings."""
    rank, reg = 10, 0.1
    d = load(spark, sf_dir)
    m = FZ.fit_biased_als(d.target_train, rank, reg=reg, bias_reg=Q.BIAS_REG)
    biases = [t.select(F.col("id").alias(key), F.col("bias").alias(f"{key}_bias")) for t, key in ((m.users, "user_id"), (m.items, "item_id"))]
    left = d.target_train.join(biases[0], "user_id").join(biases[1], "item_id")
    left = left.withColumn("rating", F.col("rating") - F.lit(m.mu) - F.col("user_id_bias") - F.col("item_id_bias"))
    solved = _solved(left.select("user_id", "item_id", "rating"), m, rank, reg)
    return solved.join(biases[0], "user_id").select("user_id", V.rounded("user_id_bias").alias("bias"), "solved")


def kmeans_nearest(spark, sf_dir):
    """Whether KMeans puts each vector to the nearest of its centres."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")
    )
    fit = C.kmeans_fit(e, 10, 20)
    near = C.assign(e, fit.centres).withColumnRenamed("cluster", "near")
    both = C.kmeans_assign(e, fit).join(near, "id")
    return both.select(F.col("id").alias("vec_id"), (F.col("cluster") == F.col("near")).alias("nearest"))


def registered():
    return {
        "als_factors": als_factors,
        "als_predict": als_predict,
        "kmeans_assign": kmeans_assign,
        "svd_factors": svd_factors,
        "svd_invariants": svd_invariants,
        "svd_energy": svd_energy,
        "als_user_equations": als_user_equations,
        "bias_als_equations": bias_als_equations,
        "kmeans_nearest": kmeans_nearest,
        "lfm_program": lfm_program,
        "biassvd_program": biassvd_program,
        "pool_mix_program": pool_mix_program,
        "blend_program": blend_program,
        "q_lfm": q_lfm,
        "q_biassvd": q_biassvd,
        "q_pool_mix": q_pool_mix,
        "q_blend": q_blend,
        "q_diag_codebook": q_diag_codebook,
        "q_svd_transfer": q_svd_transfer,
        "q_cluster_merge": q_cluster_merge,
        "q_similarity_transfer": q_similarity_transfer,
        "q_eval_demo": q_eval_demo,
    }
