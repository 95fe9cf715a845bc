"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

They read the driver tables (``orders``, ``lineitem``, ``embeddings``) whole
and derive everything else with Spark.  Factor tables in the checked queries
are the deterministic stand-ins of ``vectors.deterministic_factors`` so that
DuckDB can recompute them; estimators (ALS, KMeans, SVD) are checked by row
counts and by the property tests.  Floating results are rounded to 6 digits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bridgerec.functions import vectors as V
from bridgerec.operators import cluster as C
from bridgerec.operators import factorize as FZ
from bridgerec.operators import metrics as M
from bridgerec.operators import pair_bins as PB
from bridgerec.operators import retrieval as RT
from bridgerec.operators import sequential as SQ
from bridgerec.operators import similarity as SM
from bridgerec.operators import similarity_transfer as ST
from bridgerec.operators import transfer as TR
from bridgerec.session import ensure_checkpoint_dir, materialize
from bridgerec.sources import ratings as R

KEYS = ["user_id", "item_id"]
r6 = V.rounded

# Fixed parameters of the checked queries.
RANK = 8  # deterministic factor length for prediction queries
EPOCH_RANK = 4  # factor length for the gradient-epoch queries
BIAS_REG = 10.0  # shrinkage of the bias baseline
DIAG = [600.0, 500.0, 400.0, 300.0, 200.0, 100.0, 50.0, 25.0]  # diagonal of P5/P6
CAP_SCALE = 15.0  # divisor at which some predictions pass the cap and some do not
CLAMP_SCALE, CLAMP_SHIFT = 24.0, 3.0  # reaches below 0, 0..1, 1..5 and above 5
SIGNED_DIAG = [30.0, -25.0, 20.0, -15.0, 10.0, -5.0, 3.0, -1.0]  # terms of the running clamp
TOP_N = 5
BLEND_A = 0.5
MIX_W, MIX_SHIFT = 0.8, 1.2
REFINE_ALPHA, REFINE_LAMBDA = 0.001, 0.1
EPOCH_ALPHA, EPOCH_LAMBDA, EPOCH_DECAY = 0.01, 0.01, 0.9
PROGRAM_ITERS, PROGRAM_ALPHA = 2, 0.5  # epochs and step of the checked programs
SIM_ALPHA = 10.0  # step of the similarity factors, at which a few neighbours show in six digits
BUCKETS = 5  # rating-level clusters (floor of the mean rating, 1..5)


def _data(spark: SparkSession, sf_dir: str, reuse: bool = True) -> R.CrossDomainData:
    """Rating tables of ``sf_dir``.  With ``reuse`` the branches of the query (train,
    test, coverage variants) share one lazy cache of the orders x lineitem derivation;
    building a query runs nothing."""
    d = R.load_cross_domain(spark, sf_dir)
    return R.reused(d) if reuse else d


def _long(df: DataFrame, side: str, col: str = "features") -> DataFrame:
    return df.select(F.lit(side).alias("side"), "id", F.posexplode(col).alias("f", "value")).select(
        "side", "id", "f", r6("value").alias("value")
    )


# ------------------------------------------------------------- data


def ratings_dedupe(spark, sf_dir):
    d = _data(spark, sf_dir, reuse=False)
    return d.all.select(*KEYS, r6("rating").alias("rating"), "domain", "split")


def split_counts(spark, sf_dir):
    d = _data(spark, sf_dir, reuse=False)
    return d.all.groupBy("domain", "split").agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
        r6(F.avg("rating")).alias("avg_rating"),
    )


def global_mean(spark, sf_dir):
    t = R.named_table(_data(spark, sf_dir, reuse=False).all)
    return t.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("rating")).alias("mu"))


def matrix_dims(spark, sf_dir):
    t = R.named_table(_data(spark, sf_dir, reuse=False).all)
    return t.groupBy("table_name").agg(
        (F.max("user_id") + 1).alias("n_rows"),
        (F.max("item_id") + 1).alias("n_cols"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
    )


def preview_ratings(spark, sf_dir):
    d = _data(spark, sf_dir, reuse=False)
    return M.preview(d.target_test).select(*KEYS, r6("rating").alias("rating"))


def _lines(ratings: DataFrame, sep: str, *more: str) -> DataFrame:
    fields = [F.col(c).cast("string") for c in (*KEYS, "rating")] + [F.lit(x) for x in more]
    return ratings.select(F.concat_ws(sep, *fields).alias("value"))


def parse_tab(spark, sf_dir):
    """The target ratings written as tab lines with a fourth field and parsed again."""
    d = _data(spark, sf_dir, reuse=False)
    return R.parse_ratings(_lines(d.target_train, "\t", "881250949"), "\t").select(*KEYS, r6("rating").alias("rating"))


def parse_comma(spark, sf_dir):
    d = _data(spark, sf_dir, reuse=False)
    return R.parse_ratings(_lines(d.source, ",", "x", "y"), ",").select(*KEYS, r6("rating").alias("rating"))


def parse_strict(spark, sf_dir):
    d = _data(spark, sf_dir, reuse=False)
    return R.parse_ratings(_lines(d.target_test, ","), ",", strict=True).select(*KEYS, r6("rating").alias("rating"))


def last_rating_wins(spark, sf_dir):
    """Every line item as a line of a text file, in order; of a pair's lines the last one counts."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    od = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rating = (F.lit(1) + F.col("l_quantity").cast("bigint") % F.lit(5)).cast("double")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    tasks = R.tasks_of(R.lines_of(li), spark)
    rows = R.join_by(li.select(*order), od.select("o_orderkey", "o_custkey"), ("l_orderkey", "o_orderkey"), tasks)
    rows = rows.orderBy(*order) if tasks is None else rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rating-lines-{uuid.uuid4().hex}"
    rows.select(F.concat_ws("\t", "o_custkey", "l_partkey", rating).alias("value")).write.text(path)
    return R.last_arrival(R.read_arrivals(spark, path), tasks).select(*KEYS, r6("rating").alias("rating"))


def pool_distinct(spark, sf_dir):
    """Source ratings pooled with all train ratings: the source's train part is in both."""
    d = _data(spark, sf_dir)
    train = d.all.where(F.col("split") == "train")
    return R.pool(d.source, train, distinct=True).select(*KEYS, r6("rating").alias("rating"))


def pool_all(spark, sf_dir):
    d = _data(spark, sf_dir)
    s = d.source.select(F.lit("source").alias("domain"), *KEYS, "rating")
    t = d.target_train.select(F.lit("target").alias("domain"), *KEYS, "rating")
    return s.unionByName(t).select("domain", *KEYS, r6("rating").alias("rating"))


def user_overlap(spark, sf_dir):
    d = _data(spark, sf_dir)
    s = d.partial_overlap_source().select("user_id", F.lit(1).alias("in_s"), F.lit(0).alias("in_t"))
    t = d.partial_coverage_train().select("user_id", F.lit(0).alias("in_s"), F.lit(1).alias("in_t"))
    flags = s.unionByName(t).groupBy("user_id").agg(F.max("in_s").alias("s"), F.max("in_t").alias("t"))
    cat = (
        F.when((F.col("s") == 1) & (F.col("t") == 1), F.lit("shared"))
        .when(F.col("s") == 1, F.lit("source_only"))
        .otherwise(F.lit("target_only"))
    )
    return flags.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("n_users"))


def coverage_pairs(spark, sf_dir):
    d = _data(spark, sf_dir)
    return M.covered_pairs(d.target_test, d.partial_coverage_train()).select(*KEYS, r6("rating").alias("rating"))


def covered_pair_count(spark, sf_dir):
    d = _data(spark, sf_dir)
    return M.distinct_pairs(M.covered_pairs(d.target_test, d.partial_coverage_train()))


# ------------------------------------------------------ predictions


def _det_model(train: DataFrame, rank: int = RANK, bias: bool = False) -> FZ.FactorModel:
    m = FZ.init_factors(train, rank)
    if not bias:
        return m
    mu, bu, bi = FZ.fit_bias_baseline(train, BIAS_REG)
    users = m.users.join(bu, "id", "left").select("id", "features", F.coalesce("bias", F.lit(0.0)).alias("bias"))
    items = m.items.join(bi, "id", "left").select("id", "features", F.coalesce("bias", F.lit(0.0)).alias("bias"))
    return FZ.FactorModel(users, items, mu, rank)


def _biased_predictions(d: R.CrossDomainData, train: DataFrame) -> DataFrame:
    return FZ.predict_pairs(d.target_test, _det_model(train, bias=True))


def pred_dot(spark, sf_dir):
    d = _data(spark, sf_dir)
    p = FZ.predict_pairs(d.target_test, _det_model(d.target_train))
    return p.select(*KEYS, r6("prediction").alias("prediction"))


def pred_biased(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _biased_predictions(d, d.target_train).select(*KEYS, r6("prediction").alias("prediction"))


def _diag_pred(d: R.CrossDomainData, diag) -> DataFrame:
    m = _det_model(d.target_train)
    return TR.diag_predict(d.target_test, m.users, m.items, diag)


def pred_diag_scaled(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _diag_pred(d, DIAG).select(*KEYS, r6("prediction").alias("prediction"))


def pred_scaled_cap(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _diag_pred(d, DIAG).select(*KEYS, r6(V.scale_cap("prediction", CAP_SCALE, 5.0)).alias("prediction"))


def pred_clamp(spark, sf_dir):
    d = _data(spark, sf_dir)
    p = FZ.predict_pairs(d.target_test, _det_model(d.target_train))
    raw = F.lit(CLAMP_SCALE) * F.col("prediction") - F.lit(CLAMP_SHIFT)
    return p.select(*KEYS, r6(V.clamp_asym(raw)).alias("prediction"))


def pred_extremes(spark, sf_dir):
    """Smallest and largest clamped prediction."""
    e = M.extremes(pred_clamp(spark, sf_dir))
    return e.select(r6("lowest").alias("lowest"), r6("highest").alias("highest"), "n")


def pred_limited(spark, sf_dir):
    """Biased predictions with the optional clamp to 2.9..3.3."""
    d = _data(spark, sf_dir)
    p = FZ.predict_pairs(d.target_test, _det_model(d.target_train, bias=True), clamp=(2.9, 3.3))
    return p.select(*KEYS, r6("prediction").alias("prediction"))


def pred_running_clamp(spark, sf_dir):
    d = _data(spark, sf_dir)
    m = _det_model(d.target_train)
    sd = F.array(*[F.lit(x) for x in SIGNED_DIAG])
    j = d.target_test.select(*KEYS).join(
        m.users.select(F.col("id").alias("user_id"), F.col("features").alias("_p")), "user_id"
    ).join(m.items.select(F.col("id").alias("item_id"), F.col("features").alias("_q")), "item_id")
    return j.select(*KEYS, r6(V.running_clamp(V.scaled_terms("_p", sd, "_q"))).alias("prediction"))


def _quantized_items(train: DataFrame) -> DataFrame:
    """Item factors floored to steps of 0.05, so that rows have tied maxima."""
    items = FZ.init_factors(train, RANK).items
    return items.select("id", F.transform("features", lambda x: F.floor(x * F.lit(20.0)) / F.lit(20.0)).alias("features"))


def one_hot_argmax(spark, sf_dir):
    d = _data(spark, sf_dir, reuse=False)
    users = FZ.init_factors(d.target_train, RANK).users
    return _long(users.select("id", V.one_hot_argmax("features").alias("features")), "user")


def one_hot_blockmax(spark, sf_dir):
    d = _data(spark, sf_dir, reuse=False)
    items = _quantized_items(d.target_train)
    return _long(items.select("id", V.one_hot_blockmax("features").alias("features")), "item")


def diag_refine_step(spark, sf_dir):
    d = _data(spark, sf_dir)
    users = FZ.init_factors(d.target_train, RANK).users.select("id", V.one_hot_argmax("features").alias("features"))
    items = _quantized_items(d.target_train).select("id", V.one_hot_blockmax("features").alias("features"))
    g = TR.diag_refine_sums(d.target_train, users, items, DIAG, REFINE_LAMBDA)
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), (F.lit(DIAG[k]) + F.lit(REFINE_ALPHA) * F.col(f"g{k}")).alias("d"))
                for k in range(len(DIAG))
            ]
        )
    )
    return g.select(cells.alias("c")).select(F.col("c.k").alias("k"), r6("c.d").alias("d"))


def diag_normal_sums(spark, sf_dir):
    """The normal equations of the diagonal: sums of x_k x_l, and with l = -1 of r x_k."""
    d = _data(spark, sf_dir)
    m = _det_model(d.target_train)
    a, b, _ = TR.diag_normal(d.target_train, m.users, m.items, RANK)
    cells = [(k, c, float(a[k, c])) for k in range(RANK) for c in range(RANK)] + [(k, -1, float(b[k])) for k in range(RANK)]
    return spark.createDataFrame(cells, "k int, l int, value double").select("k", "l", F.round("value", 4).alias("value"))


# ----------------------------------------------------------- metrics


def _metrics(spark, sf_dir):
    d = _data(spark, sf_dir)
    return M.error_metrics(_biased_predictions(d, d.partial_coverage_train()), d.target_test)


def error_report(spark, sf_dir):
    return _metrics(spark, sf_dir)


def rmse_joined(spark, sf_dir):
    return _metrics(spark, sf_dir).select(r6("rmse_joined").alias("rmse"), "n_joined")


def rmse_test_n(spark, sf_dir):
    return _metrics(spark, sf_dir).select(r6("rmse_test_n").alias("rmse"), "n_test")


def mae_test_n(spark, sf_dir):
    return _metrics(spark, sf_dir).select(r6("mae_test_n").alias("mae"), "n_test")


def top_n_items(spark, sf_dir):
    d = _data(spark, sf_dir, reuse=False)
    t = M.top_n(d.target_train, TOP_N, "rating")
    return t.select(*KEYS, "rank", r6("rating").alias("rating"))


def user_item_counts(spark, sf_dir):
    d = _data(spark, sf_dir, reuse=False)
    return M.user_item_counts(d.target_test)


def precision_recall(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _rounded_pr(M.precision_recall(_biased_predictions(d, d.target_train), d.target_test, TOP_N))


def precision_recall_unseen(spark, sf_dir):
    """Scores of the train and test pairs together, with the train pairs taken out of the lists."""
    d = _data(spark, sf_dir)
    pairs = d.target_test.unionByName(d.target_train)
    pred = FZ.predict_pairs(pairs, _det_model(d.target_train, bias=True))
    return _rounded_pr(M.precision_recall(pred, d.target_test, TOP_N, exclude_seen=d.target_train))


def _rounded_pr(pr: DataFrame) -> DataFrame:
    return pr.select(r6("precision").alias("precision"), r6("recall").alias("recall"), "hits", "n_users", "n_recall")


# ------------------------------------------------------ gradient epochs


def _epochs(spark, sf_dir, iters: int, step: str, bias: bool) -> DataFrame:
    d = _data(spark, sf_dir)
    m = FZ.fit_gradient(
        d.target_train, EPOCH_RANK, iters, EPOCH_ALPHA, EPOCH_LAMBDA, EPOCH_DECAY, step=step, bias=bias
    )
    return FZ.long_factors(m).select("side", "id", "f", r6("value").alias("value"))


def mf_epoch_1(spark, sf_dir):
    return _epochs(spark, sf_dir, 1, "sum", False)


def mf_epoch_2(spark, sf_dir):
    return _epochs(spark, sf_dir, 2, "mean", False)


def bias_epoch_1(spark, sf_dir):
    return _epochs(spark, sf_dir, 1, "sum", True)


def lfm_sequential(spark, sf_dir):
    """Factors after two sequential epochs over the target's train ratings."""
    d = _data(spark, sf_dir)
    m = SQ.fit_sequential(d.target_train, EPOCH_RANK, 2, EPOCH_ALPHA, EPOCH_LAMBDA, EPOCH_DECAY)
    return FZ.long_factors(m).select("side", "id", "f", r6("value").alias("value"))


def bias_sequential(spark, sf_dir):
    """Factors and biases after two sequential epochs."""
    d = _data(spark, sf_dir)
    m = SQ.fit_sequential(d.target_train, EPOCH_RANK, 2, EPOCH_ALPHA, EPOCH_LAMBDA, EPOCH_DECAY, bias=True)
    return FZ.long_factors(m).select("side", "id", "f", r6("value").alias("value"))


# ---------------------------------------------------- recommendations


def recommend_all(spark, sf_dir):
    """The best of all items for every user, p.q."""
    d = _data(spark, sf_dir)
    m = _det_model(d.target_train)
    return _lists(RT.top_n_all(m.users, m.items, TOP_N))


def recommend_unseen(spark, sf_dir):
    """The best items that a user has not rated, with biases."""
    d = _data(spark, sf_dir)
    m = _det_model(d.target_train, bias=True)
    return _lists(RT.top_n_all(m.users, m.items, TOP_N, m.mu, d.target_train))


def _lists(found: DataFrame) -> DataFrame:
    return found.select(*KEYS, "rank", r6("score").alias("score"))


# ---------------------------------------------------------- clusters


def _embeddings(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def _label_centres(spark, sf_dir) -> DataFrame:
    return materialize(C.mean_centres(_embeddings(spark, sf_dir), "label", "features", 64))


def nearest_center(spark, sf_dir):
    a = C.assign(_embeddings(spark, sf_dir), _label_centres(spark, sf_dir), "vec_id")
    return a.select(F.col("id").alias("vec_id"), "cluster")


def center_cross(spark, sf_dir):
    centres = _label_centres(spark, sf_dir)
    return C.centre_products(centres, centres).select("uc", "ic", r6("rating").alias("rating"))


def _bucket_centres(ratings: DataFrame, side: str, factors: DataFrame) -> DataFrame:
    """Centres = mean factor of the ids whose mean rating has the same floor."""
    key = "user_id" if side == "user" else "item_id"
    level = ratings.groupBy(key).agg(F.floor(F.avg("rating")).cast("int").alias("cluster"))
    j = factors.join(level.withColumnRenamed(key, "id"), "id")
    return materialize(C.mean_centres(j, "cluster", "features", RANK))


def _domain_clusters(spark, ratings: DataFrame):
    m = FZ.init_factors(ratings, RANK)
    uc = _bucket_centres(ratings, "user", m.users)
    ic = _bucket_centres(ratings, "item", m.items)
    return m, uc, ic


def cluster_ratings(spark, sf_dir):
    d = _data(spark, sf_dir)
    _, uc, ic = _domain_clusters(spark, d.target_train)
    return C.cluster_ratings(uc, ic).select("uc", "ic", r6("rating").alias("rating"))


def _merged(spark, d: R.CrossDomainData):
    ms, ucs, ics = _domain_clusters(spark, d.source)
    mt, uct, ict = _domain_clusters(spark, d.target_train)
    codebook = TR.merge_codebooks(C.cluster_ratings(ucs, ics), C.cluster_ratings(uct, ict), BUCKETS)
    users = TR.merge_memberships(
        C.assign(ms.users, ucs), TR.offset_clusters(C.assign(mt.users, uct), BUCKETS, cols=("cluster",))
    )
    items = TR.merge_memberships(
        C.assign(ms.items, ics), TR.offset_clusters(C.assign(mt.items, ict), BUCKETS, cols=("cluster",))
    )
    return codebook, users, items


def cluster_merge_offset(spark, sf_dir):
    d = _data(spark, sf_dir)
    codebook, _, _ = _merged(spark, d)
    return codebook.select("uc", "ic", r6("rating").alias("rating"))


def cluster_lookup_predict(spark, sf_dir):
    d = _data(spark, sf_dir)
    codebook, users, items = _merged(spark, d)
    p = TR.cluster_lookup(d.target_test, users, items, codebook, clamp=True)
    return p.select(*KEYS, r6("prediction").alias("prediction"))


# -------------------------------------------------------- similarity


def _centre_pairs(spark, sf_dir) -> DataFrame:
    """Each vector against the centre of its label, and against the centre's opposite:
    two pairs a vector, with cosines on both sides of 0."""
    e = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("u1"), F.col("label").cast("int").alias("u2"), F.col("features").alias("_a"))
    c = _label_centres(spark, sf_dir).select(F.col("cluster").alias("u2"), F.col("features").alias("_b"))
    signs = F.explode(F.array(F.lit(1), F.lit(-1)))
    j = e.join(c, "u2").where((V.norm2("_a") > 0) & (V.norm2("_b") > 0)).withColumn("sign", signs)
    facing = F.transform("_b", lambda x: x * F.col("sign"))
    return j.select("u1", "u2", "sign", V.cosine("_a", facing).alias("sim"))


def nearest_users(spark, sf_dir):
    """The users whose factors have the largest cosine with each user's."""
    d = _data(spark, sf_dir)
    found = SM.nearest_by_cosine(FZ.init_factors(d.target_train, RANK).users, TOP_N)
    return found.select(F.col("id").alias("u1"), F.col("neighbour").alias("u2"), "rank", r6("sim").alias("sim"))


def user_pair_bins(spark, sf_dir):
    """How many pairs of different users have a cosine in each bin, and the limits of all pairs."""
    d = _data(spark, sf_dir)
    found = PB.cosine_pair_bins(FZ.init_factors(d.target_train, RANK).users)
    return found.select("bin", "n_pairs", r6("sim_min").alias("sim_min"), r6("sim_max").alias("sim_max"))


def similarity_step(spark, sf_dir):
    """One step of the users' factors towards the binned similarities of all pairs of users."""
    d = _data(spark, sf_dir)
    sim = ST.similarity_matrix(FZ.init_factors(d.target_train, RANK).users, TOP_N, BUCKETS)
    start = [sim.unit.select("id", init("id", EPOCH_RANK).alias("features")) for init in (V.user_init, V.item_init)]
    stepped = ST.half_step(sim, start[1], EPOCH_RANK, EPOCH_LAMBDA, a=start[0], alpha=SIM_ALPHA)
    return _long(stepped.withColumn("id", F.col("id").cast("int")), "user")


def centre_cosine(spark, sf_dir):
    return _centre_pairs(spark, sf_dir).select("u1", "u2", "sign", r6("sim").alias("sim"))


def centre_cosine_binned(spark, sf_dir):
    """Cosines stretched to the whole of -1..1 (their sign times the fourth root of their size), then
    binned, so that every bin a cosine can reach is reached."""
    pairs = _centre_pairs(spark, sf_dir).withColumn("sim", F.signum("sim") * F.sqrt(F.sqrt(F.abs("sim"))))
    return TR.bin_similarity(pairs, BUCKETS)


# ------------------------------------------------------------- blend, mix


def factor_blend(spark, sf_dir):
    d = _data(spark, sf_dir)
    src = d.partial_overlap_source().select(F.col("user_id").alias("id")).distinct()
    tgt = d.target_train.select(F.col("user_id").alias("id")).distinct()
    s = src.select("id", V.user_init("id", RANK).alias("features"))
    t = tgt.select("id", V.item_init("id", RANK).alias("features"))
    return _long(TR.blend_factors(s, t, BLEND_A), "user")


def prediction_mix(spark, sf_dir):
    d = _data(spark, sf_dir)
    a = _biased_predictions(d, d.target_train)
    b = FZ.predict_pairs(d.target_test, _det_model(d.target_train))
    return TR.mix_predictions(a, b, MIX_W, MIX_SHIFT).select(*KEYS, r6("prediction").alias("prediction"))
