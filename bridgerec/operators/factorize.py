"""Latent-factor models: ALS and full-batch gradient epochs, with and without
user/item biases.

Factor tables are DataFrames ``id int, features array<double>`` (plus
``bias double`` for the biased model), the shape of ``ALSModel.userFactors``.

Gradient epoch (data-parallel form of the reference's SGD sweep): every
rating is joined to its user and item factors, the error ``e = r - p.q`` and both
increments are computed once per rating, and one ``groupBy`` of (side, id) sums them
for users and items alike.  The join is salted for hot items (``SALTS`` copies of these
alone), so the ratings of a hot item spread over as many tasks; the sums combine
inside tasks before their shuffle, so a hot id ships one row a task.  All increments
use the epoch-start factors.  ``step="sum"`` adds the summed increment (the
first-order equivalent of one SGD pass); ``step="mean"`` divides it by the id's rating
count, which stays bounded for ids with very many ratings.  Each epoch is
written to the checkpoint folder so lineage does not grow with the epochs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bridgerec.functions import vectors as V
from bridgerec.operators.svd import SVDResult, truncated_svd  # noqa: F401
from bridgerec.session import ensure_checkpoint_dir, materialize, materialize_step, release


#: User and item blocks of ALS: one for so many ratings (the second number), between the first number and ``MOST_BLOCKS``,
#: and more if a block would have over ``FULL_BLOCK`` ratings.  A block is a task, so few blocks leave cores idle; an
#: iteration sends each vector to every block that has one of its ratings, so many blocks move more, but
#: never more than a vector a rating.  The factors depend on the number, so it follows from the data and never from the
#: cluster: one seed gives one model on a cluster of any size.
ALS_BLOCKS, BLOCK_RATINGS = 4, 125_000
MOST_BLOCKS, FULL_BLOCK = 24, 16_000_000
#: ALS iterations after which the factors are checkpointed and the vectors sent until then leave the disks.
ALS_KEPT = 1
#: Blocks for at most so many ratings, whose vectors are few however often they are sent.
SMALL_BLOCKS, SMALL_RATINGS = 16, 2_000_000
#: Parts in which ALS is fed the ratings, by the same rule.
FED_PARTS, PART_RATINGS = 16, 2_000_000
#: ALS iterations: what the reference gives its own ALS fits.
ALS_ITERS = 20
#: Parts of a hot item's ratings in a gradient epoch, and the ratings above which an item is hot.
SALTS, HOT_RATINGS = 16, 100_000


@dataclass
class FactorModel:
    users: DataFrame  # id int, features array<double>[, bias double]
    items: DataFrame
    mu: float | None = None  # global mean of the biased model
    rank: int | None = None
    sums: DataFrame | None = None  # the written increments that the factors of an epoch are read from

    @property
    def biased(self) -> bool:
        return self.mu is not None


# ---------------------------------------------------------------- ALS


def als_blocks(ratings: int) -> int:
    """The blocks of a fit on so many ratings."""
    if ratings <= SMALL_RATINGS:
        return SMALL_BLOCKS
    return max(ALS_BLOCKS, min(MOST_BLOCKS, -(-ratings // BLOCK_RATINGS)), -(-ratings // FULL_BLOCK))


def als_fit(
    ratings: DataFrame,
    rank: int,
    max_iter: int = ALS_ITERS,
    reg: float = 0.1,
    seed: int = 42,
    num_blocks: int | None = None,
    rating_col: str = "rating",
) -> FactorModel:
    """Spark ML ALS; factors come back as ``array<double>``.  ALS checkpoints
    its own factor RDDs every ``ALS_KEPT`` iterations into the session's checkpoint
    folder and then removes the shuffles before."""
    ensure_checkpoint_dir(ratings.sparkSession)
    als = ALS(
        rank=rank,
        maxIter=max_iter,
        regParam=reg,
        userCol="user_id",
        itemCol="item_id",
        ratingCol=rating_col,
        seed=seed,
        coldStartStrategy="drop",
        checkpointInterval=ALS_KEPT,
    )
    n = ratings.count()
    als = als.setNumBlocks(num_blocks or als_blocks(n))
    # rows in a fixed order in fixed parts, for sums in a fixed order
    ratings = ratings.repartition(num_blocks or max(FED_PARTS, -(-n // PART_RATINGS)), "user_id", "item_id").sortWithinPartitions("user_id", "item_id")
    model = als.fit(ratings)
    arr = T.ArrayType(T.DoubleType())
    users = model.userFactors.select(F.col("id").cast("int").alias("id"), F.col("features").cast(arr).alias("features"))
    items = model.itemFactors.select(F.col("id").cast("int").alias("id"), F.col("features").cast(arr).alias("features"))
    return FactorModel(users, items, rank=rank)


# ------------------------------------------------------- initial factors


def init_factors(ratings: DataFrame, rank: int, bias: bool = False) -> FactorModel:
    """Deterministic initial factors for every user and item of ``ratings``
    (biases start at 0)."""
    users = ratings.select(F.col("user_id").alias("id")).distinct()
    items = ratings.select(F.col("item_id").alias("id")).distinct()
    users = users.select("id", V.user_init("id", rank).alias("features"))
    items = items.select("id", V.item_init("id", rank).alias("features"))
    if bias:
        users = users.withColumn("bias", F.lit(0.0))
        items = items.withColumn("bias", F.lit(0.0))
    return FactorModel(users, items, rank=rank)


# ------------------------------------------------------ gradient epochs


def _sums(g: DataFrame, rank: int, bias: bool) -> DataFrame:
    """``side, id, _grad, _n[, _gb]``: the summed increments of users and items."""
    aggs = [F.sum(F.col("_g")[f]).alias(f"_g{f}") for f in range(rank)] + [F.count(F.lit(1)).alias("_n")]
    if bias:
        aggs.append(F.sum("_b").alias("_gb"))
    out = g.groupBy("side", "id").agg(*aggs)
    grad = F.array(*[F.col(f"_g{f}") for f in range(rank)]).alias("_grad")
    return out.select("side", "id", grad, "_n", *(["_gb"] if bias else []))


def _apply(side: DataFrame, sums: DataFrame, alpha: float, step: str, bias: bool) -> DataFrame:
    joined = side.join(sums.drop("side"), "id", "left")
    scale = F.lit(float(alpha)) if step == "sum" else F.lit(float(alpha)) / F.col("_n").cast("double")
    feats = F.when(F.col("_grad").isNull(), F.col("features")).otherwise(
        F.zip_with(F.col("features"), F.col("_grad"), lambda p, g: p + scale * g)
    )
    cols = ["id", feats.alias("features")]
    if bias:
        cols.append(
            F.when(F.col("_gb").isNull(), F.col("bias")).otherwise(F.col("bias") + scale * F.col("_gb")).alias("bias")
        )
    return joined.select(*cols)


def hot_items(ratings: DataFrame) -> DataFrame:
    """(item_id, _last): the last part of each item with over ``HOT_RATINGS`` ratings; one row for so many ratings at most."""
    many = ratings.groupBy("item_id").count().filter(F.col("count") > HOT_RATINGS)
    return many.select("item_id", F.lit(SALTS - 1).alias("_last"))


def _salted(ratings: DataFrame, items: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``_salt``: hot items once a part, the others once."""
    hot = F.broadcast(hot)
    last = F.coalesce("_last", F.lit(0))
    salt = F.pmod(F.xxhash64("user_id"), last + 1).cast("int")
    rated = ratings.join(hot, "item_id", "left").withColumn("_salt", salt).drop("_last")
    return rated, items.join(hot, "item_id", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_last")


def gradient_epoch(
    ratings: DataFrame,
    model: FactorModel,
    alpha: float,
    lam: float,
    step: str = "mean",
    checkpoint: bool = True,
    hot: DataFrame | None = None,
) -> FactorModel:
    """One full-batch epoch; the sums are written once and feed both factor tables.  ``hot`` are
    the :func:`hot_items` of the ratings, if they are known."""
    if step not in ("sum", "mean"):
        raise ValueError("step must be 'sum' or 'mean'")
    rank = _rank_of(model)
    ucols = [F.col("id").alias("user_id"), F.col("features").alias("_p")]
    icols = [F.col("id").alias("item_id"), F.col("features").alias("_q")]
    if model.biased:
        ucols.append(F.col("bias").alias("_bu"))
        icols.append(F.col("bias").alias("_bi"))
    rated, items = _salted(ratings.select("user_id", "item_id", "rating"), model.items.select(*icols), hot_items(ratings) if hot is None else hot)
    j = rated.join(model.users.select(*ucols), "user_id").join(items, ["item_id", "_salt"])
    if model.biased:
        pred = V.biased_dot(model.mu, "_bu", "_bi", "_p", "_q")
    else:
        pred = V.dot("_p", "_q")
    j = j.withColumn("_e", F.col("rating") - pred)
    lam_c = F.lit(float(lam))
    e = F.col("_e")
    gu = F.zip_with("_q", "_p", lambda q, p: q * e - lam_c * p)
    gi = F.zip_with("_p", "_q", lambda p, q: p * e - lam_c * q)
    bu, bi = ((e - lam_c * F.col(c)) if model.biased else F.lit(0.0) for c in ("_bu", "_bi"))
    sides = F.array(
        F.struct(F.lit("user").alias("side"), F.col("user_id").alias("id"), gu.alias("_g"), bu.alias("_b")),
        F.struct(F.lit("item").alias("side"), F.col("item_id").alias("id"), gi.alias("_g"), bi.alias("_b")),
    )
    sums = _sums(j.select(F.explode(sides).alias("s")).select("s.*"), rank, model.biased)
    sums = materialize(sums) if checkpoint else sums
    users = _apply(model.users, sums.where("side = 'user'"), alpha, step, model.biased)
    new_items = _apply(model.items, sums.where("side = 'item'"), alpha, step, model.biased)
    return FactorModel(users, new_items, model.mu, rank, sums if checkpoint else None)


def _rank_of(model: FactorModel) -> int:
    if model.rank is None:
        model.rank = int(model.users.select(F.size("features")).first()[0])
    return model.rank


def fit_gradient(
    ratings: DataFrame,
    rank: int,
    iters: int,
    alpha: float = 0.01,
    lam: float = 0.01,
    decay: float = 0.9,
    step: str = "mean",
    bias: bool = False,
    mu: float | None = None,
    checkpoint: bool = True,
) -> FactorModel:
    """Gradient-descent factorisation: ``iters`` epochs, learning rate times
    ``decay`` after each.  With ``bias=True`` the model is mu + b_u + b_i + p.q
    with mu fixed (the rating mean unless given)."""
    if bias and mu is None:
        mu = float(ratings.agg(F.avg("rating")).first()[0])
    model = init_factors(ratings, rank, bias)
    model = FactorModel(model.users, model.items, mu if bias else None, rank)
    a = alpha
    hot = materialize(hot_items(ratings)) if checkpoint else hot_items(ratings)
    for _ in range(iters):
        last, model = model, gradient_epoch(ratings, model, a, lam, step, checkpoint, hot)
        if checkpoint:
            sums = model.sums
            model = FactorModel(materialize_step(model.users), materialize_step(model.items), model.mu, rank)
            release(last.users, last.items, sums)
        a *= decay
    return model


def fit_bias_baseline(ratings: DataFrame, reg: float = 10.0) -> tuple[float, DataFrame, DataFrame]:
    """Regularised bias means: b_i = sum(r - mu) / (reg + n_i), then
    b_u = sum(r - mu - b_i) / (reg + n_u).  Returns (mu, user_bias, item_bias)."""
    mu = float(ratings.agg(F.avg("rating")).first()[0])
    bi = ratings.groupBy("item_id").agg(
        (F.sum(F.col("rating") - F.lit(mu)) / (F.lit(reg) + F.count(F.lit(1)))).alias("bias")
    )
    bu = (
        ratings.join(bi.withColumnRenamed("bias", "_bi"), "item_id")
        .groupBy("user_id")
        .agg((F.sum(F.col("rating") - F.lit(mu) - F.col("_bi")) / (F.lit(reg) + F.count(F.lit(1)))).alias("bias"))
    )
    return mu, bu.withColumnRenamed("user_id", "id"), bi.withColumnRenamed("item_id", "id")


def fit_biased_als(
    ratings: DataFrame, rank: int, max_iter: int = ALS_ITERS, reg: float = 0.1, seed: int = 42, bias_reg: float = 10.0
) -> FactorModel:
    """Biased model at scale: bias baseline first, then ALS on the residual
    r - mu - b_u - b_i (same objective family as the biased gradient model)."""
    mu, bu, bi = fit_bias_baseline(ratings, bias_reg)
    bu = materialize(bu)
    bi = materialize(bi)
    resid = (
        ratings.join(bu.select(F.col("id").alias("user_id"), F.col("bias").alias("_bu")), "user_id")
        .join(bi.select(F.col("id").alias("item_id"), F.col("bias").alias("_bi")), "item_id")
        .select("user_id", "item_id", (F.col("rating") - F.lit(mu) - F.col("_bu") - F.col("_bi")).alias("rating"))
    )
    m = als_fit(resid, rank, max_iter, reg, seed)
    users = m.users.join(bu, "id", "left").select("id", "features", F.coalesce("bias", F.lit(0.0)).alias("bias"))
    items = m.items.join(bi, "id", "left").select("id", "features", F.coalesce("bias", F.lit(0.0)).alias("bias"))
    return FactorModel(users, items, mu, rank)


def fit_lfm(ratings: DataFrame, rank: int, iters: int, lam: float, solver: str = "als", alpha: float = 0.01,
            decay: float = 0.9, step: str = "mean", als_iters: int = ALS_ITERS, seed: int = 42) -> FactorModel:
    """Plain factorisation by ``solver``: "als" (default at scale, ``als_iters``
    iterations), "gradient" or "sequential" (``iters`` epochs)."""
    if solver == "als":
        return als_fit(ratings, rank, als_iters, lam, seed)
    if solver == "gradient":
        return fit_gradient(ratings, rank, iters, alpha, lam, decay, step)
    if solver == "sequential":
        return _sequential(ratings, rank, iters, alpha, lam, decay)
    raise ValueError(solver)


def fit_biased(ratings: DataFrame, rank: int, iters: int, lam: float, solver: str = "als", alpha: float = 0.01,
               decay: float = 0.9, step: str = "mean", mu: float | None = None, als_iters: int = ALS_ITERS,
               seed: int = 42) -> FactorModel:
    if solver == "als":
        return fit_biased_als(ratings, rank, als_iters, lam, seed)
    if solver == "gradient":
        return fit_gradient(ratings, rank, iters, alpha, lam, decay, step, bias=True, mu=mu)
    if solver == "sequential":
        return _sequential(ratings, rank, iters, alpha, lam, decay, bias=True, mu=mu)
    raise ValueError(solver)


def _sequential(*args, **kwargs) -> FactorModel:
    from bridgerec.operators.sequential import fit_sequential  # which builds on this module

    return fit_sequential(*args, **kwargs)


# ------------------------------------------------------------ predict


def predict_pairs(pairs: DataFrame, model: FactorModel, out: str = "prediction", clamp: tuple[float, float] | None = None) -> DataFrame:
    """Score only the given (user, item) pairs; pairs without both factors drop.
    ``clamp`` = (low, high) limits the predictions, which the reference does not do."""
    ucols = [F.col("id").alias("user_id"), F.col("features").alias("_p")]
    icols = [F.col("id").alias("item_id"), F.col("features").alias("_q")]
    if model.biased:
        ucols.append(F.col("bias").alias("_bu"))
        icols.append(F.col("bias").alias("_bi"))
    j = pairs.select("user_id", "item_id").join(model.users.select(*ucols), "user_id").join(
        model.items.select(*icols), "item_id"
    )
    pred = V.biased_dot(model.mu, "_bu", "_bi", "_p", "_q") if model.biased else V.dot("_p", "_q")
    if clamp is not None:
        pred = F.greatest(F.least(pred, F.lit(float(clamp[1]))), F.lit(float(clamp[0])))
    return j.select("user_id", "item_id", pred.alias(out))


def long_factors(model: FactorModel) -> DataFrame:
    """side, id, f, value (+ bias rows with f = -1 for biased models)."""
    parts = []
    for side, df in (("user", model.users), ("item", model.items)):
        parts.append(df.select(F.lit(side).alias("side"), "id", F.posexplode("features").alias("f", "value")))
        if model.biased:
            parts.append(df.select(F.lit(side).alias("side"), "id", F.lit(-1).alias("f"), F.col("bias").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
