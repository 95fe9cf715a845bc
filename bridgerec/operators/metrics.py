"""Scoring: coverage, RMSE, MAE, top-N lists, precision/recall.

Each metric is one aggregation job however many users there are: the
prediction/test join and the denominators are tagged rows of one ``union``
that a single global ``agg`` folds (partial aggregation per task, one small
final merge).  Empty overlaps give NULL rather than an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["user_id", "item_id"]


def covered_pairs(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose user and item both occur in ``train`` (two semi joins)."""
    users = train.select("user_id").distinct()
    items = train.select("item_id").distinct()
    return test.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi")


def _error_sums(pred: DataFrame, test: DataFrame, pred_col: str) -> DataFrame:
    joined = pred.select(*KEYS, F.col(pred_col).alias("_p")).join(
        test.select(*KEYS, F.col("rating").alias("_r")), KEYS
    )
    diff = F.col("_p") - F.col("_r")
    a = joined.select(
        (diff * diff).alias("sq"), F.abs(diff).alias("ab"), F.lit(1).alias("j"), F.lit(0).alias("t")
    )
    b = test.select(
        F.lit(None).cast("double").alias("sq"),
        F.lit(None).cast("double").alias("ab"),
        F.lit(0).alias("j"),
        F.lit(1).alias("t"),
    )
    return a.unionByName(b).agg(
        F.sum("sq").alias("sum_sq"),
        F.sum("ab").alias("sum_abs"),
        F.sum("j").cast("bigint").alias("n_joined"),
        F.sum("t").cast("bigint").alias("n_test"),
    )


def error_metrics(pred: DataFrame, test: DataFrame, pred_col: str = "prediction") -> DataFrame:
    """One row: rmse_joined, rmse_test_n, mae_test_n, mae_joined, n_joined, n_test.

    ``*_joined`` divide by the number of joined rows, ``*_test_n`` by all test
    rows (the reference's RMSE and MAE use different denominators)."""
    s = _error_sums(pred, test, pred_col)
    return s.select(
        F.sqrt(F.try_divide(F.col("sum_sq"), F.col("n_joined"))).alias("rmse_joined"),
        F.sqrt(F.try_divide(F.col("sum_sq"), F.col("n_test"))).alias("rmse_test_n"),
        F.try_divide(F.col("sum_abs"), F.col("n_test")).alias("mae_test_n"),
        F.try_divide(F.col("sum_abs"), F.col("n_joined")).alias("mae_joined"),
        "n_joined",
        "n_test",
    )


def rmse(pred: DataFrame, test: DataFrame, denominator: str = "joined", pred_col: str = "prediction") -> DataFrame:
    col = {"joined": "rmse_joined", "test": "rmse_test_n"}[denominator]
    return error_metrics(pred, test, pred_col).select(F.col(col).alias("rmse"))


def top_n(ratings: DataFrame, n: int, score_col: str = "rating", exclude: DataFrame | None = None) -> DataFrame:
    """The ``n`` highest-scored items of every user, ties by smaller item id.

    ``row_number() <= n`` lets Spark insert a per-task group limit before the
    shuffle, so a user with very many rows ships at most ``n`` rows per task.
    ``exclude`` (e.g. the training pairs) removes already-seen items first."""
    if exclude is not None:
        ratings = ratings.join(exclude.select(*KEYS), KEYS, "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.col(score_col).desc(), F.col("item_id").asc())
    return (
        ratings.select("user_id", "item_id", score_col)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
    )


def distinct_pairs(ratings: DataFrame) -> DataFrame:
    """One row: the number of distinct (user, item) pairs (a map's size)."""
    return ratings.agg(F.count_distinct("user_id", "item_id").alias("n_pairs"))


def preview(ratings: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows by user and item, for inspection."""
    return ratings.orderBy(*KEYS).limit(n)


def extremes(pred: DataFrame, pred_col: str = "prediction") -> DataFrame:
    """One row: the smallest and the largest prediction and their number."""
    return pred.agg(F.min(pred_col).alias("lowest"), F.max(pred_col).alias("highest"), F.count(F.lit(1)).alias("n"))


def user_item_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_items"))


def precision_recall(
    pred: DataFrame, test: DataFrame, n: int, pred_col: str = "prediction", exclude_seen: DataFrame | None = None
) -> DataFrame:
    """Micro-averaged precision and recall at ``n`` over users present in both.

    hit = sum over users of |topN(pred) & topN(test)|; recall = hit / sum of
    the users' test item counts; precision = hit / (n * users), also for users
    with fewer than ``n`` predictions.  ``exclude_seen`` (e.g. the training pairs)
    takes items a user has already rated out of the predicted lists."""
    pred_users = pred.select("user_id").distinct()
    test_both = test.join(pred_users, "user_id", "left_semi")
    test_users = test.select("user_id").distinct()
    p_top = top_n(pred.join(test_users, "user_id", "left_semi").withColumnRenamed(pred_col, "_s"), n, "_s", exclude_seen)
    t_top = top_n(test_both, n, "rating")
    hits = p_top.select(*KEYS).join(t_top.select(*KEYS), KEYS)
    per_user = test_both.groupBy("user_id").agg(F.count(F.lit(1)).alias("cnt"))
    a = hits.select(F.lit(1).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("items"), F.lit(0).cast("bigint").alias("users"))
    b = per_user.select(F.lit(0).cast("bigint").alias("hit"), F.col("cnt").alias("items"), F.lit(1).cast("bigint").alias("users"))
    s = a.unionByName(b).agg(
        F.sum("hit").alias("hits"), F.sum("items").alias("n_recall"), F.sum("users").alias("n_users")
    )
    return s.select(
        F.try_divide(F.col("hits").cast("double"), (F.col("n_users") * F.lit(n)).cast("double")).alias("precision"),
        F.try_divide(F.col("hits").cast("double"), F.col("n_recall").cast("double")).alias("recall"),
        F.coalesce(F.col("hits"), F.lit(0).cast("bigint")).alias("hits"),
        F.coalesce(F.col("n_users"), F.lit(0).cast("bigint")).alias("n_users"),
        F.coalesce(F.col("n_recall"), F.lit(0).cast("bigint")).alias("n_recall"),
    )
