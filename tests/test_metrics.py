"""Metric semantics on hand-made rows (FIXTURES.md section 5)."""

import math

import pytest
from pyspark.sql import functions as F

from bridgerec.operators import metrics as M
from bridgerec.sources import ratings as R
from conftest import ratings_df


def pred_df(spark, rows):
    return ratings_df(spark, rows).withColumnRenamed("rating", "prediction")


def test_duplicate_pair_average(spark):
    df = R.dedupe_pairs(ratings_df(spark, [(1, 1, 5), (1, 1, 3)]))
    assert [tuple(r) for r in df.collect()] == [(1, 1, 4.0)]


def test_no_overlap_gives_null(spark):
    m = M.error_metrics(pred_df(spark, [(1, 1, 3)]), ratings_df(spark, [(2, 2, 4)])).first()
    assert m["rmse_joined"] is None and m["n_joined"] == 0 and m["n_test"] == 1
    assert m["rmse_test_n"] is None or m["rmse_test_n"] == 0.0 or math.isnan(m["rmse_test_n"])


def test_partial_overlap_denominators(spark):
    pred = pred_df(spark, [(1, 1, 4)])
    test = ratings_df(spark, [(1, 1, 5), (2, 2, 3)])
    m = M.error_metrics(pred, test).first()
    assert m["rmse_joined"] == pytest.approx(1.0)
    assert m["rmse_test_n"] == pytest.approx(math.sqrt(0.5))
    assert m["mae_test_n"] == pytest.approx(0.5)
    assert m["n_joined"] == 1 and m["n_test"] == 2


def test_top_n_ties_by_item_id(spark):
    df = ratings_df(spark, [(1, 9, 4.0), (1, 3, 4.0), (1, 5, 2.0), (2, 1, 1.0)])
    out = M.top_n(df, 2).orderBy("user_id", "rank").collect()
    assert [(r["user_id"], r["item_id"], r["rank"]) for r in out] == [(1, 3, 1), (1, 9, 2), (2, 1, 1)]


def test_top_n_exclude_seen(spark):
    df = ratings_df(spark, [(1, 9, 4.0), (1, 3, 5.0)])
    seen = ratings_df(spark, [(1, 3, 1.0)])
    out = M.top_n(df, 2, exclude=seen).collect()
    assert [(r["item_id"]) for r in out] == [9]


def test_precision_denominator_for_short_lists(spark):
    pred = pred_df(spark, [(1, 1, 5.0)])
    test = ratings_df(spark, [(1, 1, 4.0), (1, 2, 3.0), (3, 3, 3.0)])
    r = M.precision_recall(pred, test, 5).first()
    assert r["hits"] == 1 and r["n_users"] == 1 and r["n_recall"] == 2
    assert r["precision"] == pytest.approx(1 / 5)
    assert r["recall"] == pytest.approx(1 / 2)


def test_precision_recall_no_common_users(spark):
    r = M.precision_recall(pred_df(spark, [(1, 1, 5.0)]), ratings_df(spark, [(2, 1, 4.0)]), 5).first()
    assert r["precision"] is None and r["recall"] is None and r["hits"] == 0


def test_covered_pairs(spark):
    train = ratings_df(spark, [(1, 10, 3.0), (2, 20, 3.0)])
    test = ratings_df(spark, [(1, 20, 1.0), (1, 30, 2.0), (3, 10, 3.0)])
    out = {(r["user_id"], r["item_id"]) for r in M.covered_pairs(test, train).collect()}
    assert out == {(1, 20)}


def test_user_item_counts(spark):
    df = ratings_df(spark, [(1, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0)])
    out = {r["user_id"]: r["n_items"] for r in M.user_item_counts(df).collect()}
    assert out == {1: 2, 2: 1}


def test_metrics_one_job_plan_has_no_cartesian(spark):
    pred = pred_df(spark, [(1, 1, 4)])
    test = ratings_df(spark, [(1, 1, 5), (2, 2, 3)])
    plan = M.error_metrics(pred, test)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert F is not None


def test_distinct_pairs_and_preview(spark):
    df = ratings_df(spark, [(1, 1, 1.0), (1, 1, 2.0), (2, 1, 1.0)])
    assert M.distinct_pairs(df).first()["n_pairs"] == 2
    assert [r["user_id"] for r in M.preview(df, 2).collect()] == [1, 1]
    low = M.extremes(df, "rating").first()
    assert (low["lowest"], low["highest"], low["n"]) == (1.0, 2.0, 3)


def test_precision_without_seen_items(spark):
    pred = pred_df(spark, [(1, 1, 5), (1, 2, 4)])
    test, seen = ratings_df(spark, [(1, 2, 5)]), ratings_df(spark, [(1, 1, 5)])
    assert M.precision_recall(pred, test, 1).first()["hits"] == 0
    assert M.precision_recall(pred, test, 1, exclude_seen=seen).first()["hits"] == 1
