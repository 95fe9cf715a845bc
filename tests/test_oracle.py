"""Every query with an oracle matches DuckDB on the driver tables (sf0.001),
and every registered query runs."""

import os

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_compare import compare, duck

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables missing")

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, con, name):
    rows, problems = compare(spark, con, SF_SMALL, QUERIES[name], ORACLES[name])
    assert not problems, problems
    assert rows > 0


@pytest.mark.parametrize("name", ["als_factors", "als_predict", "kmeans_assign", "svd_factors", "q_lfm", "q_eval_demo"])
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0


def test_checked_queries_take_every_branch(con):
    def values(name, col):
        return [r[0] for r in con.execute(f"SELECT {col} FROM ({ORACLES[name]})").fetchall()]

    capped = values("pred_scaled_cap", "prediction")
    assert max(capped) == 5 and min(capped) < 5 and capped.count(5.0) > 5
    clamped = values("pred_clamp", "prediction")
    for low, high in ((0, 0.999), (1, 1), (1.001, 4.999), (5, 5)):  # between 0 and 1, raised, kept, lowered
        assert any(low <= x <= high for x in clamped), (low, high)
    limited = values("pred_limited", "prediction")
    assert 2.9 in limited and 3.3 in limited and any(2.9 < x < 3.3 for x in limited)
    assert set(values("user_overlap", "category")) == {"shared", "source_only", "target_only"}
    assert set(values("centre_cosine_binned", "sim")) == {1.0, 2.0, 3.0, 4.0}  # a cosine can't reach 5
    assert len(values("pool_distinct", "rating")) < len(values("pool_all", "rating")) + len(values("parse_comma", "rating"))


def test_building_a_query_only_reads_schemas(spark):
    tracker = spark.sparkContext.statusTracker()
    for name in ("pred_dot", "pool_distinct", "global_mean", "parse_tab"):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        QUERIES[name](spark, SF_SMALL)
        assert len(tracker.getJobIdsForGroup(f"build-{name}")) <= 2, name  # the schemas of two tables
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["n_test"] > 0
    assert set(df.columns) == {"rmse_joined", "rmse_test_n", "mae_test_n", "mae_joined", "n_joined", "n_test"}
