"""Expression tests with hand-computed rows (FIXTURES.md section 5)."""

import math

import pytest
from pyspark.sql import functions as F

from bridgerec.functions import vectors as V


def one(spark, expr, schema="x double", rows=((0.0,),)):
    return spark.createDataFrame(list(rows), schema).select(expr.alias("r")).collect()


def test_asymmetric_clamp(spark):
    rows = [(-0.1,), (0.0,), (0.5,), (5.1,), (3.0,)]
    out = [r["r"] for r in spark.createDataFrame(rows, "x double").select(V.clamp_asym("x").alias("r")).collect()]
    assert out == [1.0, 0.0, 0.5, 5.0, 3.0]


def test_running_clamp_is_an_ordered_fold(spark):
    df = spark.createDataFrame([([0.4, 3.0, -9.0, 0.2],)], "t array<double>")
    # 0.4 -> 1; 1+3 = 4; |4-9| = 5; 5.2 -> 5
    assert df.select(V.running_clamp("t").alias("r")).first()["r"] == 5.0
    df2 = spark.createDataFrame([([0.2, -9.0, 3.0, 0.4],)], "t array<double>")
    # 0.2 -> 1; |1-9| = 8 -> 5; 8 -> 5; 5.4 -> 5
    assert df2.select(V.running_clamp("t").alias("r")).first()["r"] == 5.0
    df3 = spark.createDataFrame([([2.0, -4.5],)], "t array<double>")
    assert df3.select(V.running_clamp("t").alias("r")).first()["r"] == 2.5


def test_scale_cap_has_no_floor(spark):
    df = spark.createDataFrame([(-300.0,), (250.0,), (900.0,)], "x double")
    out = [r["r"] for r in df.select(V.scale_cap("x").alias("r")).collect()]
    assert out == [-3.0, 2.5, 5.0]


def test_equal_width_bins(spark):
    # similarities -1 and 1: interval (1 + 1 + 1) / 5 = 0.6; 1 -> bin 4, -1 -> bin 1
    df = spark.createDataFrame([(-1.0,), (1.0,), (-0.39,), (0.2,)], "x double")
    out = [r["r"] for r in df.select(V.equal_width_bin("x", -1.0, 1.0).alias("r")).collect()]
    assert out == [1.0, 4.0, 2.0, 3.0]


def test_bin_five_unreachable_for_cosines(spark):
    # any range max - min <= 2 leaves bin 5 empty (reference behaviour kept)
    xs = [(-1.0 + 0.01 * i,) for i in range(201)]
    df = spark.createDataFrame(xs, "x double")
    bins = {r["r"] for r in df.select(V.equal_width_bin("x", -1.0, 1.0).alias("r")).collect()}
    assert 5.0 not in bins and bins == {1.0, 2.0, 3.0, 4.0}


def test_dot_and_biased_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "p array<double>, q array<double>")
    assert df.select(V.dot("p", "q").alias("r")).first()["r"] == 11.0
    got = df.select(V.biased_dot(3.0, F.lit(0.5), F.lit(-0.25), "p", "q").alias("r")).first()["r"]
    assert got == pytest.approx(14.25)


def test_diag_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "p array<double>, q array<double>")
    d = F.array(F.lit(2.0), F.lit(0.5))
    assert df.select(V.diag_dot("p", d, "q").alias("r")).first()["r"] == 1 * 2 * 3 + 2 * 0.5 * 4


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(V.cosine("a", "b").alias("r")).first()["r"] == pytest.approx(1 / math.sqrt(2))


def test_one_hot(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9, 0.2],)], "a array<double>")
    r = df.select(V.one_hot_argmax("a").alias("x"), V.one_hot_blockmax("a").alias("y")).first()
    assert r["x"] == [0.0, 1.0, 0.0, 0.0]  # first maximum only
    assert r["y"] == [0.0, 1.0, 1.0, 0.0]  # ties all set


def test_deterministic_factors(spark):
    df = spark.createDataFrame([(5,)], "id int")
    got = df.select(V.user_init("id", 3).alias("f")).first()["f"]
    want = [((5 * 7919 + f * 104729) % 10007) / 10007 / math.sqrt(3) for f in range(3)]
    assert got == pytest.approx(want, abs=0)


def test_blend_and_mix(spark):
    df = spark.createDataFrame([([1.0, 3.0], [3.0, 5.0], 2.0, 4.0)], "s array<double>, t array<double>, a double, b double")
    r = df.select(V.blend("s", "t", 0.5).alias("bl"), V.mix("a", "b", 0.8, 1.2).alias("mx")).first()
    assert r["bl"] == [2.0, 4.0]
    assert r["mx"] == pytest.approx(0.8 * 2.0 + 0.2 * (4.0 + 1.2))
