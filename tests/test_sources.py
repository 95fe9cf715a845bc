"""Text sources: tab / comma files, extra fields, strict three-field mode."""

import os
import tempfile

import pytest

from bridgerec.sources import ratings as R


def _write(text):
    d = tempfile.mkdtemp(prefix="bridgerec-src-")
    p = os.path.join(d, "r.txt")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_tab_with_timestamp(spark):
    p = _write("1\t10\t4\t881250949\n2\t20\t3\t891717742\n")
    rows = [tuple(r) for r in R.read_ratings(spark, p, "\t").collect()]
    assert rows == [(1, 10, 4.0), (2, 20, 3.0)]


def test_comma_three_fields(spark):
    p = _write("1,10,4.5\n2,20,3\n")
    rows = [tuple(r) for r in R.read_ratings(spark, p, ",", strict=True).collect()]
    assert rows == [(1, 10, 4.5), (2, 20, 3.0)]


def test_strict_rejects_extra_field(spark):
    p = _write("1,10,4.5,99\n")
    with pytest.raises(Exception):
        R.read_ratings(spark, p, ",", strict=True).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_input_fails_in_both_modes(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for line in ("1\tx\t4", "1\t2\tfour", "1\t2", "\t2\t3", "99999999999\t1\t2", "1.5\t1\t2"):
            lines = spark.createDataFrame([(line,)], "value string")
            with pytest.raises(Exception):
                R.parse_ratings(lines).collect()
        good = spark.createDataFrame([(" 7\t8 \t1e0\tx",)], "value string")
        assert [tuple(r) for r in R.parse_ratings(good).collect()] == [(7, 8, 1.0)]
        orders = spark.createDataFrame([(1, 3_000_000_000)], "o_orderkey long, o_custkey long")
        lines = spark.createDataFrame([(1, 5, 2.0)], "l_orderkey long, l_partkey long, l_quantity double")
        with pytest.raises(Exception):
            R.derive_ratings(lines, orders).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_pool_distinct_drops_equal_triples_only(spark):
    a = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0)], R.RATING_SCHEMA)
    b = spark.createDataFrame([(1, 1, 5.0), (1, 2, 4.0)], R.RATING_SCHEMA)
    assert R.pool(a, b).count() == 3
    assert R.pool(a, b, distinct=False).count() == 4


def test_last_line_wins_for_any_split(spark, tmp_path):
    want = {}
    for f in range(3):
        lines = []
        for k in range(2000):
            u, i, r = k * 7 % 40, k % 9, (k * 13 + f) % 5 + 1
            lines.append(f"{u}\t{i}\t{r}\t0")
            want[u, i] = float(r)
        (tmp_path / f"part-{f}.txt").write_text("\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("1k", "7k", "128m"):
            spark.conf.set(key, size)
            rows = R.last_arrival(R.read_arrivals(spark, str(tmp_path))).collect()
            assert {(r.user_id, r.item_id): r.rating for r in rows} == want, size
    finally:
        spark.conf.set(key, before)


def test_tasks_follow_the_lines_with_the_same_rows(spark, monkeypatch):
    """Joins, sorts and sums of the derivation hold TASK_ROWS rows a task, not a share of the input, and no broadcast table."""
    lines = spark.createDataFrame([(k, k % 17, float(k % 50), k % 7) for k in range(3000)], "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int")
    orders = spark.createDataFrame([(k, k % 23) for k in range(3000)], "o_orderkey long, o_custkey long")
    plain = sorted(map(tuple, R.derive_ratings(lines, orders).collect()))
    assert R.tasks_of(lines.count(), spark) is None
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    tasks = R.tasks_of(lines.count(), spark)
    dealt = R.derive_ratings(lines, orders, tasks)
    assert tasks == 30 and dealt.rdd.getNumPartitions() == 30
    assert "Broadcast" not in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, dealt.collect())) == plain


@pytest.mark.parametrize("query", ["last_rating_wins", "bias_sequential"])
def test_queries_deal_their_lines_by_number(spark, monkeypatch, query):
    from bridgerec.plans import queries as Q

    if query == "last_rating_wins":
        want = sorted(map(tuple, Q.last_rating_wins(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(R, "TASK_ROWS", 300)
    out = getattr(Q, query)(spark, "/root/testdata/sf0.001")
    if query == "last_rating_wins":
        assert out.rdd.getNumPartitions() > 8
        assert sorted(map(tuple, out.collect())) == want
    else:
        assert out.count() > 0
