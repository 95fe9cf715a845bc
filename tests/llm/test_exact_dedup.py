"""Exact duplicates against a dictionary of normalised texts, and the query against its SQL."""

import hashlib
import random
import re
import sys

import pytest
from oracle_compare import compare, duck

from bridgerec.llm.exact_dedup import drop_exact_copies, exact_dedup
from bridgerec.llm.oracle import EXACT_DEDUP
from bridgerec.llm.queries import op11_exact_dedup
from bridgerec.llm.staging import Stage, ship_package

DDL = "doc_id long, text string"


def brute(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), sys.maxsize if doc is None else doc, i, doc))
    out = []
    for norm, members in groups.items():
        members.sort()
        for m in members:
            out.append((m[3], members[0][3], len(members), m is members[0], hashlib.sha256(norm.encode()).hexdigest()))
    return out


def got(spark, rows, partitions=None):
    ship_package(spark)
    docs = spark.createDataFrame(rows, DDL)
    docs = docs.repartition(partitions) if partitions else docs
    return [tuple(r)[:5] for r in exact_dedup(docs, Stage(spark, "t")).collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("seed", range(3))
def test_random_groups(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab \n\x0b é", k=rng.randint(0, 7))) for _ in range(300)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert sorted(got(spark, rows)) == sorted(brute(rows))


def test_a_large_group_over_many_tasks(spark):
    rows = [(i, " " * (i % 4) + "the same text") for i in range(4000)] + [(5000 + i, f"other {i}") for i in range(2000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stage = Stage(spark, "t")
        found = exact_dedup(spark.createDataFrame(rows, DDL), stage)
        assert sorted(tuple(r)[:5] for r in found.collect()) == sorted(brute(rows))
        tasks = spark.read.parquet(stage.path("runs")).filter("norm is not null and size > 1").count()
        assert tasks > 2  # the group was split
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_nulls_empty_long_ties_and_repeats(spark):
    long = "wörd " * 200_000
    rows = [(1, None), (2, ""), (3, " \t"), (None, "x y"), (4, "xy"), (4, "xy"), (None, "z"), (None, "z"), (9, long), (8, long), (7, long[:-1] + "!")]
    assert sorted(got(spark, rows), key=key) == sorted(brute(rows), key=key)
    assert got(spark, []) == []


def test_texts_that_share_their_beginning(spark):
    rows = [(i, "common " * 50 + str(i % 7)) for i in range(100)]
    assert sorted(got(spark, rows)) == sorted(brute(rows))


def test_extra_columns_with_the_operators_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, b"x"), (2, "ab", 6, b"y")], "doc_id long, text string, keep_id int, digest binary")
    found = exact_dedup(docs, Stage(spark, "t"))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "doc"]
    kept = drop_exact_copies(docs, Stage(spark, "t"))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_dropping_leaves_one_row_of_each_group(spark):
    rows = [(1, "a"), (1, "a"), (2, "a "), (3, "b"), (None, None), (None, ""), (5, "c"), (5, "c")]
    kept = sorted(map(tuple, drop_exact_copies(spark.createDataFrame(rows, DDL), Stage(spark, "t")).collect()), key=key)
    empty = kept.pop(0)
    assert empty in ((None, ""), (None, None)) and kept == [(2, "a "), (3, "b"), (5, "c")]


def test_query_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    rows, problems = compare(spark, duck(folder), folder, op11_exact_dedup, EXACT_DEDUP)
    assert rows == 1000 and not problems
