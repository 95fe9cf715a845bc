"""WARC round trip, audit of replicas and descent of the tree."""

import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from bridgerec.llm import warc
from bridgerec.llm.staging import Stage
from bridgerec.llm.token_files import as_uri

ROWS = [(i, f"http://host{i % 7}/p?{i}", f"<html>é{i}" + "x" * (i * 37 % 900) + "</html>") for i in range(300)]
ODD = [(None, None, None), (5, "u\r\nInjected: 1", ""), (5, "u", "again"), (900, "v", "long " * 200_000)]


@pytest.fixture
def replicas(spark, tmp_path):
    stage = Stage(spark, "t")
    pages = spark.createDataFrame([(*r, "c") for r in ROWS + ODD], "page_id long, url string, html string, file string")
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    index = warc.write_warc(pages, a, stage)
    return stage, index, a, b


def found(stage, index, a, b):
    bad = warc.audit(warc.merkle_levels(index, a, stage, "a"), warc.merkle_levels(index, b, stage, "b"))
    return sorted((r.file, r.node) for r in bad.collect())


def test_round_trip(spark, replicas):
    _, index, a, _ = replicas
    got = warc.read_warc(index, a).collect()
    assert all(r.readable for r in got)
    sizes = sorted((str(r.page_id), r.n_bytes) for r in got)
    assert sizes == sorted((str(i), len((h or "").encode())) for i, _, h in ROWS + ODD)
    whole = b"".join(gzip.open(f).read() for f in glob.glob(a.removeprefix("file://") + "/*.gz"))
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS + ODD) and b"\r\nInjected" not in whole


def test_equal_replicas_have_equal_roots(replicas):
    stage, index, a, b = replicas
    warc.copy_replica(index, a, b)
    assert found(stage, index, a, b) == []


def test_flipped_records_are_found(replicas):
    stage, index, a, b = replicas
    warc.copy_replica(index, a, b, flip=F.col("page_id").isin(0, 17, 299, 900))
    want = sorted((r.file, r.place) for r in index.filter(F.col("page_id").isin(0, 17, 299, 900)).collect())
    assert found(stage, index, a, b) == want
    assert {r.page_id for r in warc.read_warc(index, b).filter("not readable").collect()} == {0, 17, 299, 900}


def test_cut_longer_and_missing_files(replicas):
    stage, index, a, b = replicas
    warc.copy_replica(index, a, b)
    files = sorted(glob.glob(b.removeprefix("file://") + "/*.gz"))
    assert len(files) >= 3
    counts = {r.file: r["count"] for r in index.groupBy("file").count().collect()}
    cut, longer, missing = (os.path.basename(f) for f in files[:3])
    os.truncate(files[0], os.path.getsize(files[0]) - 1)
    with open(files[1], "ab") as f:
        f.write(b"x")
    os.rename(files[2], files[2] + ".gone")
    got = found(stage, index, a, b)
    assert (cut, counts[cut] - 1) in got and (longer, counts[longer]) in got
    assert sum(f == missing for f, _ in got) == counts[missing] + 1
    assert {f for f, _ in got} == {cut, longer, missing}


def test_deep_tree(replicas, monkeypatch):
    monkeypatch.setattr(warc, "FAN", 2)
    stage, index, a, b = replicas
    warc.copy_replica(index, a, b, flip=F.col("page_id") == 33)
    levels = warc.merkle_levels(index, a, stage, "x")
    assert levels[-1].count() == index.select("file").distinct().count() and len(levels) > 4
    assert len(found(stage, index, a, b)) == 1


def test_empty_table(spark, tmp_path):
    stage = Stage(spark, "t")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    a = f"file://{tmp_path}/a"
    index = warc.write_warc(pages, a, stage)
    assert index.count() == 0 and found(stage, index, a, a) == [] and warc.read_warc(index, a).count() == 0


def test_damaged_member_is_refused():
    member = bytearray(warc.record(1, "u", b"hello"))
    assert warc.parse_record(bytes(member))[1] == b"hello"
    with pytest.raises((ValueError, OSError, EOFError)):
        warc.parse_record(bytes(member[:-9]))


def test_files_are_read_by_several_tasks(spark):
    stage = Stage(spark, "t")
    pages = spark.createDataFrame([(i, f"u{i}", "x" * 50) for i in range(400)], "page_id long, url string, html string")
    index = warc.write_warc(pages, as_uri(stage.path("first")), stage)
    assert index.select("file").distinct().count() > 2
    tasks = warc.read_warc(index, as_uri(stage.path("first"))).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 2
