import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from bridgerec.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bridgerec-test-ckpt-"))
    yield s
    s.stop()


def ratings_df(spark, rows):
    from bridgerec.sources.ratings import RATING_SCHEMA

    return spark.createDataFrame([(int(u), int(i), float(r)) for u, i, r in rows], RATING_SCHEMA)
