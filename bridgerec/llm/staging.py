"""Tables and files that a job writes for its own later stages.

They live in the folder named by ``spark.checkpoint.dir``, which all executors
share, so a lost executor costs only a re-read.  Each :class:`Stage` owns one
folder there; ``drop`` removes a table as soon as it is no longer needed and
the rest goes when the application ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bridgerec.session import ensure_checkpoint_dir, ship_package  # noqa: F401


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Stage:
    """A private folder in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet now and return a frame that reads it back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for n in names:
            _delete(self.spark, self.path(n))

    def _at_exit(self) -> None:
        # the session may be gone already; its folder then goes with the cluster's own cleaning
        with contextlib.suppress(Exception):
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)


#: Rows of a few narrow columns that may be broadcast.
BROADCAST_ROWS = 1_000_000


def maybe_broadcast(narrow: DataFrame, weight: str = "1") -> DataFrame:
    """``narrow`` with a broadcast hint if the sum of ``weight`` over it is at most
    ``BROADCAST_ROWS``; else as it is, for Spark to join by a shuffle."""
    total = narrow.selectExpr(f"sum({weight})").first()[0] or 0
    return F.broadcast(narrow) if total <= BROADCAST_ROWS else narrow


def row_key(id_col: str, text_col: str) -> Column:
    """A hash that stands for a document: rows that agree in id and text share it."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
