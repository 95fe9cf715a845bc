"""Session helpers: building a session for local runs and cutting lineage.

Lineage is cut with ``DataFrame.checkpoint()`` into the folder the cluster
names in ``spark.checkpoint.dir``, which all machines must see (a ``file:`` path is
fine where it is a shared mount).  A private folder is only created when that
setting is unset *and* the master is one local JVM (tests, bench); on a cluster an
unset checkpoint folder is an error, never a silent machine-local fallback.
Checkpoint files of frames that are no longer referenced go when Spark cleans up
(``spark.cleaner.referenceTracking.cleanCheckpoints``, set for local sessions).
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "bridgerec",
    shuffle_partitions: int | None = None,
    extra_conf: dict | None = None,
    driver_memory: str = "8g",
) -> SparkSession:
    """Session for local runs; on a cluster use the cluster's own session."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    b = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra_conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting the context's folder from the
    session's ``spark.checkpoint.dir``.  Only a local master may fall back to a
    private temporary folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if re.fullmatch(r"local(\[.*\])?", sc.master):
        folder = tempfile.mkdtemp(prefix="bridgerec-ckpt-")
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir() or folder
    raise RuntimeError(
        "spark.checkpoint.dir is not set; iterative operators need a shared "
        "checkpoint folder on a cluster"
    )


#: Spark removes the shuffles of a query at its end if this was set when the query was made.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame) -> DataFrame:
    """Eagerly write ``df`` to the reliable checkpoint folder and return a
    DataFrame whose lineage starts there (survives executor loss).  The shuffles that it took leave the
    disks: nothing reads them again, as ``df`` itself would plan its own.  :func:`release` deletes the result."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with _set(spark, **{_CLEANED: "true"}):
        done = df.select("*").checkpoint(eager=True)
    done._checkpoint = done._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    return done


def materialize_step(df: DataFrame) -> DataFrame:
    """:func:`materialize` for the frame that a loop goes on from.  A checkpoint keeps its plan's
    estimate of its size, and a join or cogroup multiplies the sizes of its sides: in a loop that joins
    its own last result, the digits of the estimate double with each step until the driver has no
    memory for it.  The same rows as a new frame start without an estimate."""
    done = materialize(df)
    spark = df.sparkSession
    out = DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)
    out._checkpoint = done._checkpoint
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of results of :func:`materialize` or :func:`materialize_step` (other frames are let be) that
    nothing will read again: what came of them has a checkpoint of its own."""
    for df in frames:
        if path := df.__dict__.pop("_checkpoint", None):
            context = df.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def materialize_by(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """:func:`materialize`, dealt by a hash of ``keys`` into ``parts`` partitions that later
    joins and groupings by them use without moving the rows.  Spark knows the partitioning of
    a checkpoint only if its plan was not adaptive, so that is off for this one job."""
    with _set(df.sparkSession, **{"spark.sql.adaptive.enabled": "false"}):
        return materialize(df.repartition(parts, *keys).sortWithinPartitions(*keys))


@contextmanager
def exchanges_of(spark: SparkSession, parts: int) -> Iterator[None]:
    """Inside, every exchange has ``parts`` partitions and a query is one job.  For loops over few
    packed rows: with the session's partitions most tasks of each step would be empty, and adaptive
    execution would run each exchange as a job of its own to find that out."""
    with _set(spark, **{"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.enabled": "false"}):
        yield


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, an Arrow batch that goes to Python has so many rows: for packed rows, of which a task's memory
    takes only a few."""
    with _set(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}):
        yield


#: Rows of an Arrow batch that goes to Python.
ARROW_ROWS = 1000

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once an application; Spark serves the
    file.  Also bounds the rows that one Arrow batch of the session takes there."""
    import bridgerec

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:  # rows are whole texts; a batch is held in memory
        spark.conf.set(key, str(ARROW_ROWS))
    if (application := spark.sparkContext.applicationId) in _shipped:
        return
    _shipped.add(application)
    top = Path(bridgerec.__file__).parent
    packed = f"{tempfile.mkdtemp(prefix='bridgerec-')}/bridgerec.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(packed)
