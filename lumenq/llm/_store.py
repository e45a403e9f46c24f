"""Scratch tables in the folder that all nodes share, and checks before broadcasting."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (a few longs each) up to which it may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Whether a query's shuffle files go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes after which a batch of rows goes to a Python worker, and the session's setting of them.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Where none is set, a local master gets a temporary folder; a cluster has no folder
    that all its nodes share unless one is named, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lumenq-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def shuffles_end(spark: SparkSession):
    """Shuffle files of writes in this block are deleted when the write ends: its table takes their place."""
    return _setting(spark, _CLEANUP, "true")


def short_batches(spark: SparkSession):
    """Python workers get batches of about ``BATCH_BYTES`` in this block, each of which lies in an executor several times over."""
    return _setting(spark, _BATCH, str(BATCH_BYTES))


class Scratch:
    """Tables of one run of an operator, each written once and read from shared storage.

    A written table cuts the lineage: an executor lost later costs its tasks, not the
    steps before.  Tables are dropped as soon as the next step no longer reads them; those
    that an operator's result still reads stay until ``clean``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lumenq/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _ROOTS.append(self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = self.path(name)
        with shuffles_end(self.spark):
            df.write.options(**options).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._lumenq_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that save() returned."""
        for table in tables:
            self.delete(table._lumenq_path)

    def delete(self, path: str) -> None:
        fs, at = file_system(self.spark, path)
        fs.delete(at, True)


_ROOTS: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this process; call it when every result has been written."""
    while _ROOTS:
        fs, at = file_system(spark, _ROOTS.pop())
        fs.delete(at, True)


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have at most ``most`` rows, else as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df
