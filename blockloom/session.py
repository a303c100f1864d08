"""Session-level helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task sorts.
TASK = 1_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is configured (tests)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files as soon as they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy cuts the lineage, survives lost executors and can be re-read with
    pruned columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with releasing(spark):  # the copy is read from now on
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(kept: DataFrame) -> None:
    """Remove the files of a table that ``keep`` has stored and nothing will read again."""
    spark = kept.sparkSession
    folders = {os.path.dirname(f) for f in kept.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if os.path.basename(os.path.dirname(folder)) == os.path.basename(shared_dir(spark)):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df``, which has about ``rows`` rows, dealt by ``by`` into tasks of bounded size: more than the session's number where ``TASK`` rows for each don't suffice."""
    parts = -(-rows // TASK)
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*by)


def bounded_broadcast(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
