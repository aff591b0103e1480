"""Session helpers that every part of the library shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the test tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path where all executors see it: below ``spark.checkpoint.dir``, or a temporary one if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corvane-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def files_of(spark: SparkSession, path: str):
    """(file system, path) of the JVM, for what Spark's readers and writers don't do: look, rename, delete."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), there


def put_files(spark: SparkSession, folder: str, files: dict[str, bytes]) -> str:
    """Write small files below a folder of any store."""
    for name, content in files.items():
        store, path = files_of(spark, f"{folder}/{name}")
        out = store.create(path)
        out.write(bytearray(content))
        out.close()
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new shared folder and read again: nothing is lost with an executor, and Spark knows its size."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.corvane_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing reads any more: what came of them is written, too."""
    for table in tables:
        store, path = files_of(table.sparkSession, table.corvane_path)
        store.delete(path, True)


@contextmanager
def shuffles_end(spark: SparkSession):
    """What is run in here has its shuffle files deleted when it has ended, not when its references happen to be collected; the session's setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once for several uses: a checkpoint in the session's shared folder, which Spark's cleaner can delete, or else kept by the executors.

    A checkpoint is written by a second job over the rows; they are held for it, so that it doesn't compute them again.
    """
    held = df.persist()
    if not df.sparkSession.sparkContext.getCheckpointDir():
        return held
    found = held.checkpoint()
    held.unpersist()
    return found


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, where it is read in fewer: a small file is one task, and large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
