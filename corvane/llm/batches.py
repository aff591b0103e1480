"""What the Arrow-backed operators share: sessions, batch sizes, checkpoints."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import shuffles_end

#: Bytes of text that a Python worker works on at once, whatever the size of the Arrow batches that the session makes.
BYTES_AT_ONCE = 4 << 20

pa.set_memory_pool(pa.system_memory_pool())  # so that release() can give Arrow's memory back, too


def release() -> None:
    """Give freed memory back to the machine: a Python worker lives on between tasks and shares its executor's limit."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; nothing depends on it


def send_package(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    context = spark.sparkContext
    if not getattr(context, "corvane_sent", False):
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="corvane-code-")
        context.addPyFile(shutil.make_archive(f"{folder}/corvane_code", "zip", package.parent, package.name))
        context.corvane_sent = True


def runs_of_rows(texts: pa.Array, size: int = BYTES_AT_ONCE) -> list[tuple[int, int]]:
    """(from, to) of runs of rows whose texts have ``size`` bytes together, one row at least."""
    n = len(texts)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    found, at = [], 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        found.append((at, stop))
        at = stop
    return found


def in_pieces(texts: pa.Array, function: Callable[[pa.Array], pa.Array], size: int = BYTES_AT_ONCE) -> pa.Array:
    """``function`` on runs of rows whose texts have ``size`` bytes together, one row at least, and the results as one array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.nbytes <= size or len(texts) <= 1:
        return function(texts)
    found = []
    for a, b in runs_of_rows(texts, size):
        found.append(function(texts.slice(a, b - a)))
        release()
    return pa.concat_arrays(found)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; where none is set, a temporary one, but only if all runs on this machine."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: short lineage, nothing lost with an executor, no shuffle files left."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.corvane_path = path
    return table


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: what came of them is written, too."""
    for table in tables:
        delete(table.sparkSession, table.corvane_path)


def long_ids(docs: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with an id of type long in the place of ``doc_id``, in the same order; and for other types the table (_name, _long) of what stands for what.

    Integers stay as they are. Other ids are numbered by range, in their order; null stays null.
    """
    kind = docs.schema[doc_id].dataType
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return docs.withColumn(doc_id, F.col(doc_id).cast("long")), None
    ids = docs.select(F.col(doc_id).alias("_name")).where("_name IS NOT NULL").distinct().orderBy("_name")
    names = written(ids.withColumn("_long", F.monotonically_increasing_id()), "ids")
    joined = docs.join(names.hint("merge"), F.col(doc_id) == F.col("_name"), "left")
    return joined.withColumn(doc_id, F.col("_long")).select(*docs.columns), names


def named_back(found: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """``found`` with the ids that ``long_ids`` put others in the place of."""
    if names is None:
        return found
    order = found.columns
    for column in columns:
        back = names.select(F.col("_long").alias("_at"), F.col("_name").alias("_back"))
        found = found.join(back.hint("merge"), F.col(column) == F.col("_at"), "left").withColumn(column, F.col("_back")).drop("_at", "_back")
    return found.select(*order)


def text_or_empty(text: str = "text"):
    """The text column; null counts as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def dealt_anew(key: str):
    """An integer key under another name for the planner.

    A table grouped by ``key`` that is joined on it keeps its partitions, and then a hot key's
    rows on the other side can't be split. Joined on this expression, both sides are dealt for
    the join, and Spark's skew join may split them.
    """
    return F.bitwise_not(F.col(key))
