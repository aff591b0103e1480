"""The data side of training: limits, order and groups of examples. The training itself is not built."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.json_text import completion_start

MOST_SEQUENCE, MOST_COMPLETION = 1536, 256
BIN_ROWS = 1_000_000


def length_violations(rows: DataFrame, row_id: str, prompt: str, full: str) -> DataFrame:
    """id and rule of rows whose completion boundary or length is out of bounds; ``prompt`` and ``full`` are arrays of ids."""
    start = completion_start(F.col(prompt), F.col(full))
    rule = F.when(start.isNull(), "completion_boundary").when(F.size(full) > MOST_SEQUENCE, "sequence_length").when(F.size(full) - start > MOST_COMPLETION, "completion_length")
    return rows.select(F.col(row_id).alias("id"), rule.alias("rule")).where("rule IS NOT NULL")


def epoch_groups(rows: DataFrame, row_id: str, seed: int, epoch: int, size: int) -> DataFrame:
    """id, place and group of every row in an epoch's order: a hash of seed, epoch and id, cut into groups of ``size``.

    The order is reproducible, but not that of any other random generator. Places are found
    without one global sort in one task: rows are counted by range of the hash first. There are as
    many ranges as keep each at some BIN_ROWS rows, so no task grows with the table; where a
    trillion rows would make a million ranges, their counts are what one task adds up.
    """
    bits = max(4, math.ceil(math.log2(max(1, rows.count() / BIN_ROWS))))
    mixed = rows.select(F.col(row_id).alias("id"), F.xxhash64(F.lit(seed), F.lit(epoch), F.col(row_id)).alias("h")).withColumn("bin", F.shiftright("h", 64 - bits))
    counts = mixed.groupBy("bin").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)))  # a row a range
    inside = F.row_number().over(Window.partitionBy("bin").orderBy("h", "id"))
    placed = mixed.join(before, "bin").withColumn("place", inside - 1 + F.coalesce("before", F.lit(0)))
    return placed.select("id", "place", F.floor(F.col("place") / size).alias("group_no"))
