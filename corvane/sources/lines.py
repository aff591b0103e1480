"""Text files as numbered lines and as trees of digests, whatever the number of their splits.

A large file is read in blocks by many tasks, and no task knows how many lines the blocks before
its own have. So lines are first written with the block that they are from and their order in
it; then each block is one row with its number of lines, sums over the blocks of a source give
where each begins, and these meet the lines again. Only blocks are ordered in one task, one row
for each 128 MB. The lines are written once because two scans of the same files may be cut
differently where the cluster grows in between.

A source is a file or a folder of files (as Spark writes them), numbered through in the order of
their names. Lines end with \\n or \\r\\n; the last may lack its end. An empty source has no lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import shared_folder, written

#: Digests under one node of a tree.
FAN_OUT = 4096


def block_lines(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """name, file, block, at (ascending in a block) and value (with \\r where the file has it) of every line."""
    found = None
    for name, path in sources.items():
        rows = spark.read.option("lineSep", "\n").text(path).select(
            F.lit(name).alias("name"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value",
        )
        found = rows if found is None else found.unionByName(rows)
    return written(found, "lines")


def numbered_lines(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """name, line (from 1) and value of every line of the named files or folders."""
    rows = block_lines(spark, sources)
    blocks = rows.groupBy("name", "file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("name").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that Spark sees how small the table of blocks is and sends it to the lines, not the lines to it
    begins = written(blocks.select("name", "file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), "blocks")
    line = F.col("earlier") + F.col("at") - F.col("first") + 1
    return rows.join(begins, ["name", "file", "block"]).select("name", line.alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1) and value of a text file or of a folder of such files."""
    return numbered_lines(spark, {"": path}).select("line", "value")


def tree_fingerprints(lines: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """name, lines and fingerprint of sources as ``numbered_lines`` gives them.

    The digest of a line is the SHA-256 of its bytes in hexadecimal; of each ``fan_out`` digests in
    order, that of the digests joined; and so on until one is left, at least once. So a file is
    digested in parallel, and no row is larger than a line or than ``fan_out`` digests.
    """
    sizes = lines.groupBy("name").agg(F.count("*").alias("lines"))
    most = sizes.agg(F.max("lines")).first()[0] or 0
    nodes = lines.select("name", (F.col("line") - 1).alias("at"), F.sha2("value", 256).alias("digest"))
    nodes = nodes.join(sizes.withColumnRenamed("lines", "left"), "name")
    first = True
    while first or most > 1:
        above = nodes.groupBy("name", "left", F.expr(f"`at` div {fan_out}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "digest")))["digest"].alias("all"))  # fan_out at most
        whole = F.lit(False) if first else F.col("left") <= 1  # lower trees are done before the tallest
        digest = F.when(whole, F.col("all")[0]).otherwise(F.sha2(F.array_join("all", ""), 256))
        nodes = above.select("name", F.ceil(F.col("left") / fan_out).alias("left"), F.col("up").alias("at"), digest.alias("digest"))
        most, first = -(-most // fan_out), False
    return sizes.join(nodes.select("name", F.col("digest").alias("fingerprint")), "name")
