"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

1. Each text, with every run of \\x20 and \\x09-\\x0D as one space, is cut into chunks where
   its own content says so: after a full stop and space once a chunk has ``LEAST`` characters,
   at ``MOST`` characters at the latest. Equal texts have equal chunks.
2. The chunk dictionary: distinct (64-bit hash, chunk) pairs. This is the only time that
   texts move, once for each distinct chunk of a map task; a hash that stands for two
   different chunks is found here by comparing the chunks themselves.
3. A recipe is the ordered list of a text's chunk identifiers. An identifier is the hash; where
   a hash is not unique, it is the SHA-256 of the chunk. Those recipes are made once for each
   text, by its own SHA-256, and every row stays a row. Texts are equal when their recipes are.
4. Recipes are grouped with partial aggregation, and the groups are joined back to the ids.
   Both sides of that join are dealt anew by the recipe, so a recipe that a third of all
   rows share is split by Spark's skew join.

Null texts count as empty, empty tables give none. Rows that repeat both text and doc_id can't
be told apart and share their fate: each has its row in the result, all counted in group_size.
Rows that share a doc_id but not their text belong to different groups. Rows without an id never
stay before one with an id; a group of only such rows has a null keep_id and all of it is kept.
Ids may be of any type that has an order. Extra columns are ignored, or kept by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.batches import text_or_empty, written

LEAST, MOST = 512, 4096
BLANKS = r"[\x20\x09-\x0D]+"
#: Lazy: the first end of a sentence after LEAST characters, or MOST characters, or the rest.
CHUNK = rf"(?s).{{{LEAST},{MOST - 2}}}?\. |.{{1,{MOST}}}"


def normalised(text: str = "text"):
    return F.regexp_replace(text_or_empty(text), BLANKS, " ")


def chunk_hash(chunk):
    return F.xxhash64(chunk)


def chunked(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, chunks (an empty text has none) and text_sha256 of every row."""
    whole = df.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"))
    return whole.select("doc_id", F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"), F.sha2("norm", 256).alias("text_sha256"))


def ambiguous_hashes(chunks: DataFrame) -> DataFrame:
    """Hashes that stand for more than one chunk, by comparing the chunks; normally none."""
    each = chunks.select(F.explode("chunks").alias("chunk")).select(chunk_hash("chunk").alias("h"), "chunk")
    return each.distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def recipes(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, recipe (ordered chunk identifiers) and text_sha256 of every row; written to the shared folder."""
    chunks = chunked(df, text, doc_id)
    rows = written(chunks.select("doc_id", "text_sha256", F.transform("chunks", lambda x: chunk_hash(x)).alias("recipe")), "recipes")
    named = rows.withColumn("recipe", F.transform("recipe", lambda x: x.cast("string")))
    doubtful = ambiguous_hashes(chunks)
    if not doubtful.take(1):  # every 64-bit identifier is verified
        return named
    each = chunks.select("text_sha256", F.posexplode("chunks").alias("at", "chunk")).withColumn("h", chunk_hash("chunk"))
    each = each.join(doubtful.withColumn("doubtful", F.lit(True)), "h", "left")
    name = F.when(F.col("doubtful"), F.sha2("chunk", 256)).otherwise(F.col("h").cast("string"))
    places = each.groupBy("text_sha256", "at").agg(F.min(F.struct(name.alias("name"), F.coalesce("doubtful", F.lit(False)).alias("doubtful"))).alias("x"))
    lists = places.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("at", "x.name"))).alias("parts"), F.max("x.doubtful").alias("any")).where("any")
    strong = written(lists.select(F.substring("text_sha256", 1, 64).alias("same"), F.col("parts.name").alias("strong")), "strong")
    both = named.join(strong.hint("merge"), named["text_sha256"] == strong["same"], "left")
    return both.select("doc_id", F.coalesce("strong", "recipe").alias("recipe"), "text_sha256")


def exact_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row for each row of ``df``."""
    rows = recipes(df, text, doc_id)
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # the expression makes Spark deal the groups anew, so that the join's sides can both be split
    groups = groups.where("group_size > 1").select(F.slice("recipe", 1, F.size("recipe")).alias("same"), "keep_id", "group_size")
    joined = rows.join(groups.hint("merge"), rows["recipe"] == groups["same"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def deduplicate(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` without the rows whose text an earlier row has; same columns. Decisions come back by id and text: an id may repeat with other texts, or be null."""
    gone = exact_duplicates(df, text, doc_id).where(~F.col("kept")).select(F.col("doc_id").alias("_corvane_id"), F.col("text_sha256").alias("_corvane_sha256"))
    return df.join(gone, F.col(doc_id).eqNullSafe(F.col("_corvane_id")) & (F.sha2(normalised(text), 256) == F.col("_corvane_sha256")), "left_anti")
