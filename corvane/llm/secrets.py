"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every file is addressed by the SHA-256 of its content. A ledger holds, for
each (blob, rule, rule version), the spans that the rule found; a scan looks only at pairs
the ledger lacks, and findings are joined back to every path and version with that content.

The ledger is a folder of Parquet files in shared storage. ``update`` appends what a scan adds
(``read_ledger`` and ``update`` are all that a nightly job needs), and a rule of a new version is
the only one that old blobs are scanned for.

Spans are code points, end exclusive: leftmost matches that don't overlap, one rule at a
time, then those whose checked group is too short are dropped. A match's offset is the running
sum of what lies between the matches and of the matches before it, by a window over the blob's
own matches, so a text with very many costs in proportion. Null contents are empty blobs. An
unknown rule name in a ledger is kept and ignored, and pairs that it has twice count once. Paths
and versions may repeat; every row of the input has its row in the result. An empty table adds
nothing. Extra columns stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.batches import forget, shuffles_end, text_or_empty, written


@dataclass(frozen=True)
class Rule:
    """A pattern; the part ``group`` of a match must have ``least`` characters. A changed rule gets a new version."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


#: The base kinds in their order.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),  # as AKIA[A-Z0-9]+ of 16 or more: runs are maximal
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),  # as [0-9a-f]+ of 32 or more
)
#: Kinds that are scanned besides: headers of private keys, signed tokens, and credentials inside addresses.
RULES = (
    *BASE_RULES,
    Rule("key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 24),
    Rule("login", 1, r"[a-z][a-z0-9+.-]{0,20}://[^\x00-\x20/:@]{1,256}:([^\x00-\x20/:@]{1,256})@", 1, 4),
)
LEDGER = T.StructType([T.StructField("blob_id", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])


def empty_ledger(spark: SparkSession) -> DataFrame:
    nothing = spark.range(0)  # a plan of the JVM's own: no rows come from Python
    return nothing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in LEDGER.fields])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger that ``update`` keeps at ``path``."""
    return spark.read.schema(LEDGER).parquet(path)


def rule_matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap, size, tested>> of a rule's matches in order: code points before it, of it, and of the group that is tested."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches))
    long = lambda x: F.length(x).cast("long")
    both = F.zip_with(matches, tested, lambda a, b: F.struct(long(a).alias("size"), long(b).alias("tested")))
    found = F.zip_with(both, gaps, lambda x, gap: F.struct(long(gap).alias("gap"), x["size"].alias("size"), x["tested"].alias("tested")))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast("array<struct<gap:bigint,size:bigint,tested:bigint>>"))


def spans_of(matches: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows from (blob_id, rule, version, matches): running offsets, and the matches that pass their test."""
    none = F.array().cast("array<array<bigint>>")
    bare = matches.where(F.size("matches") == 0).select("blob_id", "rule", "version", none.alias("spans"))
    least = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.least)])
    each = matches.where(F.size("matches") > 0).select("blob_id", "rule", "version", F.posexplode("matches").alias("at", "x")).select("blob_id", "rule", "version", "at", "x.*")
    before = Window.partitionBy("blob_id", "rule", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    kept = F.when(F.col("tested") >= least[F.col("rule")], F.array(F.col("end") - F.col("size"), F.col("end")))
    return bare.unionByName(placed.groupBy("blob_id", "rule", "version").agg(F.array_sort(F.collect_list(kept)).alias("spans")))


def address(versions: DataFrame, text: str = "text", blob_id: str = "blob_id") -> DataFrame:
    """``versions`` with the SHA-256 of their content."""
    return versions.withColumn(blob_id, F.sha2(text_or_empty(text), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows: one for each rule and blob of ``versions`` that ``ledger`` doesn't have.

    Blobs are made distinct by address and content (with partial aggregation), so copies are
    scanned once and any clash of addresses would show as two blobs rather than hide one.
    """
    content = text_or_empty(text)
    blobs = versions.select(F.sha2(content, 256).alias("blob_id"), content.alias("content")).distinct()
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is not None:
        known = F.concat_ws(":", "rule", "version").isin([f"{r.name}:{r.version}" for r in rules])
        seen = ledger.where(known).groupBy("blob_id").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))  # as many as rules at most
        blobs = blobs.join(seen, "blob_id", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<struct<rule:string,version:int>>"))))
    else:
        blobs = blobs.withColumn("todo", wanted)
    asked = lambda r: F.array_contains(F.col("todo"), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")))
    found = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.when(asked(r), rule_matches(F.col("content"), r)).alias("matches")) for r in rules])
    each = blobs.where(F.size("todo") > 0).select("blob_id", F.explode(F.filter(found, lambda x: x["matches"].isNotNull())).alias("x")).select("blob_id", "x.*")
    matches = written(each, "matches")
    found = spans_of(matches, rules)
    found.corvane_matches = matches  # what the lazy rows are read from
    return found


def update(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Append to the ledger at ``path`` what ``versions`` add to it, and read it."""
    spark = versions.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there)
    found = scan_unseen(versions, read_ledger(spark, path) if exists else None, rules, text)
    with shuffles_end(spark):
        found.write.mode("append").parquet(path)
    forget(found.corvane_matches)
    return read_ledger(spark, path)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "findings") -> DataFrame:
    """``versions`` with ``out``, a map from rule name to spans, for the current rule versions; ``out`` must be a new name."""
    if out.lower() in {c.lower() for c in versions.columns}:
        raise ValueError(f"there is a column {out} already: give another name as out")
    current = ledger.where(F.concat_ws(":", "rule", "version").isin([f"{r.name}:{r.version}" for r in rules]))
    by_blob = current.groupBy("blob_id").agg(F.map_from_entries(F.collect_set(F.struct("rule", "spans"))).alias(out))
    by_blob = by_blob.where(F.exists(F.map_values(out), lambda x: F.size(x) > 0))
    known = by_blob.select(F.substring("blob_id", 1, 64).alias("_corvane_blob"), out)  # dealt anew, so that a common blob can be split
    addressed = address(versions, text, "_corvane_address")
    return addressed.join(known.hint("merge"), F.col("_corvane_address") == F.col("_corvane_blob"), "left").drop("_corvane_address", "_corvane_blob")


def joined_spans(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of all findings, by start and then in the rules' order, comma-joined."""
    none = F.array().cast("array<array<bigint>>")

    def placed(i: int):
        return lambda x: F.struct(x[0].alias("start"), F.lit(i).alias("kind"), x[1].alias("end"))

    every = [F.transform(F.coalesce(found[r.name], none), placed(i)) for i, r in enumerate(rules)]
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(F.array_sort(F.concat(*every)), lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
