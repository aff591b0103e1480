"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

1. Doubling: every suffix of a document's sequence of lines has a rank by its first k lines:
   equal ranks, equal k lines. Ranks of 2k lines are the order of the pairs (rank, rank k lines
   on). k grows to ``min_lines``, the last time with overlap, and doubles from there for as long
   as anything repeats. Each round groups the pairs with partial aggregation, sorts the distinct
   pairs that occur more than once by range, and joins the ranks back; a suffix alone in its
   interval of the suffix array leaves at once, so a round costs what still repeats.
2. Intervals: suffixes of one rank share k lines. The earliest of each (by doc_id and line)
   stays. Every other suffix takes the longest k at which it isn't the earliest, and the
   interval's earliest suffix there as its source.
3. Longest common prefixes: with its source a suffix shares k lines, but not 2k. The ranks of
   shorter prefixes, from the longest down, tell how many more: each is compared once, at the
   place that both have reached, and moves both on where it is equal.
4. Runs: a suffix's lines up to its longest common prefix start earlier. Runs that continue the
   one a line before from the same source are part of it; the others are the maximal repeated
   runs. What they cover is deleted, so that only the earliest copy of each is left.

All runs of ``min_lines`` or more that start earlier are covered, whichever source was taken: a
run's first min_lines lines make its suffix one that isn't its interval's earliest. Rank tables
are written, so that joins deal both sides anew and Spark can split the rows of a line that is in
a third of all documents. Only DataFrame functions are used.

Lines are separated by \\n and compared as they are, blank ones too, by two 64-bit hashes. Nulls
are empty texts: one empty line. Rows that repeat both doc_id and text count once and share the
result; of rows that share a doc_id, the one with the smaller hash of its text counts as earlier
where lines have the same number. A null id comes first. Empty tables give none. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.batches import dealt_anew, forget, text_or_empty, written

MIN_LINES = 1
PLACE = ("doc_id", "t", "at")


def ranked(suffixes: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The suffixes whose keys occur more than once, with the keys' place in sorted order as ``rank``; written."""
    distinct = suffixes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    places = written(distinct.orderBy(*keys).withColumn(rank, F.monotonically_increasing_id()), "ranks")
    named = places.select(*[F.col(k).alias(f"_{k}") for k in keys], rank)
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    found = written(suffixes.join(named.hint("merge"), same).drop(*keys, *[f"_{k}" for k in keys]), "suffixes")
    forget(places)
    return found


def longer(current: DataFrame, step: int) -> DataFrame:
    """From ranks of k lines those of k + step, step <= k, of the suffixes that still repeat; written."""
    in_text = Window.partitionBy("doc_id", "t").orderBy("at").rangeBetween(step, step)  # the suffix ``step`` lines on, if that repeats, too
    pairs = written(current.withColumn("ahead", F.first("r").over(in_text)).where("ahead IS NOT NULL").withColumnRenamed("r", "a"), "pairs")
    found = ranked(pairs, ["a", "ahead"], "r")
    forget(pairs)
    return found


def doubled(df: DataFrame, min_lines: int, text: str, doc_id: str) -> list[tuple[int, DataFrame]]:
    """(length, suffixes(doc_id, t, at, r) whose first so many lines repeat), by length: up to min_lines, then its doubles until nothing repeats."""
    texts = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("t"), F.posexplode(F.split(text_or_empty(text), "\n", -1)).alias("at", "line"))
    lines = written(texts.select("doc_id", "t", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).distinct(), "lines")
    levels = [(1, ranked(lines, ["h1", "h2"], "r"))]
    forget(lines)
    while levels[-1][1].take(1):
        length, current = levels[-1]
        step = min(length, min_lines - length) if length < min_lines else length
        levels.append((length + step, longer(current, step)))
    forget(levels.pop()[1])
    return levels


def at_place(level: DataFrame, name: str, *place) -> tuple[DataFrame, list]:
    """A level's ranks under ``name``, and the condition by which they belong to a place (doc_id, t, at)."""
    there = level.select(*[F.col(c).alias(f"_{name}_{c}") for c in PLACE], F.col("r").alias(name))
    return there.hint("merge"), [place[0].eqNullSafe(F.col(f"_{name}_doc_id")), place[1] == F.col(f"_{name}_t"), place[2] == F.col(f"_{name}_at")]


def repeated_runs(df: DataFrame, min_lines: int = MIN_LINES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, t (hash of the text), at, n: where n lines start that also start earlier, at ``source`` (doc_id, at, t); n >= min_lines. Runs inside a longer one of the same source are left out."""
    levels = doubled(df, min_lines, text, doc_id)
    later = None
    for length, level in levels:
        if length < min_lines:
            continue
        first = level.groupBy("r").agg(F.min(F.struct("doc_id", "at", "t")).alias("source")).select(dealt_anew("r").alias("same"), "source")
        joined = level.join(first.hint("merge"), dealt_anew("r") == F.col("same")).where(~F.struct("doc_id", "at", "t").eqNullSafe(F.col("source")))
        here = joined.select(*PLACE, F.lit(length).alias("n"), "source")
        later = here if later is None else later.unionByName(here)
    if later is None:
        kind = df.schema[doc_id].dataType
        empty = df.limit(0).select(F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("t"), F.lit(0).alias("at"), F.lit(0).alias("n"))
        return empty.withColumn("source", F.struct("doc_id", "at", "t"))
    state = written(later.groupBy(*PLACE).agg(F.max(F.struct("n", "source")).alias("x")).select(*PLACE, "x.n", "x.source"), "runs")
    for k in range(len(levels) - 2, -1, -1):
        step, level = levels[k]
        own, mine = at_place(level, "mine", F.col("doc_id"), F.col("t"), F.col("at") + F.col("n"))
        other, theirs = at_place(level, "theirs", F.col("source.doc_id"), F.col("source.t"), F.col("source.at") + F.col("n"))
        open_ = F.col("n") >= 2 * step if step >= min_lines else F.lit(True)  # shorter suffixes are settled: the next double isn't shared
        moved = state.where(open_).join(own, mine).join(other, theirs).where("mine = theirs").select(*PLACE, F.lit(step).alias("more"))
        named = moved.select(*[F.col(c).alias(f"_{c}") for c in PLACE], "more").hint("merge")
        same = [F.col("doc_id").eqNullSafe(F.col("_doc_id")), F.col("t") == F.col("_t"), F.col("at") == F.col("_at")]
        after = written(state.join(named, same, "left").select(*PLACE, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "source"), "runs")
        forget(state)
        state = after
    forget(*[level for _, level in levels])
    in_text = Window.partitionBy("doc_id", "t").orderBy("at")
    before = F.lag(F.struct("at", "n", "source")).over(in_text)
    inside = (before["at"] == F.col("at") - 1) & before["source"]["doc_id"].eqNullSafe(F.col("source.doc_id")) & (before["source"]["t"] == F.col("source.t")) & (before["source"]["at"] == F.col("source.at") - 1)
    return state.where("n >= 1").withColumn("inside", F.coalesce(inside & (before["n"] == F.col("n") + 1), F.lit(False))).where("NOT inside").drop("inside")


def deduplicate_lines(df: DataFrame, min_lines: int = MIN_LINES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, the removed [from, to) spans of lines, and the text that is left, of every row."""
    runs = repeated_runs(df, min_lines, text, doc_id).withColumn("end", F.col("at") + F.col("n"))
    in_text = Window.partitionBy("doc_id", "t").orderBy("at")
    reached = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    numbered = runs.withColumn("new", F.coalesce(F.col("at") > reached, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(in_text))
    joined = numbered.groupBy("doc_id", "t", "run").agg(F.min("at").alias("a"), F.max("end").alias("b"))
    spans = joined.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.array("a", "b"))).alias("cuts"))  # at most one for each two lines of a text
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "cuts")
    whole = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("t"), text_or_empty(text).alias("whole"))
    both = whole.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    lines = F.split("whole", "\n", -1)
    cuts = F.coalesce("cuts", F.array().cast("array<array<int>>"))
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x[1]))
    ends = F.concat(F.transform(cuts, lambda x: x[0]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    left = F.when(F.col("cuts").isNull(), F.col("whole")).otherwise(F.array_join(kept, "\n"))
    return both.select("doc_id", F.size(lines).cast("long").alias("n_lines"), cuts.alias("spans"), left.alias("text"))
