"""N-gram Jaccard join: candidate pairs from the document by n-gram incidence, then both whole sets compared.

A document's set has the distinct runs of ``N`` words (fewer words: all of them as one); two
documents link when their sets' Jaccard similarity is at least ``PERCENT`` / 100.

1. Blocks: the corpus is dealt into batches and n-gram columns into parts; each part adds up
   how many documents have a column and replies to the batches (``exchange``).
2. Bounds: with set size n, a partner shares ceil(n * PERCENT / 100) columns or more, so it
   shares one of the n - that + 1 rarest. If the rarest shared column is number j of n, at
   most n - j columns are shared, which bounds the partner's size (the column's ``reach``).
   Columns that one document has give no pair, and entries whose reach is below every size in
   their column go. What is left of most documents is nothing.
3. Equal sets are collapsed to one representative.
4. Product: in each column every document meets the column's hub, the document with the
   smallest share of columns of its own. The whole sets of the pairs that meet are intersected,
   and those that reach the threshold are links; no overlaps are accumulated column by column,
   as that would list every pair of a column. A large group of near copies costs one pair a member.
5. Two documents that share a column and aren't in one component now: one of them, y, failed
   against the column's hub h, which both have met. The bound of step 2 holds for any order of
   columns; with the columns that h doesn't have first, y and a partner share one of the first
   n - ceil(n * PERCENT / 100) + 1 of each, within reach. Those columns are mostly y's own.
   The pairs that still meet there, not in one component, are tested one by one. So no link
   between two components is missed, and the components are those of all pairs.

Columns are 64-bit hashes of lower-cased words, and set sizes and overlaps are counted over
them; see ``words`` for the odds of a clash. Null texts and texts without words: size 0,
linked with nothing. Null ids: never linked, null component. Rows that share an id but not
their text are documents of their own; rows that share both share their fate. Ids may be of any
type, and the smallest is the first in their order. Empty tables give none. Extra columns are
ignored, or kept by ``one_of_each``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.batches import dealt_anew, forget, long_ids, named_back, send_package, text_or_empty, written
from corvane.llm.components import components
from corvane.llm.exchange import FORWARD, Batches, forward_rows, key_bits, read_totals, totals
from corvane.llm.words import NOT_BLANK, U64, Words, mix, window_hashes

N = 5
PERCENT = 80
SPARE_BITS = 16

ROWS = "doc_id long, t long, n long, set_1 long, set_2 long, own double, prefix array<long>, shared array<long>"
_ROWS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("set_1", pa.int64()), ("set_2", pa.int64()), ("own", pa.float64()), ("prefix", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of n words."""
    words = Words(texts, NOT_BLANK)
    hashes = words.hashes()
    at, runs = window_hashes(hashes, words.first, n)
    edge = np.searchsorted(at, words.first)
    out = []
    for i in range(len(texts)):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b - a >= n:
            out.append(np.unique(runs[edge[i] : edge[i + 1]]))
        else:
            out.append(window_hashes(hashes[a:b], np.array([0, b - a]), b - a)[1] if b > a else np.zeros(0, U64))
    return out


def text_hash(text: str):
    return F.xxhash64(text_or_empty(text))


def document_rows(docs: DataFrame, n: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """One row for each row of ``docs``: set size and identity; and of possible partners' columns, the rarest and all."""
    send_package(docs.sparkSession)
    corpus = Batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_hash(text).alias("t")))
    bits, parts = key_bits(corpus.chars // 2, SPARE_BITS), corpus.parts(corpus.chars / 6)
    shift = U64(64 - bits)

    def send(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.concatenate(shingle_sets(table["text"], n)) >> shift, return_counts=True)
        return forward_rows(table["b"][0].as_py(), [(keys, [counts], bits, parts, 0)])

    def receive(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _ROWS.empty_table()
        sets = shingle_sets(table["text"], n)
        keys = np.unique(np.concatenate(sets) >> shift)
        frequency = read_totals(replies, 0, parts, 0)
        rows: dict = {name: [] for name in _ROWS.names}
        for doc, t, own in zip(table["doc_id"].to_pylist(), table["t"].to_pylist(), sets, strict=True):
            f = frequency[np.searchsorted(keys, own >> shift)]
            first = np.argsort(f, kind="stable")[: len(own) - math.ceil(len(own) * percent / 100) + 1]  # ties by hash
            prefix = own[first][f[first] > 1]
            some = doc is not None and len(prefix) > 0
            rows["doc_id"].append(doc)
            rows["t"].append(t)
            rows["n"].append(len(own))
            rows["set_1"].append(int(mix(own).sum(dtype=U64).astype(np.int64)) if some else None)
            rows["set_2"].append(int(mix(own ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64).astype(np.int64)) if some else None)
            rows["own"].append(float((f == 1).mean()) if some else None)
            rows["prefix"].append(prefix.astype(np.int64) if some else None)
            order = np.argsort(f, kind="stable")
            rows["shared"].append(own[order][f[order] > 1].astype(np.int64) if some else None)
        return pa.table(rows, schema=_ROWS)

    replies = totals(corpus.each(send, FORWARD), parts).select("b", "part", "totals").where("b >= 0")
    rows = written(corpus.replied(replies, receive, ROWS), "sets")
    corpus.drop()
    return rows


def entries(rows: DataFrame, columns: str, percent: int) -> DataFrame:
    """``rows`` with a row for each of its ``columns`` (key), and the largest partner that may have it as rarest shared column (reach)."""
    each = rows.select("*", F.posexplode(columns).alias("at", "key")).drop(columns)
    left = F.col("n") - F.col("alone") - F.col("at")  # columns from this one on
    return each.withColumn("reach", F.floor(left * (100 + percent) / percent) - F.col("n")).drop("at", "alone")


def worth_it(columns: DataFrame) -> DataFrame:
    """The entries that can pair with any other of their column."""
    sizes = columns.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("m")).where("m > 1").select(dealt_anew("key").alias("same"), "least")
    return columns.join(sizes.hint("merge"), dealt_anew("key") == F.col("same")).where("reach >= least").drop("same", "least")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with whether they link, and b's rarest columns in the order of a's absence."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"))
    met = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    outside, inside = F.array_except("s_b", "s_a"), F.array_intersect("s_b", "s_a")  # in the order of s_b: by frequency
    overlap = F.size(inside)
    alone = F.col("n_b") - F.size("s_b")  # columns that only b has come first
    first = F.col("n_b") - F.ceil(F.col("n_b") * percent / 100) + 1 - alone
    room = F.greatest(first, F.lit(0)).cast("int")
    return met.select(
        "a", "b", F.col("n_b").alias("n"), alone.alias("alone"), (overlap * 100 >= (F.col("n_a") + F.col("n_b") - overlap) * percent).alias("linked"), F.slice(F.concat(outside, inside), F.lit(1), room).alias("rarest")
    )


def jaccard_rows(docs: DataFrame, n: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id and kept (the first of its component by id and t) of every row."""
    sets = document_rows(docs, n, percent, text, doc_id)
    rows = written(sets.withColumn("row", F.monotonically_increasing_id()), "rows")
    forget(sets)
    alone = rows.where(F.col("prefix").isNull()).select("doc_id", "t", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    some = rows.where(F.col("prefix").isNotNull())
    classes = some.groupBy("set_1", "set_2").agg(F.min(F.struct("doc_id", "t", "row")).alias("first"))
    members = some.select("doc_id", "t", "n", F.struct("set_1", "set_2").alias("set")).join(
        classes.select(F.struct("set_1", "set_2").alias("set"), F.col("first").alias("rep")).hint("merge"), "set")
    reps = written(some.join(classes.select("first.row", F.col("first").alias("rep")), "row").select("rep", "n", "own", "prefix", "shared"), "reps")
    alone_n = (F.col("n") - F.size("shared")).alias("alone")
    columns = written(worth_it(entries(reps.select("rep", "n", "own", alone_n, "prefix"), "prefix", percent)), "columns")

    hubs = columns.groupBy("key").agg(F.min(F.struct("own", "rep")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    hubs = hubs.select(dealt_anew("key").alias("at"), F.col("hub.rep").alias("a"))
    star = columns.select("key", F.col("rep").alias("b")).join(hubs.hint("merge"), dealt_anew("key") == F.col("at")).where("a <> b")
    tested = written(compared(star.select("a", "b").distinct(), reps, percent), "tested")
    links = tested.where("linked").select("a", "b")
    labels = components(links)

    named = tested.join(labels.withColumnsRenamed({"node": "b", "label": "known"}), "b", "left").withColumn("label", F.coalesce("known", "b"))
    named = written(entries(named.select("a", "b", "n", "alone", "linked", "label", "rarest"), "rarest", percent), "named")
    failed = named.where(~F.col("linked")).select(F.col("a").alias("hub"), F.col("key").alias("same"), F.col("b").alias("y"), F.col("n").alias("n_y"), F.col("reach").alias("reach_y"), F.col("label").alias("other"))
    met = (F.col("hub") == F.col("a")) & (F.col("same") == F.col("key")) & (F.col("other") != F.col("label")) & (F.col("n_y") <= F.col("reach")) & (F.col("n") <= F.col("reach_y"))
    again = failed.join(named.hint("merge"), met).select(F.least("y", "b").alias("a"), F.greatest("y", "b").alias("b")).distinct()
    more = written(compared(again, reps, percent).where("linked").select("a", "b"), "links")
    if more.take(1):
        labels = components(links.unionByName(more))
    forget(columns, tested, named, more, reps)  # all that is left to do reads rows and labels

    found = members.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    first = F.coalesce("label", "rep")
    kept = (F.col("doc_id") == first["doc_id"]) & (F.col("t") == first["t"])
    return alone.unionByName(found.select("doc_id", "t", F.col("n").alias("n_shingles"), first["doc_id"].alias("component_id"), kept.alias("kept")))


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    numbered, names = long_ids(docs, doc_id)
    found = jaccard_rows(numbered, n, percent, text, doc_id).select("doc_id", "n_shingles", "component_id")
    return named_back(found, names, "doc_id", "component_id")


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id (then hash of the text); same columns."""
    numbered, names = long_ids(docs, doc_id)
    gone = jaccard_rows(numbered, n, percent, text, doc_id).where(~F.col("kept")).select("doc_id", "t")
    gone = named_back(gone, names, "doc_id").select(F.col("doc_id").alias("_corvane_id"), F.col("t").alias("_corvane_t"))
    return docs.join(gone, (F.col(doc_id) == F.col("_corvane_id")) & (text_hash(text) == F.col("_corvane_t")), "left_anti")
