"""Benchmark decontamination: a broadcast hash set of the test items' word windows.

Every run of ``window`` words of an item is a window; an item of fewer words, but not none,
is one window as a whole. The hashes of all windows of a block of items are broadcast, and
each document's windows of the same lengths are looked up; every hit is verified word by
word. A block never has more than ``MOST_WINDOWS`` windows: a larger benchmark is filled into as
many blocks as it needs, a long item into several of them; the documents are scanned for one block
after the other, each block's hits are written and its broadcast is given up before the next is
made, and the hit spans of a document are merged. One block is therefore all that is broadcast or
held by the driver, whatever the benchmark's size.

Null texts have no words. Null item ids count as hits but are not listed; other ids are listed as
strings. Repeated items are listed once. Repeated rows and rows that share an id have results of
their own. Output columns are structs under one name of the caller's choice, so extra columns
never clash.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from corvane.llm.batches import in_pieces, send_package, written
from corvane.llm.words import ALNUM, Words, flat, window_hashes

WINDOW = 10
#: Windows of one broadcast block; some 150 MB at most in a Python worker.
MOST_WINDOWS = 250_000

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),  # [first word, one past the last, first byte, one past the last]
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class Block:
    """The windows of some items, by length: sorted hashes, and the items of each distinct window's words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.by_length: dict[int, np.ndarray] = {}
        self.items: dict[tuple[int, bytes], set] = {}
        words = Words(pa.array([x for _, x in items], pa.large_string()), ALNUM)
        hashes, found = words.hashes(), {}
        for i, (item, _) in enumerate(items):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if a == b:
                continue
            n = min(window, b - a)
            at, h = window_hashes(hashes[a:b], np.array([0, b - a]), n)
            for k, x in zip(at.tolist(), h.tolist(), strict=True):
                found.setdefault(n, set()).add(x)
                key = b" ".join(words.word(a + k + j) for j in range(n))
                self.items.setdefault((n, key), set()).add(item)
        self.by_length = {n: np.array(sorted(x), dtype=np.uint64) for n, x in found.items()}

    def scan(self, texts: pa.Array) -> pa.Array:
        words = Words(texts, ALNUM)
        hashes = words.hashes()
        n_docs = len(texts)
        base = words.first
        spans: list[list] = [[] for _ in range(n_docs)]
        items: list[set] = [set() for _ in range(n_docs)]
        for n, known in self.by_length.items():
            at, h = window_hashes(hashes, base, n)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for k in at[known[place] == h].tolist():
                key = b" ".join(words.word(k + j) for j in range(n))
                if (hit := self.items.get((n, key))) is not None:
                    doc = int(np.searchsorted(base, k, side="right")) - 1
                    spans[doc].append((k - int(base[doc]), k - int(base[doc]) + n, int(words.start[k]), int(words.end[k + n - 1])))
                    items[doc] |= hit
        _, begin = flat(texts)
        out = []
        for i in range(n_docs):
            own = [[a, b, c - int(begin[i]), d - int(begin[i])] for a, b, c, d in merged(spans[i])]
            out.append((int(base[i + 1] - base[i]), own, sorted(x for x in items[i] if x is not None)))
        return pa.array(
            [{"n_words": a, "spans": b, "items": c} for a, b, c in out],
            pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]),
        )


def merged(spans: list[tuple]) -> list[tuple]:
    """Overlapping or touching word spans as one."""
    out: list[list] = []
    for a, b, c, d in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1][1], out[-1][3] = b, d
        else:
            out.append([a, b, c, d])
    return [tuple(x) for x in out]


@arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
def merge_spans(spans: pa.Array) -> pa.Array:
    return pa.array([[list(x) for x in merged([tuple(y) for y in row or []])] for row in spans.to_pylist()], pa.list_(pa.list_(pa.int64())))


@arrow_udf(T.StringType())
def cut_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without the bytes of its spans."""
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if not cuts:
            out.append(text)
            continue
        raw, at, left = text.encode(), 0, []
        for _, _, a, b in cuts:
            left.append(raw[at:a])
            at = b
        out.append(b"".join([*left, raw[at:]]).decode())
    return pa.array(out, pa.string())


def blocks(benchmark: DataFrame, window: int, item: str, text: str, most: int):
    """The benchmark as lists of (item, text) that have at most ``most`` windows together; a longer item is cut so that no window is lost."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    block, held = [], 0
    for r in rows.toLocalIterator():
        words = Words(pa.array([r["text"]], pa.large_string()), ALNUM)
        n = len(words.start)
        for a in range(0, max(1, n - window + 1) if n else 0, most):
            b = min(n, a + most + window - 1)
            new = max(1, b - a - window + 1)
            if block and held + new > most:
                yield block
                block, held = [], 0
            block.append((r["item"], words.bytes[words.start[a] : words.end[b - 1]].tobytes().decode()))
            held += new
    yield block


def scan(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", found: str = "found",
    item_id: str = "item_id", item_text: str = "text", most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """``docs`` with the struct ``found``: n_words, the merged hit spans in words and bytes, and the ids of the items hit.

    Ordinary benchmarks are one block and one pass, with no shuffle. With more blocks the hits of
    each are written by a key of the text, meet there, and are joined back.
    """
    send_package(docs.sparkSession)
    every = blocks(benchmark, window, item_id, item_text, most_windows)
    first, second = next(every), next(every, None)
    if second is None:
        return docs.withColumn(found, _finder(docs, first, window)[0](F.col(text)))
    key, part = "_corvane_key", "_corvane_part"
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    union = None
    for block in itertools.chain([first, second], every):
        find, shared = _finder(docs, block, window)
        hits = written(keyed.select(key, find(F.col(text)).alias(part)).where(F.size(F.col(part)["spans"]) > 0).distinct(), "hits")
        shared.unpersist()
        union = hits if union is None else union.unionByName(hits)
    hits = union.groupBy(key).agg(F.collect_list(part).alias(part))  # at most one row of a block for each text
    hits = hits.select(F.substring(key, 1, 64).alias("_corvane_at"), part)  # dealt anew, so that a common text can be split
    each = F.col(part)
    words = _finder(docs, [], window)[0](F.col(text))
    merged_hits = F.struct(
        words["n_words"].alias("n_words"),
        merge_spans(F.coalesce(F.flatten(F.transform(each, lambda x: x["spans"])), F.array())).alias("spans"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(each, lambda x: x["items"])))), F.array()).alias("items"),
    )
    return keyed.join(hits.hint("merge"), F.col(key) == F.col("_corvane_at"), "left").withColumn(found, merged_hits).drop(key, part, "_corvane_at")


def _finder(docs: DataFrame, items: list, window: int):
    shared = docs.sparkSession.sparkContext.broadcast(Block(items, window))

    @arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, shared.value.scan)

    return find.asNondeterministic(), shared  # it isn't, but a filter on the result must not make Spark look twice


def hit_words(spans: Column) -> Column:
    """How many words the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x[1] - x[0])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", most_hit: float = 0.5, window: int = WINDOW, text: str = "text") -> DataFrame:
    """Documents without what they share with the benchmark; same columns as ``docs``.

    mode "spans": hit spans are cut from the text, and a document of whose words more than the
    share ``most_hit`` is hit goes as a whole. mode "documents": every document that is hit goes.
    """
    mark = "_corvane_found"
    seen = scan(docs, benchmark, window, text, mark)
    spans = F.col(mark)["spans"]
    if mode == "documents":
        return seen.where(F.size(spans) == 0).drop(mark)
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")
    kept = seen.where(hit_words(spans) <= most_hit * F.col(mark)["n_words"])
    return kept.withColumn(text, F.when(F.size(spans) > 0, cut_spans(F.col(text), spans)).otherwise(F.col(text))).drop(mark)
