"""Source divergence audit: how far a source's use of words is from that of other sources of its language.

Terms are runs of letters (A-Z lower-cased, everything above ASCII as it is); a language keeps
the V terms that ``LEAST_DOCUMENTS`` of its documents have. A group (a source in a language, or
the language as a whole) that has a kept term ``count`` times, and N kept terms in all, gives it
p = 1 + floor(10^9 * (count + 1) / (N + V)), and f(p, q) = floor((p - q)^2 / q).

1. Each Arrow batch counts its own terms by group and sends each (group, term) once, with its
   occurrences and documents; Spark adds them up. A term's vector has the sources that use it.
2. Terms with the same vector are one row with a number. Its pairs of sources add to the joint
   histogram of the pair: how many terms have count x in one and y in the other.
3. Zero cells are implied: (x, 0) has the terms with count x in the one source less those in
   cells (x, y) of the pair, and (0, 0) what is left of V. f is evaluated once a cell, in either
   direction, and multiplied by the cell's number. No term meets a source that lacks it.

Arithmetic is exact: decimals where 10^9 * count may pass a long, integer division, and an
error instead of an overflow. Null texts, languages and sources count as ''. Repeated rows are
documents of their own; extra columns are ignored; an empty table gives none. A group without
terms has pairs only, and a language that keeps no term has pairs of value 0. Equal values are
ranked by item in the order of its bytes. A vector is as long as a language has sources, and
so is what a source's pairs are ranked in: the result itself has every pair of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.batches import forget, release, runs_of_rows, send_package, written
from corvane.llm.words import LETTERS, Words

LEAST_DOCUMENTS = 3
MOST_TERMS = 200
#: Sources of a language are dealt to so many tasks when they are paired.
SALTS = 16

TALLY = "lang string, source string, term string, n long, documents long"


def tally(lang: pa.Array, source: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Occurrences and documents of each (lang, source, term); and a row with a null term for each (lang, source)."""
    words = Words(texts, LETTERS)
    spelled = np.ascontiguousarray(words.bytes[LETTERS[words.bytes]])
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(words.end - words.start)])
    terms = pa.Array.from_buffers(pa.large_utf8(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(spelled)]).dictionary_encode()
    known = max(1, len(terms.dictionary))
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
    occurring = np.unique(group)

    document = np.repeat(np.arange(len(texts)), np.diff(words.first))
    in_document, times = np.unique(document * known + terms.indices.to_numpy(), return_counts=True)
    keys, place = np.unique(group[in_document // known] * known + in_document % known, return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, place, times)
    held = np.bincount(place, minlength=len(keys)).astype(np.int64)

    of = np.concatenate([keys // known, occurring])
    none = pa.nulls(len(occurring), pa.string())
    zeros = np.zeros(len(occurring), np.int64)
    columns = [
        langs.dictionary.take(pa.array(of // max(1, len(sources.dictionary)))).cast(pa.string()),
        sources.dictionary.take(pa.array(of % max(1, len(sources.dictionary)))).cast(pa.string()),
        pa.concat_arrays([terms.dictionary.take(pa.array(keys % known)).cast(pa.string()), none]),
        pa.array(np.concatenate([n, zeros])),
        pa.array(np.concatenate([held, zeros])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "documents"])


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in runs_of_rows(batch.column("text")):
            part = batch.slice(a, b - a)
            yield tally(part.column("lang"), part.column("source"), part.column("text"))
            release()


def rate(count: Column, total: Column, kept: Column) -> Column:
    """p of a term that is there ``count`` times, among ``total`` of ``kept`` kinds."""
    exact = lambda x, digits: x.cast(f"decimal({digits},0)")
    return 1 + F.call_function("div", exact(F.lit(1_000_000_000), 10) * exact(count + 1, 20), exact(total + kept, 20))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def paired(groups: DataFrame) -> DataFrame:
    """The pairs a < b of a language's sources with their sizes, dealt by ``SALTS`` so that no language is one task."""
    of = lambda name: [F.col(c).alias(f"{c}_{name}") for c in ("total", "used")]
    left = groups.select("lang", "kept", F.col("source").alias("a"), *of("a"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    right = groups.select("lang", F.col("source").alias("b"), *of("b"), F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int").alias("salt"))
    return left.join(right, ["lang", "salt"]).where("a < b").drop("salt")


def joint_histograms(vectors: DataFrame, margins: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, a, b, x, y and m: how many kept terms have count x in source a and y in source b, zeros too; a < b."""
    shapes = vectors.groupBy("lang", "vector").agg(F.count("*").alias("m"))
    firsts = shapes.select("lang", "m", "vector", F.posexplode("vector").alias("at", "one"))
    both = firsts.select("lang", "m", F.col("one.source").alias("a"), F.col("one.n").alias("x"), F.explode(F.slice("vector", F.col("at") + 2, F.size("vector"))).alias("other"))
    seen = both.groupBy("lang", "a", F.col("other.source").alias("b"), "x", F.col("other.n").alias("y")).agg(F.sum("m").alias("m"))
    cell = lambda x, y, m: F.struct(x.alias("x"), y.alias("y"), m.alias("m"))
    x, y, m, zero = F.col("x"), F.col("y"), F.col("m"), F.lit(0).cast("long")
    cells = seen.select("lang", "a", "b", F.explode(F.array(cell(x, y, m), cell(x, zero, -m), cell(zero, y, -m), cell(zero, zero, m))).alias("c"))
    margin = lambda name: margins.select("lang", F.col("source").alias(name), "n", "m")
    in_a = pairs.join(margin("a"), ["lang", "a"]).select("lang", "a", "b", cell(F.col("n"), zero, m).alias("c"))
    in_b = pairs.join(margin("b"), ["lang", "b"]).select("lang", "a", "b", cell(zero, F.col("n"), m).alias("c"))
    in_none = pairs.select("lang", "a", "b", cell(zero, zero, F.col("kept") - F.col("used_a") - F.col("used_b")).alias("c"))
    every = cells.unionByName(in_a).unionByName(in_b).unionByName(in_none).select("lang", "a", "b", "c.*")
    return every.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")).where("m <> 0")


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: part ``pair`` compares a source with each other one of its language,
    part ``term`` has the ``most`` terms by which it stands out from the language as a whole."""
    send_package(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = written(plain.mapInArrow(tallied, TALLY).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "counts")
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("documents").alias("documents"), F.sum("n").alias("n"))
    vectors = written(by_term.where(F.col("documents") >= least).select("lang", "term", "vector", "n"), "vectors")
    margins = written(vectors.select("lang", F.explode("vector").alias("v")).groupBy("lang", F.col("v.source").alias("source"), F.col("v.n").alias("n")).agg(F.count("*").alias("m")), "margins")
    whole = vectors.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total_lang"))
    used = margins.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("m").alias("used"))
    named = counts.where("term IS NULL").select("lang", "source").join(whole, "lang", "left").join(used, ["lang", "source"], "left")
    groups = written(named.na.fill(0, ["kept", "total_lang", "total", "used"]), "groups")  # small as a rule: Spark sees its size and may broadcast it

    pairs = written(paired(groups), "pairs")
    cells = joint_histograms(vectors, margins, pairs).join(pairs, ["lang", "a", "b"])
    p, q = rate(F.col("x"), F.col("total_a"), F.col("kept")), rate(F.col("y"), F.col("total_b"), F.col("kept"))
    valued = cells.select("lang", "a", "b", "m", p.alias("p"), q.alias("q"))
    sums = valued.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * distance(F.col("p"), F.col("q"))).alias("ab"), F.sum(F.col("m") * distance(F.col("q"), F.col("p"))).alias("ba"))
    side = lambda s, i, v: F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.coalesce(F.col(v), F.lit(0)).alias("value"))
    both_ways = pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left").select("lang", F.explode(F.array(side("a", "b", "ab"), side("b", "a", "ba"))).alias("v")).select("lang", "v.*")

    each = vectors.select("lang", "term", F.col("n").alias("n_lang"), F.explode("vector").alias("v")).select("lang", "term", "n_lang", "v.*").join(groups, ["lang", "source"])
    rated = each.select("lang", "source", F.col("term").alias("item"), rate(F.col("n"), F.col("total"), F.col("kept")).alias("p"), rate(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q"))
    over = rated.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    found = written(ranked(both_ways, "pair").unionByName(ranked(over, "term").where(F.col("rank") <= most)), "divergence")
    forget(counts, vectors, margins, groups, pairs)
    return found
