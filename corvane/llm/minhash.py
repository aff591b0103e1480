"""MinHash near-dedup: banded signatures, sequential Bayesian verification of candidates, whole sets of what survives.

A document's set has the distinct runs of ``N`` words (fewer words: all of them as one); two
documents link when their sets' Jaccard similarity is at least ``PERCENT`` / 100.

1. Signatures: the least of ``BANDS`` x ``ROWS`` hash functions over a set. Documents whose sets
   are equal are one class with one representative.
2. Bands: representatives with the same ``ROWS`` values of a band are in one bucket. A pair at
   the threshold misses every bucket with probability (1 - 0.85^5)^32, some 7e-9, and less above.
3. Pairs: a bucket of up to ``SMALL`` representatives gives its pairs; in a larger one every
   representative meets the bucket's first, its hub.
4. Verification goes through a pair's signatures by batches of ``BATCH`` values. After n values
   of which m agree, the similarity has, from an even prior, the posterior Beta(m + 1, n - m + 1);
   a pair ends when that gives less than ``MISS`` to similarities at or above the threshold.
   What is left is compared by whole sets, in slices of ``SLICE`` hashes at most, whose overlaps
   add up: no row has a whole set of a long text, and no link rests on an estimate.
5. What a hub leaves open: two of a large bucket that are not in one component, one of which, y,
   isn't linked to the hub. Among all that met the hub, shingles are counted; with the rarest
   first, linked sets share one of the first n - ceil(n * PERCENT / 100) + 1 of each, and the
   place of the first shared one bounds the partner's size. Pairs that meet on these go through
   step 4, too. So a large bucket loses no link, and no bucket lists its pairs.

Sets are 64-bit hashes; see ``words`` for the odds of a clash. Null texts and texts without
words: size 0, linked with nothing. Null ids: never linked, null component, kept. Rows that share
an id but not their text are documents of their own; rows that share both share their fate.
Ids may be of any type, and the smallest is the first in their order. Empty tables give none.
Extra columns are ignored, or kept by ``one_of_each``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from corvane.llm.batches import dealt_anew, forget, long_ids, named_back, send_package, written
from corvane.llm.components import components
from corvane.llm.exchange import Batches
from corvane.llm.jaccard import shingle_sets, text_hash
from corvane.llm.words import U64, mix

N = 3
PERCENT = 85
BANDS, ROWS = 32, 5
#: Signature values that are compared before the posterior is looked at again, and the probability of a link that ends a comparison.
BATCH, MISS = 16, 1e-9
SMALL = 8
SLICE_BITS = 13
SLICE = 1 << SLICE_BITS
#: Shingles that are hashed at once by all functions: they stay in the processor's cache.
HASHED_AT_ONCE = 1 << 16

DOCUMENT = "b long, doc_id long, t long, n long, set_1 long, set_2 long, bands array<long>, signature binary"
_DOCUMENT = pa.schema([("b", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("set_1", pa.int64()), ("set_2", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])
SLICES = "doc_id long, t long, slice int, keys array<long>"
_SLICES = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("slice", pa.int32()), ("keys", pa.list_(pa.int64()))])

_functions = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U64))
XOR, TIMES = _functions[: BANDS * ROWS], _functions[BANDS * ROWS :] | U64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(set, function): the highest 32 bits of the least value of each function over each set; sets are not empty."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    sizes = np.cumsum([0, *map(len, sets)])
    a = 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + HASHED_AT_ONCE, side="right")) - 1)
        keys, begin = np.concatenate(sets[a:b]), sizes[a:b] - sizes[a]
        for k in range(BANDS * ROWS):
            out[a:b, k] = np.minimum.reduceat((keys ^ XOR[k]) * TIMES[k], begin) >> U64(32)
        a = b
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """(set, band): a hash of the band's number and values."""
    keys = np.empty((len(found), BANDS), U64)
    for k in range(BANDS):
        h = np.full(len(found), U64(k + 1))
        for j in range(ROWS):
            h = mix(h + found[:, k * ROWS + j])
        keys[:, k] = h
    return keys.view(np.int64)


def least_agreeing(n: int, percent: int, miss: float) -> int:
    """The least m for which Beta(m + 1, n - m + 1) gives similarities of percent / 100 and more a probability of ``miss``: that of m or fewer successes among n + 1 trials."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def surviving(percent: int, miss: float):
    """Whether a pair of signatures is left by all batches; each batch looks only at the pairs that the earlier ones left."""
    ends = [*range(BATCH, BANDS * ROWS, BATCH), BANDS * ROWS]
    needed = [least_agreeing(n, percent, miss) for n in ends]

    @arrow_udf(T.BooleanType())
    def survive(left: pa.Array, right: pa.Array) -> pa.Array:
        matrix = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(len(x), BANDS * ROWS)
        a, b = matrix(left), matrix(right)
        at, agree, begin = np.arange(len(a)), np.zeros(len(a), np.int64), 0
        for end, least in zip(ends, needed, strict=True):
            agree = agree + (a[at, begin:end] == b[at, begin:end]).sum(1)
            go_on = agree >= least
            at, agree, begin = at[go_on], agree[go_on], end
        out = np.zeros(len(a), bool)
        out[at] = True
        return pa.array(out)

    return survive


def level(n: Column) -> Column:
    """A set of n hashes is kept in 2^level slices, by their highest bits."""
    return F.greatest(F.length(F.bin(F.greatest(n - 1, F.lit(0)))) - SLICE_BITS, F.lit(0))


class Corpus:
    """Documents in batches, their signatures, and their sets on request."""

    def __init__(self, docs: DataFrame, n: int, text: str, doc_id: str):
        send_package(docs.sparkSession)
        self.n = n
        self.batches = Batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_hash(text).alias("t")))

    def documents(self) -> DataFrame:
        size = self.n

        def sign(table: pa.Table) -> pa.Table:
            sets = shingle_sets(table["text"], size)
            some = [i for i, own in enumerate(sets) if len(own) and table["doc_id"][i].is_valid]
            found = signatures([sets[i] for i in some])
            place = dict(zip(some, range(len(some)), strict=True))
            of = lambda values: [values(i) if i in place else None for i in range(len(sets))]
            add = lambda h: int(h.sum(dtype=U64).astype(np.int64))
            keys = band_keys(found)
            rows = {
                "b": table["b"], "doc_id": table["doc_id"], "t": table["t"], "n": [len(own) for own in sets],
                "set_1": of(lambda i: add(mix(sets[i]))), "set_2": of(lambda i: add(mix(sets[i] ^ U64(0xA5A5A5A5A5A5A5A5)))),
                "bands": of(lambda i: keys[place[i]]), "signature": of(lambda i: found[place[i]].tobytes()),
            }
            return pa.table(rows, schema=_DOCUMENT)

        return self.batches.each(sign, DOCUMENT)

    def slices(self, wanted: DataFrame, name: str) -> DataFrame:
        """doc (struct of doc_id and t), slice and keys of the sets of the wanted documents (b, doc_id, t)."""
        size = self.n

        def cut(table: pa.Table, requests: pa.Table) -> pa.Table:
            rows: dict = {c: [] for c in _SLICES.names}
            asked = set(zip(requests["doc_id"].to_pylist(), requests["t"].to_pylist(), strict=True))
            named = list(zip(table["doc_id"].to_pylist(), table["t"].to_pylist(), strict=True))
            first = {}
            for i, doc in enumerate(named):
                if doc in asked:
                    first.setdefault(doc, i)  # rows that share id and text have one set
            for doc, i in first.items():
                own = shingle_sets(table["text"].combine_chunks().slice(i, 1), size)[0]  # sorted
                k = max(0, (len(own) - 1).bit_length() - SLICE_BITS)
                edges = [0, *np.searchsorted(own, np.arange(1, 1 << k, dtype=U64) << U64(64 - k)).tolist(), len(own)] if k else [0, len(own)]
                for s in range(len(edges) - 1):
                    rows["doc_id"].append(doc[0])
                    rows["t"].append(doc[1])
                    rows["slice"].append(s)
                    rows["keys"].append(own[edges[s] : edges[s + 1]].view(np.int64))
            return pa.table(rows, schema=_SLICES)

        found = self.batches.replied(wanted.distinct(), cut, SLICES)
        return written(found.select(F.struct("doc_id", "t").alias("doc"), "slice", "keys"), name)


def exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of pairs(a, b, n_a, n_b) whose whole sets reach the threshold; overlaps add up over slices."""
    k_a, k_b = level(F.col("n_a")), level(F.col("n_b"))
    cut = pairs.withColumns({"k_a": k_a, "k_b": k_b, "k": F.greatest(k_a, k_b)})
    cut = cut.withColumn("s", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("k")) - 1)))
    at = lambda k: F.call_function("shiftright", F.col("s"), F.col("k") - F.col(k))
    cut = cut.select("a", "b", "n_a", "n_b", at("k_a").alias("s_a"), at("k_b").alias("s_b"))
    of = lambda x: sets.select(F.col("doc").alias(x), F.col("slice").alias(f"s_{x}"), F.col("keys").alias(f"keys_{x}"))
    met = cut.join(of("b").hint("merge"), ["b", "s_b"]).join(of("a").hint("merge"), ["a", "s_a"])
    overlap = met.groupBy("a", "b", "n_a", "n_b").agg(F.sum(F.size(F.array_intersect("keys_a", "keys_b"))).alias("overlap"))
    return overlap.where(F.col("overlap") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * percent).select("a", "b")


def alike(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def verified(pairs: DataFrame, reps: DataFrame, corpus: Corpus, percent: int, miss: float, name: str) -> DataFrame:
    """The pairs (a, b) of pairs(a, b, n_a, n_b) that link: by signatures, batch after batch, then by whole sets."""
    of = lambda x: reps.select(F.col("rep").alias(x), F.col("signature").alias(f"signature_{x}"), F.col("b").alias(f"batch_{x}"))
    met = pairs.where(alike(F.col("n_a"), F.col("n_b"), percent)).join(of("b").hint("merge"), "b").join(of("a").hint("merge"), "a")
    left = written(met.where(surviving(percent, miss)(F.col("signature_a"), F.col("signature_b"))).select("a", "b", "n_a", "n_b", "batch_a", "batch_b"), f"{name}_survivors")
    wanted = left.select(F.col("batch_a").alias("b"), "a.doc_id", "a.t").unionByName(left.select(F.col("batch_b").alias("b"), "b.doc_id", "b.t"))
    sets = corpus.slices(wanted, f"{name}_sets")
    links = written(exact(left.drop("batch_a", "batch_b"), sets, percent), f"{name}_links")
    forget(left, sets)
    return links


def still_open(met: DataFrame, links: DataFrame, labels: DataFrame, reps: DataFrame, corpus: Corpus, percent: int) -> DataFrame:
    """Candidate pairs (a, b, n_a, n_b) in different components among what met(a, b, n_b) the same hub a, one of which isn't linked to it."""
    known = labels.withColumnsRenamed({"node": "b", "label": "known"})
    members = written(met.join(links.select("a", "b", F.lit(True).alias("linked")), ["a", "b"], "left").join(known, "b", "left").select("a", "b", F.col("n_b").alias("n"), F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("known", "b").alias("label")), "members")
    hubs = members.groupBy("a").agg(F.count_if(~F.col("linked")).alias("failed"), F.min("label").alias("least"), F.max("label").alias("most")).where("failed > 0 AND least <> most")
    some = written(members.join(hubs.select(F.col("a").alias("hub")), F.col("a") == F.col("hub"), "left_semi"), "open")
    batch = reps.select(F.col("rep").alias("b"), F.col("b").alias("batch"))
    wanted = some.select("b").distinct().join(batch.hint("merge"), "b").select(F.col("batch").alias("b"), "b.doc_id", "b.t")
    sets = corpus.slices(wanted, "open_sets")
    each = some.join(sets.select(F.col("doc").alias("b"), "keys").hint("merge"), "b").select("a", "b", "n", "linked", "label", F.explode("keys").alias("key"))
    counts = each.groupBy("a", "key").agg(F.count("*").alias("m")).select(F.col("a").alias("hub"), F.col("key").alias("same"), "m")
    counted = each.join(counts.hint("merge"), F.struct("a", "key") == F.struct("hub", "same")).drop("hub", "same")  # dealt anew on both sides
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("a", "b").orderBy("m", "key")))
    reach = F.floor((F.col("n") - F.col("place") + 1) * (100 + percent) / percent) - F.col("n")  # the largest partner whose first shared shingle this may be
    prefix = placed.where((F.col("m") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).select("a", "b", "n", "linked", "label", "key", reach.alias("reach"))
    prefix = written(prefix, "prefixes")
    failed = prefix.where(~F.col("linked")).select(F.col("a").alias("hub"), F.col("b").alias("y"), F.col("n").alias("n_y"), F.col("label").alias("label_y"), F.col("key").alias("same"), F.col("reach").alias("reach_y"))
    fits = (F.col("a") == F.col("hub")) & (F.col("key") == F.col("same")) & (F.col("label") != F.col("label_y")) & (F.col("n") <= F.col("reach_y")) & (F.col("n_y") <= F.col("reach"))
    first = F.col("y") < F.col("b")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    found = written(failed.join(prefix.hint("merge"), fits).select(pick("y", "b", "a"), pick("b", "y", "b"), pick("n_y", "n", "n_a"), pick("n", "n_y", "n_b")).distinct(), "open_pairs")
    forget(members, some, sets, prefix)
    return found


def minhash_rows(docs: DataFrame, n: int, percent: int, miss: float, text: str, doc_id: str) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id and kept (the first of its component by id and t) of every row."""
    corpus = Corpus(docs, n, text, doc_id)
    rows = written(corpus.documents(), "signatures")
    alone = rows.where("signature IS NULL").select("doc_id", "t", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    some = rows.where("signature IS NOT NULL")
    classes = written(some.groupBy("set_1", "set_2").agg(F.min(F.struct("doc_id", "t", "b")).alias("first")), "classes")
    firsts = classes.select("first.doc_id", "first.t", "first.b", F.struct("first.doc_id", "first.t").alias("rep"))
    reps = written(some.join(firsts.hint("merge"), ["doc_id", "t", "b"]).dropDuplicates(["rep"]).select("rep", "b", "n", "bands", "signature"), "reps")

    entries = reps.select("rep", "n", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("rep", "n")).alias("hub")).where("m > 1").select(dealt_anew("key").alias("at"), "m", "hub")
    placed = written(entries.join(buckets.hint("merge"), dealt_anew("key") == F.col("at")).select("key", "rep", "n", "m", "hub"), "buckets")
    star = placed.where((F.col("m") > SMALL) & (F.col("rep") != F.col("hub.rep"))).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"), F.col("hub.n").alias("n_a"), F.col("n").alias("n_b")).distinct()
    star = written(star, "stars")
    lists = placed.where(F.col("m") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("all"))  # SMALL at most
    ones = lists.select("all", F.posexplode("all").alias("i", "x")).select("x", F.explode(F.slice("all", F.col("i") + 2, F.lit(SMALL))).alias("y"))
    few = ones.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    links = verified(star.unionByName(few).distinct(), reps, corpus, percent, miss, "first")
    labels = components(links)
    open_pairs = still_open(star.select("a", "b", "n_b"), links, labels, reps, corpus, percent)
    more = verified(open_pairs, reps, corpus, percent, miss, "second")
    if more.take(1):
        labels = components(links.unionByName(more))
    corpus.batches.drop()
    forget(reps, placed, star, links, open_pairs, more)

    members = some.select("doc_id", "t", "n", F.struct("set_1", "set_2").alias("set"))
    of_class = classes.select(F.struct("set_1", "set_2").alias("set"), F.struct("first.doc_id", "first.t").alias("rep"))
    found = members.join(of_class.hint("merge"), "set").join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    first = F.coalesce("label", "rep")
    kept = (F.col("doc_id") == first["doc_id"]) & (F.col("t") == first["t"])
    return alone.unionByName(found.select("doc_id", "t", F.col("n").alias("n_shingles"), first["doc_id"].alias("component_id"), kept.alias("kept")))


def minhash_components(docs: DataFrame, n: int = N, percent: int = PERCENT, miss: float = MISS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept (the id is this one) of every row."""
    numbered, names = long_ids(docs, doc_id)
    found = minhash_rows(numbered, n, percent, miss, text, doc_id).select("doc_id", "n_shingles", "component_id")
    return named_back(found, names, "doc_id", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT, miss: float = MISS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id (then hash of the text); same columns."""
    numbered, names = long_ids(docs, doc_id)
    gone = named_back(minhash_rows(numbered, n, percent, miss, text, doc_id).where(~F.col("kept")).select("doc_id", "t"), names, "doc_id")
    gone = gone.select(F.col("doc_id").alias("_corvane_id"), F.col("t").alias("_corvane_t"))
    return docs.join(gone, (F.col(doc_id) == F.col("_corvane_id")) & (text_hash(text) == F.col("_corvane_t")), "left_anti")
