"""LM scoring by deleted interpolation of trigram, bigram, unigram and uniform estimates.

Tokens are lower-cased words and one end token a text. With counts c over the training texts,

    p(w | u v) = w3 c(u v w) / c(u v)  +  w2 c(v w) / c(v)  +  w1 c(w) / N  +  w0 / (V + 1)

where the weights depend on the bucket of the context: the longest context that was seen, and
the number of binary digits of how often. An estimate whose context was never seen has weight
0, so the probabilities of all words sum to 1 after every context. Before a text stands a start
of its own, which was seen once for each training text. The training texts are split into a
kept and a deleted part; the weights of each bucket are found by expectation-maximisation (with
steps that make it faster, see ``climb``) so that estimates from the kept part explain the deleted
part's tokens best. Scores use the counts
of both parts.

Texts are read once: the batch table holds each batch's distinct words and the place of every
token among them. Counts come from all texts, through ``exchange``: each batch sends its distinct n-grams of a
length once and gets their totals back. Words and bigrams go first, then each longer length; an
n-gram of which a part was never seen in training is not sent. Every deleted token is an event: its bucket and its estimates as they are, written to
the shared folder, equal ones of a batch once. A round of EM is one pass over that table with sums
by bucket, so the driver holds the weights of each bucket and as many sums, whatever the corpus.
The same pass over the texts writes the totals of every token, from which scores are made.

Buckets without events take the mean weights of their context's length, else those of all
events, over the estimates that they may use. Null and empty texts have the end token only. Rows
with the same id are scored by themselves. With no training texts, every token has probability
1 / (0 + 1). Rows whose fold is null are scored and not learned from. N-grams are 64-bit hashes
(see ``words`` for the odds of a clash). Ids may be of any type. Empty tables give none. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.batches import forget, long_ids, named_back, send_package, written
from corvane.llm.exchange import FORWARD, Batches, forward_rows, pack_counts, pack_sorted, read_totals, totals, unpack_counts, unpack_sorted
from corvane.llm.words import NOT_BLANK, STEP, U64, Words, mix

ORDER = 3
KEPT, DELETED, HELD_OUT = 0, 1, 2
#: Contexts seen 2^(BUCKETS - 2) times or more share the last bucket of their length.
BUCKETS = 40
#: Rounds of EM at most; it ends when a round makes a token's mean log-likelihood better by less than LEAST_GAIN.
ROUNDS = 40
LEAST_GAIN = 1e-7
#: Rows of events, one for each batch, that a task of a round reads.
BATCHES_A_TASK = 16
#: No component's weight is less, so that every token has a probability.
LEAST_WEIGHT = 1e-6
END = mix(np.array([0x456E64], dtype=U64))[0]

SCORES = "doc_id long, fold int, n_tokens long, n_known long, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
EVENTS = "bucket binary, ratios binary, n binary"
LOOKED_UP = f"{EVENTS}, doc_id array<long>, fold array<int>, n_tokens array<long>, texts long, totals array<binary>"
_EVENTS = pa.schema([(name, pa.binary()) for name in ("bucket", "ratios", "n")])
_LOOKED_UP = pa.schema(
    [*_EVENTS, ("doc_id", pa.list_(pa.int64())), ("fold", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int64())), ("texts", pa.int64()), ("totals", pa.list_(pa.binary()))]
)
_SUMS = pa.schema([("bucket", pa.int32()), ("sums", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Sizes:
    """Tokens and distinct tokens of the kept part and of all training texts."""

    kept_tokens: int
    kept_words: int
    tokens: int
    words: int


CODED = "b long, doc_id array<long>, fold array<int>, n_tokens array<long>, words binary, place binary"
_CODED = pa.schema([("b", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("fold", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int64())), ("words", pa.binary()), ("place", pa.binary())])


def coded(table: pa.Table) -> pa.Table:
    """A batch's texts as one row: its distinct words, and every token's place among them; later passes look at no text."""
    words = Words(table["text"], NOT_BLANK)
    n = np.diff(words.first)
    ends = np.cumsum(n + 1) - 1
    last = np.zeros(int((n + 1).sum()), bool)
    last[ends] = True
    tokens = np.full(len(last), END, dtype=U64)
    tokens[~last] = words.hashes()
    keys, place = np.unique(tokens, return_inverse=True)
    rows = {"doc_id": table["doc_id"].to_pylist(), "fold": table["fold"].to_pylist(), "n_tokens": n + 1, "words": pack_sorted(keys), "place": pack_counts(place)}
    return pa.table({"b": [table["b"][0].as_py()], **{name: [x] for name, x in rows.items()}}, schema=_CODED)


class Events:
    """A batch's tokens in order, and for each length the places of their n-grams in the sorted distinct ones."""

    def __init__(self, table: pa.Table, order: int):
        (row,) = table.to_pylist()
        self.b, self.doc_id, self.folds, self.lengths = row["b"], row["doc_id"], row["fold"], np.array(row["n_tokens"])
        self.start = np.cumsum(self.lengths) - self.lengths
        self.keys, self.place = [unpack_sorted(row["words"])], [unpack_counts(row["place"])]
        tokens = self.keys[0][self.place[0]]
        gram = tokens
        for k in range(2, order + 1):
            before = np.concatenate([gram[:1], gram[:-1]])
            before[self.start] = U64(k)  # the text's start
            gram = mix(before * U64(STEP) + tokens)
            keys, place = np.unique(gram, return_inverse=True)
            self.keys.append(keys)
            self.place.append(place)
        self.end = int(np.searchsorted(self.keys[0], END))
        self.fold = np.repeat([-1 if x is None else x for x in self.folds], self.lengths)

    def counts(self, k: int) -> list[np.ndarray]:
        """How often the batch has each n-gram of length k + 1, in the kept and in the deleted part."""
        return [np.bincount(self.place[k][self.fold == part], minlength=len(self.keys[k])) for part in (KEPT, DELETED)]

    def possible(self, k: int, shorter: np.ndarray) -> np.ndarray:
        """The n-grams of length k + 1 that training texts may have, given the totals of length k; the others have none."""
        own = shorter[self.place[k - 1]]
        before = np.concatenate([own[:1], own[:-1]])
        before[self.start] = self.texts
        most = np.zeros(len(self.keys[k]), np.int64)
        most[self.place[k]] = np.minimum(own, before)
        return most > 0

    def totals(self, reply: pa.Table, order: int, parts: int) -> list[list[np.ndarray]]:
        """Of each length, the totals of the kept and of the deleted part for each of the batch's n-grams."""
        out: list[list[np.ndarray]] = []
        for k in range(order):
            if k < 2:
                out.append([read_totals(reply, k * parts, parts, part) for part in (0, 1)])
                if not k:
                    self.texts = int(sum(x[self.end] for x in out[0]))  # each training text ends once
                continue
            sent = self.possible(k, sum(out[k - 1]))
            both = [np.zeros(len(self.keys[k]), np.int64) for _ in (0, 1)]
            for part in (0, 1):
                both[part][sent] = read_totals(reply, k * parts, parts, part)
            out.append(both)
        return out

    def found(self, totals_of: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of every token, the totals of its n-grams by length, and those of their contexts (of length 1 on)."""
        own = [t[p] for t, p in zip(totals_of, self.place, strict=True)]
        return own, contexts_of(own, self.start, int(totals_of[0][self.end]))


def contexts_of(own: list[np.ndarray], start: np.ndarray, texts: int) -> list[np.ndarray]:
    """The totals of every token's contexts of length 1 on: those of the n-grams that end before it, and at a text's start the number of training texts."""
    contexts = []
    for c in own[:-1]:
        before = np.concatenate([c[:1], c[:-1]])
        before[start] = texts
        contexts.append(before)
    return contexts


def bucket_of(contexts: list[np.ndarray], n: int) -> np.ndarray:
    """The longest context of each of n tokens that was seen, and its frequency; 0 if none was."""
    out = np.zeros(n, np.int64)
    for k, count in enumerate(contexts):
        digits = np.minimum(np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, BUCKETS - 1)
        out = np.where(count > 0, k * BUCKETS + digits, out)
    return out


def estimates(own: list[np.ndarray], contexts: list[np.ndarray], tokens: int) -> list[np.ndarray]:
    """Maximum-likelihood estimates of every token, the longest n-gram first."""
    longer = [c / np.maximum(u, 1) for c, u in zip(own[1:], contexts, strict=True)]
    return [*longer[::-1], own[0] / max(1, tokens)]


def event_row(bucket: np.ndarray, ratios: list[np.ndarray]) -> pa.Table:
    """One row with a batch's events, equal ones once: their buckets, the estimates over the uniform one, the longest n-gram's first, and how often they occur."""
    ordered = np.lexsort([bucket, *ratios])
    bucket, ratios = bucket[ordered], [x[ordered] for x in ratios]
    lead = np.ones(len(bucket), bool)
    lead[1:] = np.any([x[1:] != x[:-1] for x in (bucket, *ratios)], axis=0)
    at = np.flatnonzero(lead)
    n = np.diff(at, append=len(bucket))
    return pa.table({"bucket": [bucket[at].astype(np.int32).tobytes()], "ratios": [np.concatenate([x[at] for x in ratios]).tobytes()], "n": [n.astype(np.int64).tobytes()]}, schema=_EVENTS)


def expected(events: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A round's sums under the weights ``w`` by bucket: the expected shares of the components, the events, and their log-likelihood."""
    size, components = w.shape

    def one(batches):
        total = np.zeros((size, components + 2))
        for batch in batches:
            for row in batch.to_pylist():
                bucket, n = np.frombuffer(row["bucket"], np.int32), np.frombuffer(row["n"], np.int64)
                ratios = np.frombuffer(row["ratios"]).reshape(components - 1, len(n))
                parts = [w[bucket, k] * ratios[k] for k in range(components - 1)] + [w[bucket, -1]]
                p = np.sum(parts, axis=0)
                for k, x in enumerate([*[n * part / p for part in parts], n, n * np.log(p)]):
                    total[:, k] += np.bincount(bucket, weights=x, minlength=size)
        some = np.flatnonzero(total[:, components])
        yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "sums": list(total[some])}, schema=_SUMS)

    sums = events.mapInArrow(one, "bucket int, sums array<double>").groupBy("bucket").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(components + 2)])
    out = np.zeros((size, components + 2))
    for r in sums.collect():  # a row a bucket, of which there is a fixed number
        out[r["bucket"]] = r[1:]
    return out[:, :components], out[:, components], out[:, components + 1]


def allowed(order: int, tokens: int) -> np.ndarray:
    """Which components a bucket may use: those whose context it has seen; the unigram one if there are tokens, the uniform one always."""
    size = max(1, order - 1) * BUCKETS
    level = np.arange(size) // BUCKETS  # of a bucket: its context has this many words and one
    may = np.ones((size, order + 1), bool)
    for k in range(order - 1):  # component k is the n-gram of length order - k, whose context has order - k - 1 words
        may[:, k] = level >= order - k - 2
    if order > 1:
        may[0, : order - 1] = False  # no context was seen
    may[:, order - 1] = tokens > 0
    return may


def proper(w: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Weights of at least LEAST_WEIGHT for what may be used, that sum to 1 in each bucket."""
    w = np.where(may, np.maximum(w, LEAST_WEIGHT), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def climb(round_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], may: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, shares, events) of buckets by EM: rounds in twos, each two followed by a step along the way that they went.

    From w0, with w1 and w2 after one round and two, the step goes to w0 + 2a(w1 - w0) +
    a^2(w2 - 2 w1 + w0) with a = |w1 - w0| / |w2 - 2 w1 + w0|, 1 at least (SQUAREM). A bucket in which
    that is less likely than w1 goes on from w2 instead, so the likelihood never falls.
    """
    w = may / may.sum(axis=1, keepdims=True)
    shares, n, last, safe, floor = np.zeros(w.shape), np.zeros(len(w)), -np.inf, None, None
    step = lambda w: proper(np.where((n > 0)[:, None], shares / np.maximum(n, 1)[:, None], w), may)
    while rounds > 0:
        shares, n, log = round_of(w)
        rounds -= 1
        if not n.any():
            break
        worse = safe is not None and log < floor - 1e-12 * np.abs(floor)
        if np.any(worse):
            w, safe = np.where(worse[:, None], safe, w), None
            continue
        w1 = step(w)
        if log.sum() / n.sum() - last < LEAST_GAIN or not rounds:
            return w1, shares, n
        shares, n, floor = round_of(w1)
        rounds -= 1
        w2 = step(w1)
        if (floor.sum() - log.sum()) / n.sum() < LEAST_GAIN or not rounds:
            return w2, shares, n
        last, safe = floor.sum() / n.sum(), w2
        r = w1 - w
        v = w2 - w1 - r
        size, bend = np.linalg.norm(r, axis=1), np.linalg.norm(v, axis=1)
        a = np.maximum(1.0, np.where(bend > 0, size / np.where(bend > 0, bend, 1.0), 1.0))[:, None]
        w = proper(w + 2 * a * r + a * a * v, may)
    return w, shares, n


def learn_weights(events: DataFrame, order: int = ORDER, rounds: int = ROUNDS, tokens: int = 1) -> np.ndarray:
    """Weights of each bucket by EM over rows of ``event_row``; the uniform estimate's is the last."""
    may = allowed(order, tokens)
    w, shares, n = climb(lambda w: expected(events, w), may, rounds)
    return pooled(w, shares, n, may)


def pooled(w: np.ndarray, shares: np.ndarray, n: np.ndarray, may: np.ndarray) -> np.ndarray:
    """The weights, with those of buckets without events from the mean of their context's length, else of all, over what they may use."""
    level = np.arange(len(w)) // BUCKETS
    w = w.copy()
    for b in np.flatnonzero(n == 0):
        means = [np.where(may[b], pool.sum(axis=0), 0.0) for pool in (shares[level == level[b]], shares)]
        mean = next((m / m.sum() for m in means if m.sum() > 0), may[b] / may[b].sum())
        w[b] = proper(mean[None], may[b][None])[0] if any(m.sum() > 0 for m in means) else mean
    return w


def score_corpus(docs: DataFrame, fold: str = "fold", text: str = "text", doc_id: str = "doc_id", order: int = ORDER, rounds: int = ROUNDS) -> tuple[DataFrame, Sizes]:
    """doc_id, fold, n_tokens, n_known, base_score and score of every row; and the training sizes.

    ``fold`` says what a row is for: KEPT and DELETED rows train, others are only scored.
    """
    send_package(docs.sparkSession)
    slim, names = long_ids(docs.select(F.col(doc_id).alias("doc_id"), F.col(fold).cast("int").alias("fold"), F.col(text).alias("text")), "doc_id")
    corpus = Batches(slim, code=(coded, CODED))
    parts = corpus.parts(corpus.chars / 8)
    first = min(order, 2)

    def send(table: pa.Table) -> pa.Table:
        e = Events(table, first)
        return forward_rows(e.b, [(e.keys[k], e.counts(k), 64, parts, k * parts) for k in range(first)])

    replies = written(totals(corpus.each(send, FORWARD), first * parts), "counts")
    sums = replies.where(f"b = -1 AND part < {parts}").select(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)).alias(f"s{k}") for k in range(6)]).first()
    sizes = Sizes(kept_tokens=sums["s1"], kept_words=sums["s2"], tokens=sums["s1"] + sums["s3"], words=sums["s5"])
    tables, answered = [replies], replies.where("b >= 0").drop("stats")
    for k in range(first, order):

        def send_longer(table: pa.Table, reply: pa.Table, k: int = k) -> pa.Table:
            if not table.num_rows:
                return forward_rows(0, [])
            e = Events(table, k + 1)
            sent = e.possible(k, sum(e.totals(reply, k, parts)[k - 1]))
            return forward_rows(e.b, [(e.keys[k][sent], [x[sent] for x in e.counts(k)], 64, parts, 0)])

        tables.append(written(totals(corpus.replied(answered, send_longer, FORWARD), parts, k * parts).where("b >= 0").drop("stats"), "counts"))
        answered = answered.unionByName(tables[-1])
    
    def look_up(table: pa.Table, reply: pa.Table) -> pa.Table:
        """The batch's events, and of every token the totals of its n-grams, from which scores follow without the text."""
        if not table.num_rows:
            return _LOOKED_UP.empty_table()
        e = Events(table, order)
        both = e.totals(reply, order, parts)
        own, contexts = e.found([kept for kept, _ in both])
        deleted = e.fold == DELETED
        own, contexts = [x[deleted] for x in own], [x[deleted] for x in contexts]
        ratios = [p * (sizes.kept_words + 1) for p in estimates(own, contexts, sizes.kept_tokens)]  # over the uniform one
        row = event_row(bucket_of(contexts, len(own[0])), ratios)
        totals_of = [(kept + deleted)[place] for (kept, deleted), place in zip(both, e.place, strict=True)]
        rest = {"doc_id": [e.doc_id], "fold": [e.folds], "n_tokens": [e.lengths], "texts": [e.texts], "totals": [[pack_counts(x) for x in totals_of]]}
        return pa.table({**{name: row[name] for name in row.column_names}, **rest}, schema=_LOOKED_UP)

    found = written(corpus.replied(answered, look_up, LOOKED_UP), "tokens")
    corpus.drop()
    forget(*tables)
    events = found.select("bucket", "ratios", "n").coalesce(max(2 * found.sparkSession.sparkContext.defaultParallelism, corpus.n // BATCHES_A_TASK + 1))  # each a few MB
    weights = learn_weights(events, order, rounds, sizes.kept_tokens)

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["n_tokens"])
                start = np.cumsum(lengths) - lengths
                own = [unpack_counts(x) for x in row["totals"]]
                contexts = contexts_of(own, start, row["texts"])
                w = weights[bucket_of(contexts, len(own[0]))]
                p = w[:, -1] / (sizes.words + 1)
                for k, estimate in enumerate(estimates(own, contexts, sizes.tokens)):
                    p = p + w[:, k] * estimate
                base = np.log10((own[0] + 1) / (sizes.tokens + sizes.words + 1))
                known, base, p = (np.add.reduceat(x, start) for x in ((own[0] > 0).astype(np.int64), base, np.log10(p)))  # every text has a token
                yield pa.RecordBatch.from_pydict({"doc_id": row["doc_id"], "fold": row["fold"], "n_tokens": lengths, "n_known": known, "base_score": base, "score": p}, schema=_SCORES)

    scores = written(found.mapInArrow(score, SCORES), "scores")
    forget(found)
    return named_back(scores, names, "doc_id"), sizes
