"""Suffix-array deduplication of repeated byte strings by prefix-free parsing.

A byte is removed when a string of ``LENGTH`` bytes covers it that also starts earlier in
the corpus (smaller doc_id, or the same document, earlier start). Strings are judged on the
input, and never cross documents.

1. Parsing: the trigger of a window of LENGTH bytes is its ``GRAM``-byte gram of least
   rolling hash, the leftmost of several. The windows of a document that share a trigger
   follow each other, and the bytes they cover are a phrase. Triggers depend on a window's
   content only: equal windows are at the same distance from equal triggers, in any document.
   (Classic prefix-free parsing cuts where a hash is 0 modulo a number; the least hash of a
   window makes sure that every window has a trigger, whatever the text.)
2. Parse: a trigger gram that occurs once has no repeated window. ``exchange`` counts the
   grams, so that only the repeated parts of the corpus go on.
3. Dictionary: of the occurrences of a phrase, the earliest (by doc_id, then start) stands in
   the dictionary; all windows of the others are repeats.
4. Order: suffixes of dictionary phrases are compared by their windows. A phrase whose gram
   has no other phrase is in no other's order. The windows of the others, which lie at the
   borders of repeated parts, are sorted together; of each run of equal ones all but the
   earliest are repeats.

Orders are made part by part: keys are dealt by hash, sorted in their part, and the earliest
of each run is found there; a batch sends each of its keys once, so that a passage which a
third of all documents have arrives once from each batch. Phrases and windows are equal when two
64-bit hashes are, made from unrelated values of the bytes: one deals and sorts, the other must
agree, in a batch and between batches. Two of 10^14 different windows agree in both with odds of
some 10^-11. Grams are only counted, by shorter hashes: a clash there adds work and no repeat.

Nulls are empty texts; texts shorter than LENGTH keep all bytes. Null ids come first. Rows
that share a doc_id are versions of one document: of strings that start at the same place,
an arbitrary one counts as the earlier, and each has its row. Ids may be of any type that has an
order. Empty tables give none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.batches import forget, long_ids, named_back, send_package, written
from corvane.llm.exchange import FORWARD, Batches, forward_rows, key_bits, pack, pack_counts, pack_sorted, part_by_part, read_totals, slices, totals, unpack, unpack_counts, unpack_sorted
from corvane.llm.words import BYTE_VALUE, OTHER_VALUE, STEP, U64, flat, mix, powers, span_hashes

LENGTH = 100
GRAM = 32
#: Window starts parsed at once; places must fit in PLACE_BITS.
PIECE = 1 << 18
PLACE_BITS = 20


def phrases(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window start, last window start, trigger's place, trigger's hash) of the phrases of texts laid end to end."""
    up, down = powers()
    span = length - gram + 1  # grams of a window
    place_mask = U64((1 << PLACE_BITS) - 1)
    out: list[tuple] = []
    for lo in range(0, max(len(raw) - length + 1, 0), PIECE):
        hi = min(lo + PIECE, len(raw) - length + 1)
        data = raw[lo : hi + length - 1]
        total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=total[1:])
        m = len(data) - gram + 1
        grams = mix((total[gram:] - total[:m]) * down[:m])
        marked = np.full(-(-m // span) * span, ~U64(0), dtype=U64)
        marked[:m] = (grams & ~place_mask) | np.arange(m, dtype=U64)
        blocks = marked.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = hi - lo
        trigger = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & place_mask).astype(np.int64)
        first = int(np.searchsorted(at, lo, side="right")) - 1
        last = int(np.searchsorted(at, hi, side="left"))
        edges = np.clip(at[first : last + 1], lo, hi)
        ends = np.repeat(at[first + 1 : last + 1], np.diff(edges))
        whole = np.arange(lo, hi) + length <= ends
        begins = whole.copy()
        begins[1:] &= ~(whole[:-1] & (trigger[1:] == trigger[:-1]))
        stops = whole.copy()
        stops[:-1] &= ~(whole[1:] & (trigger[1:] == trigger[:-1]))
        a, b = np.flatnonzero(begins), np.flatnonzero(stops)
        out.append((a + lo, b + lo, trigger[a] + lo, grams[trigger[a]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


FIRSTS = "b long, part int, keys binary, checks binary, n binary, doc binary, start binary"
_FIRSTS = pa.schema([("b", pa.int64()), ("part", pa.int32()), *[(name, pa.binary()) for name in ("keys", "checks", "n", "doc", "start")]])
#: totals of a batch's keys: how often each occurs, and 1 where the batch has the earliest one.
ANSWERS = "b long, part int, totals array<binary>"
_ANSWERS = pa.schema([("b", pa.int64()), ("part", pa.int32()), ("totals", pa.list_(pa.binary()))])
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])
SPARE_BITS = 16
NO_ID = np.iinfo(np.int64).min


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs (key, check), in order: the distinct ones, the first place of each, each pair's place among them, and how often each occurs."""
    order = np.argsort(keys, kind="stable")
    new_key, new_check = (x[order][1:] != x[order][:-1] for x in (keys, checks))
    if (new_check & ~new_key).any():  # one key for two different things
        order = np.lexsort((checks, keys))
        new_key, new_check = (x[order][1:] != x[order][:-1] for x in (keys, checks))
    lead = np.ones(len(keys), bool)
    lead[1:] = new_key | new_check
    at = np.flatnonzero(lead)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(lead) - 1
    first = order[at]
    return keys[first], checks[first], first, place, np.diff(at, append=len(keys))


def send_firsts(b: int, keys: np.ndarray, checks: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray, parts: int) -> pa.Table:
    """A batch's distinct sorted keys with their checks: how often it has each, and where first."""
    rows: dict = {name: [] for name in _FIRSTS.names}
    for p, lo, hi in slices(keys, 64, parts):
        rows["b"].append(b)
        rows["part"].append(p)
        rows["keys"].append(pack_sorted(keys[lo:hi]))
        rows["checks"].append(pack(checks[lo:hi]))
        rows["n"].append(pack_counts(n[lo:hi]))
        rows["doc"].append(pack(doc[lo:hi].astype(np.int64)))
        rows["start"].append(pack(start[lo:hi].astype(np.int64)))
    return pa.table(rows, schema=_FIRSTS)


def order_part(table: pa.Table, offset: int) -> pa.Table:
    """Sort a part's keys with their places; answer each batch which of its keys are the earliest of theirs."""
    batches, part = table["b"].to_pylist(), table["part"][0].as_py() + offset
    keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
    b = np.repeat(np.array(batches), np.diff(edges))
    every = np.concatenate(keys)
    read = lambda name, kind: np.concatenate([unpack(x, kind) for x in table[name].to_pylist()])
    checks, doc, start = read("checks", U64), read("doc", np.int64), read("start", np.int64)
    n = np.concatenate([unpack_counts(x) for x in table["n"].to_pylist()])
    order = np.lexsort((b, start, doc, checks, every))
    lead = np.ones(len(every), bool)
    lead[1:] = (every[order][1:] != every[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    earliest = np.zeros(len(every), np.int64)
    earliest[order[lead]] = 1
    run = np.empty(len(every), np.int64)
    run[order] = np.cumsum(lead) - 1
    total = np.zeros(int(lead.sum()), np.int64)
    np.add.at(total, run, n)
    return pa.table(
        {"b": batches, "part": [part] * len(batches), "totals": [[pack_counts(total[run[i:j]]), pack_counts(earliest[i:j])] for i, j in zip(edges, edges[1:])]}, schema=_ANSWERS
    )


class Parse:
    """A batch's phrases, and what the answers so far say of them."""

    def __init__(self, table: pa.Table, length: int, gram: int, bits: int, parts: int, answers: pa.Table | None = None, name_bits: int = 64):
        self.table = table.sort_by([("doc_id", "ascending")])  # nulls are NO_ID already
        self.raw, self.at = flat(self.table["text"])
        self.doc = np.array(self.table["doc_id"].to_pylist(), dtype=np.int64)
        self.length, self.parts, self.spare = length, parts, U64(64 - name_bits)
        self.first, self.last, _, self.gram = phrases(self.raw, self.at, length, gram)
        self.row = np.searchsorted(self.at, self.first, side="right") - 1
        self.short = self.gram >> U64(64 - bits)
        if answers is None:
            return
        grams, place = np.unique(self.short, return_inverse=True)
        self.repeated = np.flatnonzero(read_totals(answers, 0, parts, 0)[place] > 1)
        a, b = self.first[self.repeated], self.last[self.repeated] + length
        self.gram_total = read_totals(answers, 0, parts, 0)[place][self.repeated]
        self.names, self.checks, self.name_at, self.name_place, self.name_n = self.named(a, b, self.gram[self.repeated])

    def named(self, start: np.ndarray, end: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """The distinct spans of bytes, as ``distinct`` gives them."""
        keys = span_hashes(self.raw, start, end)
        if more is not None:
            keys = mix(keys * U64(STEP) + more)
        return distinct(keys >> self.spare << self.spare, span_hashes(self.raw, start, end, OTHER_VALUE))

    def place(self, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.doc[row], start - self.at[row]

    def dictionary(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of the repeated phrases: which occurrences are the earliest in the corpus; and of those, which have a gram with other phrases."""
        total, earliest = (read_totals(answers, self.parts, self.parts, k) for k in (0, 1))
        leads = np.zeros(len(self.repeated), bool)
        leads[self.name_at] = earliest.astype(bool)
        return leads, leads & (total[self.name_place] < self.gram_total)

    def border_windows(self, mixed: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts and rows of the windows of some repeated phrases; and the distinct ones, as ``distinct`` gives them."""
        which = self.repeated[mixed]
        n = self.last[which] - self.first[which] + 1
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(self.first[which], n) + step
        return (start, np.repeat(self.row[which], n), *self.named(start, start + self.length))


def repeated_bytes(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id", result: Callable[[DataFrame], DataFrame] = lambda found: found, name_bits: int = 64,
) -> DataFrame:
    """Of every row: doc_id, n_bytes, n_removed, the maximal removed runs as spans, and the kept bytes.

    ``result`` is applied before the rows are written to the shared folder, for those who
    don't need the kept bytes themselves. ``name_bits`` is how many bits of the first hash are
    used; with any number the results are the same.
    """
    send_package(docs.sparkSession)
    numbered, names = long_ids(docs, doc_id)
    slim = numbered.select(F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    corpus = Batches(slim)
    bits, parts = key_bits(corpus.chars, SPARE_BITS), corpus.parts(corpus.chars / 16)

    def send_grams(table: pa.Table) -> pa.Table:
        keys, n = np.unique(Parse(table, length, gram, bits, parts).short, return_counts=True)
        return forward_rows(table["b"][0].as_py(), [(keys, [n], bits, parts, 0)])

    def send_phrases(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _FIRSTS.empty_table()
        p = Parse(table, length, gram, bits, parts, answers, name_bits)
        lead = p.repeated[p.name_at]
        return send_firsts(table["b"][0].as_py(), p.names, p.checks, p.name_n, *p.place(p.first[lead], p.row[lead]), parts)

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _FIRSTS.empty_table()
        p = Parse(table, length, gram, bits, parts, answers, name_bits)
        start, row, keys, checks, at, _, n = p.border_windows(p.dictionary(answers)[1])
        return send_firsts(table["b"][0].as_py(), keys, checks, n, *p.place(start[at], row[at]), parts)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _RESULT.empty_table()
        p = Parse(table, length, gram, bits, parts, answers, name_bits)
        leads, mixed = p.dictionary(answers)
        start, _, _, _, at, _, _ = p.border_windows(mixed)
        stays = np.zeros(len(start), bool)
        stays[at] = read_totals(answers, 2 * parts, parts, 1).astype(bool)
        again = p.repeated[~leads]
        cover = np.zeros(len(p.raw) + 1, np.int32)
        np.add.at(cover, np.concatenate([p.first[again], start[~stays]]), 1)
        np.add.at(cover, np.concatenate([p.last[again], start[~stays]]) + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        rows: dict = {name: [] for name in _RESULT.names}
        for doc, lo, hi in zip(p.doc.tolist(), p.at[:-1].tolist(), p.at[1:].tolist(), strict=True):
            own = gone[lo:hi]
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            rows["doc_id"].append(None if doc == NO_ID else doc)
            rows["n_bytes"].append(hi - lo)
            rows["n_removed"].append(int(own.sum()))
            rows["spans"].append(edge.tolist())
            rows["kept"].append(p.raw[lo:hi][~own].tobytes())
        return pa.table(rows, schema=_RESULT)

    answers = written(totals(corpus.each(send_grams, FORWARD), parts).where("b >= 0").select("b", "part", "totals"), "grams")
    tables = [answers]
    for k, (send, name) in enumerate(((send_phrases, "phrases"), (send_windows, "windows")), 1):
        found = part_by_part(corpus.replied(answers, send, FIRSTS), parts, partial(order_part, offset=k * parts), ANSWERS)
        tables.append(written(found, name))
        answers = answers.unionByName(tables[-1])
    removed = written(named_back(result(corpus.replied(answers, remove, RESULT)), names, "doc_id"), "kept")
    corpus.drop()
    forget(*tables)
    return removed
