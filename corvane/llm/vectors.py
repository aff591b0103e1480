"""Vector code compression: product codes whose codebooks are learned by Yinyang Lloyd rounds, exactly.

A component x becomes the integer floor(``SCALE`` * x); a vector is cut into ``PARTS`` equal
parts, each coded by the nearest entry of that part's codebook (squared Euclidean distance, ties
to the lower index). Codebooks start as the parts of the ``ENTRIES`` smallest ids; each round
replaces an entry by the componentwise floor of the mean of its parts.

Yinyang: the entries of a codebook are put into ``GROUPS`` groups of neighbours once. A vector
keeps, for each part, an upper bound of the distance to its entry and one lower bound a group.
When codebooks move, bounds move by the drift of the entry and by the largest drift of the
group. Only groups whose lower bound isn't above the upper one are scanned, with integer
distances; bounds are floats rounded away from each other, so a tie is always scanned and
integers decide it. A round reads the table of vectors, codes and bounds, writes the next and
adds up each entry's parts in Spark; the driver holds the codebooks, whose size is fixed.

Rows whose vector is null or has a null or non-finite component are dropped. Vectors must have
one length, a multiple of ``PARTS``, and integers whose squared distances fit 62 bits; else
ValueError. Rows with the same id are vectors of their own, in the order of their components
where the first ids are chosen; a null id is the last in that order, and coded like any other.
With fewer than ``ENTRIES`` rows there are as many entries as rows. Vectors without components
have distance 0. Labels of any type; null labels are one label. Extra columns are ignored, and
an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.batches import forget, send_package, written
from corvane.session import spread

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 4, 256, 4, 16, 1024
#: Vectors that are compared with a group of entries at once.
ROWS_AT_ONCE = 4096

STATE = "v array<long>, code array<int>, bounds array<float>"


@dataclass(frozen=True)
class Codebooks:
    """entries (parts, entries, components), the group of each entry, and how far entries and groups have moved since the bounds were written."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray
    group_moved: np.ndarray

    @property
    def groups(self) -> int:
        return self.group_moved.shape[1]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each of x to each of the entries."""
    if not x.size or not entries.size:
        return np.zeros((len(x), len(entries)), np.int64)
    most, width = int(max(np.abs(x).max(), np.abs(entries).max())), x.shape[1]
    if 4 * width * most * most >= 1 << 62:
        raise ValueError("components are too large for exact distances")
    if 4 * width * most * most < 1 << 52:  # floats hold every sum exactly
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return (x * x).sum(1)[:, None] + (entries * entries).sum(1)[None, :] - 2 * (x @ entries.T)


def above(x: np.ndarray) -> np.ndarray:
    """Floats of 32 bits that are surely not below, whatever was rounded."""
    return np.nextafter(np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf))


def grouped(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """The group of each entry of each part: some rounds of Lloyd over the entries themselves."""
    found = np.zeros(entries.shape[:2], np.int64)
    for part, own in enumerate(entries.astype(np.float64)):
        middle = own[np.linspace(0, max(0, len(own) - 1), min(groups, max(1, len(own)))).astype(np.int64)] if len(own) else own
        for _ in range(rounds if len(own) else 0):
            found[part] = ((own[:, None, :] - middle[None, :, :]) ** 2).sum(2).argmin(1)
            for g in range(len(middle)):
                if (found[part] == g).any():
                    middle[g] = own[found[part] == g].mean(0)
    return found


def moved_to(old: Codebooks | None, entries: np.ndarray, groups: int = GROUPS) -> Codebooks:
    """The next codebooks, with their drift against the old ones."""
    group = grouped(entries, groups) if old is None else old.group
    n = int(group.max()) + 1 if group.size else 1
    drift = np.zeros(entries.shape[:2])
    if old is not None:
        drift = np.sqrt(((entries - old.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-12)
    by_group = np.zeros((len(entries), n))
    for part in range(len(entries)):
        np.maximum.at(by_group[part], group[part], drift[part])
    return Codebooks(entries, group, drift, by_group)


def assign(x: np.ndarray, code: np.ndarray | None, bounds: np.ndarray | None, books: Codebooks, part: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each of x, (upper bound, lower bound of each group), and how many distances were computed."""
    entries, group, n = books.entries[part], books.group[part], len(x)
    if code is None:
        code, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.full((n, books.groups), -np.inf)
        own = squared_pairs(x, entries[code])
        scan = np.ones(n, bool)
    else:
        upper = bounds[:, 0].astype(np.float64) + books.moved[part][code]
        lower = bounds[:, 1:].astype(np.float64) - books.group_moved[part]
        scan = upper >= lower.min(1)
        own = np.full(n, -1, np.int64)
        own[scan] = squared_pairs(x[scan], entries[code[scan]])
        upper[scan] = np.sqrt(own[scan].astype(np.float64)) * (1 + 1e-12)
        scan &= upper >= lower.min(1)
    work = int(scan.sum())
    before, best, nearest = code, own.copy(), code.copy()
    first, second = np.full(lower.shape, -1, np.int64), np.full(lower.shape, -1, np.int64)
    for g in range(books.groups):
        members = np.flatnonzero(group == g)
        at = np.flatnonzero(scan & (lower[:, g] <= upper))
        if not len(members):
            lower[:, g] = np.inf
            continue
        for a in range(0, len(at), ROWS_AT_ONCE):
            rows = at[a : a + ROWS_AT_ONCE]
            d = squared(x[rows], entries[members])
            work += d.size
            k = d.argmin(1)  # the first of equals, and members ascend
            low = d[np.arange(len(rows)), k]
            first[rows, g] = low
            d[np.arange(len(rows)), k] = np.iinfo(np.int64).max
            second[rows, g] = d.min(1)
            wins = (low < best[rows]) | ((low == best[rows]) & (members[k] < nearest[rows]))
            best[rows[wins]], nearest[rows[wins]] = low[wins], members[k[wins]]
    seen = first >= 0
    root = lambda d: np.sqrt(d.astype(np.float64)) * (1 - 1e-12)
    lower = np.where(seen, root(np.maximum(first, 0)), lower)
    at = np.flatnonzero(scan)
    mine = group[nearest[at]]
    scanned = seen[at, mine]
    own_group = at[scanned], mine[scanned]
    lower[own_group] = np.where(second[own_group] == np.iinfo(np.int64).max, np.inf, root(second[own_group]))
    left = at[nearest[at] != before[at]]  # the entry left behind is one of its group's others now, scanned or not
    lower[left, group[before[left]]] = np.minimum(lower[left, group[before[left]]], root(own[left]))
    upper[at] = np.sqrt(best[at].astype(np.float64)) * (1 + 1e-12)
    return nearest, np.column_stack([above(upper), below(lower)]), work


def squared_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of each of x to that of y in its place."""
    if x.size and 4 * x.shape[1] * int(max(np.abs(x).max(), np.abs(y).max())) ** 2 >= 1 << 62:
        raise ValueError("components are too large for exact distances")
    return ((x - y) ** 2).sum(1)


def wide(column: pa.Array, kind, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    if len(column) and pc.min_max(pc.list_value_length(column)).as_py() != {"min": width, "max": width}:
        raise ValueError("vectors must have one length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), width)


def parts_of(v: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, components) of vectors."""
    return np.ascontiguousarray(v.reshape(len(v), parts, v.shape[1] // parts).transpose(1, 0, 2))


def lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = a.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * width, pa.int32()), pa.array(a.ravel(), kind))


def assigning(books: Codebooks, width: int, final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of vectors (with codes and bounds, or without) to the next round's; ``final`` gives code and error in their place."""

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_parts = len(books.entries)
        for batch in batches:
            names = batch.schema.names
            v = wide(batch.column("v"), np.int64, width)
            known = "code" in names
            code = wide(batch.column("code"), np.int64, n_parts) if known else None
            bounds = wide(batch.column("bounds"), np.float32, n_parts * (1 + books.groups)).reshape(len(v), n_parts, -1) if known else None
            split = parts_of(v, n_parts)
            got = [assign(split[p], code[:, p] if known else None, bounds[:, p] if known else None, books, p) for p in range(n_parts)]
            codes = np.column_stack([g[0] for g in got])
            if final:
                error = sum(squared_pairs(split[p], books.entries[p][codes[:, p]]) for p in range(n_parts))
                kept = [batch.column(c) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([bytes(c).hex() for c in codes.astype(np.uint8)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
            else:
                kept = [batch.column(c) for c in ("vec_id", "label", "v")]
                bound = np.concatenate([g[1] for g in got], axis=1)
                yield pa.RecordBatch.from_arrays([*kept, lists(codes, pa.int32()), lists(bound, pa.float32())], names=["vec_id", "label", "v", "code", "bounds"])

    return function


def summing(n_parts: int, n_entries: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums of the parts of each entry, and their numbers."""

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((n_parts * n_entries, width // n_parts), np.int64), np.zeros(n_parts * n_entries, np.int64)
        for batch in batches:
            code = wide(batch.column("code"), np.int64, n_parts)
            split = parts_of(wide(batch.column("v"), np.int64, width), n_parts)
            for p in range(n_parts):
                np.add.at(sums, p * n_entries + code[:, p], split[p])
                counts += np.bincount(p * n_entries + code[:, p], minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), lists(sums[used], pa.int64())], names=["entry", "n", "sums"])

    return function


def whole_vectors(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label and the integer vector v of the rows that have one."""
    x = F.col(embedding)
    finite = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    return rows.where(finite).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), scaled.alias("v"))


def encode(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (two hexadecimal digits a part) and error of every kept row, written; and the final codebooks (parts, entries, components)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    send_package(rows.sparkSession)
    state = written(whole_vectors(spread(rows), vec_id, embedding, label), "vectors")
    first = state.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # a codebook's size, whatever the table's
    width = len(first[0].v) if first else 0
    if width % parts or any(len(r.v) != width for r in first):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    start = np.array([r.v for r in first], np.int64).reshape(len(first), width)
    books = moved_to(None, parts_of(start, parts))
    id_and_label = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields[:2])
    for _ in range(rounds if first else 0):
        after = written(state.mapInArrow(assigning(books, width, final=False), f"{id_and_label}, {STATE}"), "codes")
        forget(state)
        state = after
        sums = state.select("v", "code").mapInArrow(summing(parts, len(first), width), "entry int, n long, sums array<long>")
        added = sums.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width // parts)]).alias("sums")).collect()  # parts x entries rows
        flat = books.entries.reshape(parts * len(first), width // parts).copy()
        for r in added:
            flat[r.entry] = [s // r.n for s in r.sums]
        books = moved_to(books, flat.reshape(books.entries.shape))
    coded = written(state.mapInArrow(assigning(books, width, final=True), f"{id_and_label}, code string, error long"), "coded")
    forget(state)
    return coded, books.entries


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all integers of the codebooks, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the error summed over the rows of the same label; null labels are one."""
    sums = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same"))).drop("same")
