"""Vector codes against plain Lloyd rounds in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from corvane.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, bounds int, error string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, label, "v", "c", 1, "e") for i, e, label in rows], SCHEMA).repartition(3)


def brute(rows, entries=256, rounds=4, parts=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    square = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda k: (square(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(near(cut(v)[p], books[p]), []).append(cut(v)[p])
            for k, own in mine.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, v, label in kept:
        codes = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, label, "".join(f"{c:02x}" for c in codes), sum(square(x, books[p][codes[p]]) for p, x in enumerate(cut(v)))))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted([(i, code, error, sums[label]) for i, label, code, error in out], key=repr), digest


def check(spark, rows, **more):
    coded, books = vectors.encode(table(spark, rows), **more)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vectors.with_label_errors(coded).collect()), key=repr)
    expected, digest = brute(rows, **more)
    assert got == expected and vectors.digest(books) == digest


def test_random_vectors_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)], [None, 1, 2][i % 3]) for i in rng.permutation(400)]
    rows += [(900, None, 1), (901, [None] * 16, 1), (902, [math.nan] * 16, 2), (903, [math.inf] + [0.0] * 15, 2), (904, [0.0] * 16, None), (None, [1.0] * 16, 5), (5, [0.25] * 16, 7), (5, [0.25] * 16, 7)]
    check(spark, rows, entries=64)


def test_ties_repeated_vectors_and_unused_entries(spark):
    """Entries that are equal, parts between two entries, and entries that nothing is nearest to."""
    rng = np.random.default_rng(1)
    grid = [[float(x) / 512 for x in rng.integers(-2, 3, 8)] for _ in range(40)]
    rows = [(i, grid[int(rng.integers(0, 40))], int(i % 2)) for i in range(300)]
    check(spark, rows)
    check(spark, rows, entries=16, rounds=7)


@pytest.mark.parametrize("n", [1, 3, 200])
def test_fewer_rows_than_entries(spark, n):
    rng = np.random.default_rng(n)
    check(spark, [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(n)])


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(8)
    check(spark, [(i, [float(x) for x in rng.integers(-(2**17), 2**17, 8)], 0) for i in range(120)], entries=12)


def test_empty_table_and_only_dropped_rows(spark):
    for rows in ([], [(1, None, 1), (2, [math.nan] * 8, 1)]):
        coded, books = vectors.encode(table(spark, rows))
        assert vectors.with_label_errors(coded).count() == 0 and vectors.digest(books) == hashlib.sha256(b"").hexdigest()


def test_vectors_that_cannot_be_coded(spark):
    with pytest.raises(ValueError, match="length"):
        vectors.encode(table(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(Exception, match="one length"):
        vectors.encode(table(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)]), entries=1)[0].count()
    with pytest.raises(Exception, match="too large"):
        vectors.encode(table(spark, [(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1)]))[0].count()


def test_bounds_save_distances():
    """After the first round most groups aren't scanned, and what is assigned is the same."""
    rng = np.random.default_rng(6)
    middle = rng.integers(-4000, 4000, (64, 8))
    x = (middle[rng.integers(0, 64, 3000)] + rng.integers(-150, 150, (3000, 8))).astype(np.int64)
    books = vectors.moved_to(None, x[None, :64].copy())
    code, bounds, work = vectors.assign(x, None, None, books, 0)
    assert work >= 3000 * 64
    for _ in range(3):
        entries = books.entries.copy()
        for k in np.unique(code):
            entries[0, k] = x[code == k].sum(0) // (code == k).sum()
        books = vectors.moved_to(books, entries)
        code, bounds, work = vectors.assign(x, code, bounds, books, 0)
        assert (code == ((x[:, None, :] - entries[0][None]) ** 2).sum(2).argmin(1)).all()
    assert work < 3000 * 64 / 4
