"""MinHash near-dedup against brute force."""

import random

import numpy as np
import pytest

from corvane.llm import minhash
from tests.llm.helpers import frame, odd_texts, prose
from tests.llm.test_exact_and_near import brute_components


def check(spark, rows):
    sets, label = brute_components(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.minhash_components(frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i, _ in rows}
    return label


def test_odd_texts(spark):
    check(spark, list({r[0]: r for r in odd_texts() if r[0] is not None}.values()))


def edited(base, most, rng):
    words = list(base)
    for _ in range(rng.randrange(most + 1)):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_a_large_group_of_near_copies_with_stragglers(spark):
    """Some aren't linked to the hub of their bucket but to one another, so what the hub leaves open is looked for."""
    rng = random.Random(5)
    base = prose(120, rng).split(" ")
    rows = [(i, edited(base, 6, rng)) for i in range(150)]
    far = edited(base, 0, rng).split(" ")
    far[10:16] = [f"other{k}" for k in range(6)]  # not linked to base, a group of its own
    rows += [(300 + i, edited(far, 2, rng)) for i in range(40)] + [(400 + i, prose(60, rng)) for i in range(20)]
    label = check(spark, rows)
    assert len(set(label.values())) > 21


def test_texts_of_one_template_are_no_copies(spark):
    """Half of each text is the template: they meet in buckets and stay apart."""
    rng = random.Random(9)
    template = prose(60, rng)
    rows = [(i, template + " " + prose(60, rng)) for i in range(80)]
    label = check(spark, rows)
    assert len(set(label.values())) == 80


def test_whole_sets_come_in_slices(spark, monkeypatch):
    rng = random.Random(4)
    base = prose(2600, rng).split(" ")
    rows = [(k, edited(base, 60, rng)) for k in range(6)] + [(10, " ".join(base[:1200])), (11, " ".join(base[:1100]))]
    monkeypatch.setattr(minhash, "SLICE_BITS", 5)
    check(spark, rows)


def test_a_chain_of_links(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words)))
        words[(k * 11) % 190 : (k * 11) % 190 + 3] = [f"n{k}a", f"n{k}b", f"n{k}c"]
    rng.shuffle(rows)
    label = check(spark, rows)
    assert set(label.values()) == {0}


def test_rows_that_share_ids_null_ids_and_other_types(spark):
    a, b = prose(30), prose(30)
    got = minhash.minhash_components(frame(spark, [(5, a), (5, b), (3, a), (9, b), (None, a), (5, b)])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (9, 5, False), (None, None, True)], key=repr)
    docs = spark.createDataFrame([("y", a), ("x", a), ("z", b), (None, a)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.minhash_components(docs).collect()} == {("x", "x"), ("y", "x"), ("z", "z"), (None, None)}
    left = minhash.one_of_each(frame(spark, [(5, a), (5, b), (3, a), (9, b), (None, a)]))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(3, a), (5, b), (None, a)], key=repr)
    assert left.columns == frame(spark, []).columns


def test_empty_table(spark):
    assert minhash.minhash_components(frame(spark, [])).count() == 0


def test_posterior_and_batches():
    """The least number of agreeing values is the first whose posterior isn't negligible, by numerical integration."""
    x = np.linspace(0, 1, 400_001)
    for n in (16, 64, 160):
        m = minhash.least_agreeing(n, 85, 1e-6)
        for k, enough in ((m - 1, False), (m, True)):
            if k < 0:
                continue
            density = x**k * (1 - x) ** (n - k)
            assert (density[x >= 0.85].sum() / density.sum() >= 1e-6) is np.True_ or not enough
            assert enough or density[x >= 0.85].sum() / density.sum() < 1e-6
    assert minhash.least_agreeing(16, 85, 0.0) == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    shared, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (3000, 500, 500))
    one, two = minhash.signatures([np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))])
    assert abs((one == two).mean() - 3000 / 4000) < 0.12


@pytest.mark.parametrize("sizes", [[1], [1, 70000, 2], [minhash.HASHED_AT_ONCE, 5, minhash.HASHED_AT_ONCE + 1]])
def test_signatures_do_not_depend_on_blocks(sizes):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in sizes]
    together = minhash.signatures(sets)
    assert all((together[i] == minhash.signatures([own])[0]).all() for i, own in enumerate(sets))
