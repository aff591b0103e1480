import re

import pytest

from corvane.llm import exact_dedup, jaccard
from corvane.llm.components import components
from tests.llm.helpers import blank_words, frame, odd_texts, prose, sha


def test_exact_duplicates_match_brute_force(spark):
    rows = odd_texts()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    ids = {}
    for (i, _), n in zip(rows, norm):
        ids.setdefault(n, []).append(i)
    expected = []
    for (i, _), n in zip(rows, norm):
        known = [x for x in ids[n] if x is not None]
        keep = min(known) if known else None
        expected.append((i, keep, len(ids[n]), i == keep, sha(n)))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_exact_deduplicate_keeps_columns_and_one_of_each(spark):
    docs = frame(spark, odd_texts())
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id in (1, 2, 25, 9, 10, 14, 15)").collect()) == [1, 9, 14]


@pytest.mark.parametrize("doubtful", [0, 1, 3])
def test_chunks_whose_hash_is_not_unique(spark, monkeypatch, doubtful):
    """A hash that stands for two chunks is found by comparing them; every row keeps its row, whichever hashes are doubtful."""
    from pyspark.sql import functions as F

    chunks = spark.createDataFrame([(["a", "b"],), (["a"],)], "chunks array<string>")
    assert exact_dedup.ambiguous_hashes(chunks).count() == 0
    rows = [(1, "x"), (1, "x"), (2, "x"), (3, "y"), (3, "x"), (None, "y"), (4, ""), (5, None), (6, prose(3000)), (7, "y z")]
    plain = sorted(map(repr, exact_dedup.exact_duplicates(frame(spark, rows)).collect()))
    assert len(plain) == len(rows)
    if doubtful:

        def forced(chunks):
            """Some hashes, or all of them, as if each stood for several chunks."""
            return chunks.select(F.explode("chunks").alias("c")).select(F.xxhash64("c").alias("h")).distinct().where(F.pmod("h", F.lit(doubtful)) == 0)

        monkeypatch.setattr(exact_dedup, "ambiguous_hashes", forced)
        assert sorted(map(repr, exact_dedup.exact_duplicates(frame(spark, rows)).collect())) == plain
        docs = frame(spark, rows)
        assert sorted((r.doc_id, r.text) for r in exact_dedup.deduplicate(docs).where("doc_id in (1, 2, 3)").collect()) == [(1, "x"), (1, "x"), (3, "y")]


def test_a_real_clash_of_chunk_hashes_keeps_texts_apart(spark, monkeypatch):
    """With every chunk of the same hash, only the chunks themselves tell texts apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "chunk_hash", lambda x: F.lit(7).cast("long"))
    rows = [(1, "x"), (2, "y"), (3, "x"), (4, prose(2000)), (5, "y")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()}
    assert got == {1: (1, 2), 2: (2, 2), 3: (1, 2), 4: (4, 1), 5: (2, 2)}


def test_chunks_cover_the_text_and_follow_content(spark):
    text = " ".join(f"{prose(30)}." for _ in range(60))
    docs = spark.createDataFrame([(1, text), (2, "Something in front. " + text), (3, "x" * 10000), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.chunks for r in exact_dedup.chunked(docs).collect()}
    assert "".join(got[1]) == text and got[4] == [] and len(got[3]) == 3
    assert len(set(got[1]) & set(got[2])) >= len(got[1]) - 2


def brute_components(rows, n=5, percent=80):
    sets = {}
    for i, t in rows:
        w = blank_words(t)
        sets.setdefault(i, set()).update({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    label = {i: i for i in sets}
    nodes = [i for i in sets if i is not None and sets[i]]
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sets, label


def test_jaccard_components_match_brute_force(spark):
    rows = list({r[0]: r for r in odd_texts() if r[0] is not None}.values())
    sets, label = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i, _ in rows}


def test_jaccard_group_of_many_near_copies_with_stragglers(spark):
    import random

    rng = random.Random(3)
    base = prose(100, rng).split(" ")
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            words[rng.randrange(100)] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, prose(50, rng)) for i in range(20)]
    sets, label = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i, _ in rows}
    assert len(set(label.values())) > 21


def test_jaccard_one_of_each_and_empty_table(spark):
    docs = frame(spark, odd_texts())
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    assert {1} == {r.doc_id for r in left.where("doc_id in (1, 2, 3, 4, 25)").collect()}
    assert left.where("doc_id is null").count() == 1
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [2, 33])
def test_components_of_a_chain(spark, n):
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 99)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 99: 99, 100: 99}


def test_jaccard_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b = prose(30), prose(30)
    got = jaccard.jaccard_components(frame(spark, [(5, a), (5, b), (3, a), (9, b)]))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(3, 3), (5, 3), (5, 5), (9, 5)]


def test_jaccard_takes_ids_of_any_type(spark):
    a, b = prose(30), prose(30)
    docs = spark.createDataFrame([("y", a), ("x", a), ("z", b), (None, a)], "doc_id string, text string")
    got = jaccard.jaccard_components(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {("x", "x"), ("y", "x"), ("z", "z"), (None, None)}
    assert {r.doc_id for r in jaccard.one_of_each(docs).collect()} == {"x", "z", None}
