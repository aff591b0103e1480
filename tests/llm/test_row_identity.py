"""Where an id repeats with other texts, or is null, each group keeps exactly the row it chose."""

from corvane.llm import exact_dedup, jaccard
from tests.llm.helpers import frame, prose


def left(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)


def test_ids_that_repeat_with_other_texts(spark):
    a, b = prose(30), prose(30)
    docs = frame(spark, [(5, a), (5, b), (3, a), (9, b)])
    assert left(exact_dedup.deduplicate(docs)) == sorted([(3, a), (5, b)])
    assert left(jaccard.one_of_each(docs)) == sorted([(3, a), (5, b)])


def test_near_copies_that_share_their_id(spark):
    words = prose(100).split(" ")
    near = " ".join([*words[:50], "changed", *words[51:]])
    got = left(jaccard.one_of_each(frame(spark, [(3, " ".join(words)), (3, near), (7, near)])))
    assert len(got) == 1 and got[0][0] == 3


def test_copies_without_an_id_go(spark):
    a, b = prose(30), prose(30)
    docs = frame(spark, [(None, a), (4, a), (None, b), (None, "")])
    assert left(exact_dedup.deduplicate(docs)) == sorted([(4, a), (None, b), (None, "")], key=repr)
