"""Searches of the reference corpus of our own: what is found first, what finds nothing, and which platform is preferred; from the texts and from an index alike."""

import pytest

from corvane.functions.segment import passages
from corvane.operators import index, retrieval
from corvane.plans.knowledge import knowledge

QUERY = "query_id long, query string, expansion string, category string"
CASES = [
    ("a message wants my password and a verification code", "", "message", "message_phishing"),
    ("someone asks me to pay with a gift card", "", "message", "message_avoid_scam"),
    ("a stranger wants remote access to my phone", "", "message", "message_remote"),
    ("a warning with a number in a browser tab", "", "popup", "popup_safari"),
    ("my wifi connection has a checkmark", "iPhone Wi-Fi no internet connection", "wifi", "wifi_iphone"),
    ("is a public network without encryption safe", "", "wifi", "wifi_public_safety"),
    ("how long does pasta cook", "", "message", None),
    ("iphone message text network", "", "message", None),
    ("pay with a gift card", "", "wifi", None),
    ("", "", None, None),
]


@pytest.fixture(scope="module")
def searches(spark, tmp_path_factory):
    corpus = knowledge(spark)
    table = retrieval.passage_table(corpus, passages())
    found = index.build(corpus, passages(), str(tmp_path_factory.mktemp("index") / "i"))
    return {"texts": lambda q: retrieval.search_passages(q, corpus, table), "index": lambda q: found.search_passages(q)}


@pytest.mark.parametrize("how", ["texts", "index"])
def test_the_first_source_of_each_question(spark, searches, how):
    queries = spark.createDataFrame([(k, q, e, c) for k, (q, e, c, _) in enumerate(CASES)], QUERY)
    first = {r.query_id: r.doc_id for r in searches[how](queries).where("rank = 1").collect()}
    assert [first.get(k) for k in range(len(CASES))] == [wanted for *_, wanted in CASES]


@pytest.mark.parametrize("how", ["texts", "index"])
def test_other_platforms_are_seen_only_by_those_who_name_them(spark, how, tmp_path):
    rows = [("any", "Lost password", "message", "any", ["password"], "Reset the password of an account by its own page and nowhere else."), ("ios", "Lost password", "message", "ios", ["password"], "Reset the password of an account by the settings of the phone and nowhere else.")]
    docs = spark.createDataFrame(rows, "doc_id string, title string, category string, platform string, tags array<string>, text string")
    queries = spark.createDataFrame([(1, "my password", "", "message"), (2, "my password on an apple phone", "", "message"), (3, "my icloud password", "", "message")], QUERY)
    if how == "texts":
        got = retrieval.search_passages(queries, docs, retrieval.passage_table(docs, passages())).collect()
    else:
        got = index.build(docs, passages(), str(tmp_path / "i")).search_passages(queries).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {(1, "any"), (2, "any"), (2, "ios"), (3, "any"), (3, "ios")}
