"""The source divergence audit against a plain recount, and its odd cases."""

import re
from collections import Counter

import pytest

from corvane.llm import divergence
from tests.llm.helpers import frame, lower, odd_texts, prose

COLUMNS = "doc_id long, text string, lang string, source string, term string, n long, item string, value long, rank int"


def brute(rows, least=3, most=200):
    """rows of (text, lang, source)."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in rows]
    groups, out = sorted({(a, b) for a, b, _ in words}), []
    for lang in {a for a, _ in groups}:
        held = Counter(t for a, _, w in words if a == lang for t in set(w))
        kept = {t for t, k in held.items() if k >= least}
        counts = {s: Counter(t for a, b, w in words if (a, b) == (lang, s) for t in w if t in kept) for a, s in groups if a == lang}
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda x, y: (x - y) ** 2 // y
        for s, c in counts.items():
            pairs = [(o, sum(f(p(c, t), p(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            terms = [(t, f(p(c, t), p(whole, t))) for t in c if p(c, t) > p(whole, t)]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    full = [(i, text, lang, source, "x", 1, "y", 2, 3) for i, (text, lang, source) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


def found(docs, **more):
    return sorted(tuple(r) for r in divergence.audit(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus():
    rows = [(text, lang, source) for k, (_, text) in enumerate(odd_texts()) for lang, source in [(("en", "de", None)[k % 3], ("a", "b", "c", "é", None)[k % 5])]]
    rows += [(prose(40), "en", f"s{k % 4}") for k in range(40)]
    rows += [(None, "en", "silent"), ("1 2 3", "en", "digits"), ("once only", "xx", "one"), ("other", "xx", "two"), (prose(30), "fr", "alone")]
    rows += [("Word word WORD tie TIE", "tt", "left")] * 3 + [("word tie", "tt", "right")] * 2  # ties and repeated rows
    return rows


def test_matches_a_plain_recount(spark):
    rows = corpus()
    got = found(table(spark, rows))
    assert got == brute(rows)
    assert {r[:4] for r in got if r[0] == "xx"} == {("xx", "one", "pair", "two"), ("xx", "two", "pair", "one")}  # a language that keeps no term
    assert all(r[4] == 0 for r in got if r[0] == "xx")
    assert any(r[:3] == ("en", "silent", "pair") for r in got) and not any(r[:3] == ("en", "silent", "term") for r in got)


@pytest.mark.parametrize("least, most", [(1, 3), (2, 1000)])
def test_other_parameters(spark, least, most):
    rows = corpus()
    assert found(table(spark, rows), least=least, most=most) == brute(rows, least, most)


def test_a_long_text_is_counted_whole_and_by_pieces(spark, monkeypatch):
    rows = [(prose(4000) + " Tail", "en", "long"), ("tail " * 5, "en", "short"), ("tail", "en", "short")]
    assert found(table(spark, rows)) == brute(rows)


def test_counts_beyond_a_long(spark):
    """10^9 * count passes 2^63 where a term is there ten thousand million times."""
    from pyspark.sql import functions as F

    n, total, kept = 9_500_000_000_000, 10_000_000_000_000, 123_456
    row = spark.range(1).select(divergence.rate(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 1) // (total + kept)


def test_empty_table_and_no_rows_are_lost(spark):
    assert found(frame(spark, [])) == []
