
import pytest
from pyspark.sql import functions as F

from corvane.functions import html, json_text, segment, text


def values(spark, rows, kind, *columns):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]




def test_reject_reasons(spark):
    rows = ["", " \n\t ", "x" * 4000, "x" * 4001, "a\0b", "tab\tand\nline", None, " ", "ok"]
    assert values(spark, rows, "string", text.reject_reason(F.col("x"))) == ["blank", "blank", None, "too_long", "control_characters", None, "blank", "blank", None]


def test_search_terms_are_a_set_without_stop_words(spark):
    got = values(spark, ["The Wi-Fi and the E-mail pop-up, wi-fi Straße 12"], "string", text.search_terms(F.col("x")))[0]
    assert sorted(got) == sorted(["wifi", "email", "popup", "strasse", "12"])


def test_passage_terms_are_a_bag_with_plurals_cut_after_stop_words(spark):
    got = values(spark, ["Scams says glasses bus status this scam links class does"], "string", text.passage_terms(F.col("x")))[0]
    assert got == ["scam", "glasse", "bus", "status", "scam", "link", "class"]


def test_dedup_keys(spark):
    strong = values(spark, ["A  b\n C", " a B c ", "Straße", "STRASSE"], "string", text.dedup_key(F.col("x")))
    weak = values(spark, ["A  b ", "\ta  B\n", "a b"], "string", text.weak_key(F.col("x")))
    assert strong[0] == strong[1] == "a b c" and strong[2] == strong[3] and weak[0] == weak[1] != weak[2]


@pytest.mark.parametrize(
    ("raw", "safe"),
    [
        ("see https://a.b/c?d now", "see https://source-link.example now"),
        ("www.site.example rest", "https://source-link.example rest"),
        ("mail to é.x+y@mail.example.com.", "mail to [EMAIL]."),
        ("call 0800 123 4567 now", "call [PHONE] now"),
        ("call 0800 123 456 now", "call 0800 123 456 now"),
        ("call 07700 900 123 now", "call [PHONE] now"),
        ("ring 08700xxxx today", "ring [PHONE] today"),
        ("code 123456 but 1234 stays", "code [NUMBER] but 1234 stays"),
        ("PO Box 12a/3 here", "[POSTBOX] here"),
        ("at SW1A 1AA, yes", "at [POSTCODE], yes"),
        ("a&lt;b  &amp; c <fone no>", "a<b & c [PHONE]"),
        ("it costs £1.50 for 10 mins", "it costs £1.50 for 10 mins"),
    ],
)
def test_redaction(spark, raw, safe):
    assert values(spark, [raw], "string", text.redacted(F.col("x"))) == [safe]


def test_comparison_tokens_unify_links_and_numbers(spark):
    a, b = values(spark, ["Pay £12.50 at https://a.b/c ＮＯＷ", "pay £99 at http://z.y now"], "string", text.exact_comparison_tokens(F.col("x")))
    assert a == b == ["pay", "number", "at", "url", "now"]


def test_trusted_urls(spark):
    rows = [["https://consumer.ftc.gov/a"], [], ["http://consumer.ftc.gov/a"], ["https://consumer.ftc.gov.evil.example/"], ["https://support.apple.com/x", "https://other.example"], ["not a url"]]
    assert values(spark, rows, "array<string>", text.trusted_urls(F.col("x"))) == [True, False, False, False, False, False]


def test_passages_are_literal_and_stable():
    first = "Heading\n\n" + " ".join(["Some words make up this plain sentence here."] * 12) + "\n\nToo short"
    got = segment.passages_of(first)
    assert got == segment.passages_of(first) and all(p in first for p in got) and len(got) > 1
    assert all(segment.n_words(p) <= 75 for p in got)
    long = "word " * 200 + "end."
    assert segment.passages_of(long) == [long.strip()]
    assert segment.passages_of('He said "go." Then he left the room at once.') == ['He said "go." Then he left the room at once.']
    assert segment.passages_of(None) == [] and segment.passages_of("a b c") == []


def test_sentence_units_join_what_leans_and_what_contrasts():
    passage = "Scammers send many messages every day. They hope that someone will answer them. Is this one real? It is not easy to say.\n\nThis one has nothing before it at all."
    assert segment.units_of(passage) == ["Scammers send many messages every day. They hope that someone will answer them. Is this one real? It is not easy to say."]
    contrast = "In the past, open networks were rather risky. Today, most sites use good encryption."
    assert segment.units_of(contrast) == [contrast]
    assert segment.units_of("Today, most sites use good encryption. Only four words here.") == ["Today, most sites use good encryption."]


def test_article_text_with_and_without_gates():
    page = "<html><script>var t='</p>';</script><nav><p>menu</p></nav><article><h1>T</h1><p>one &amp; two<br>three<script>no</script></article><p>after</p>"
    assert html.article_of(page).split() == ["T", "one", "&", "two", "three"]
    assert "menu" not in html.article_of(page) and "after" not in html.article_of(page) and "no" not in html.article_of(page).split()
    advice = '<main id="main-content"><article class="x node--view-mode-cfg-default"><div>skip</div><div class="field--name-body"><p>Body <b>text</b></p><div>inner</div></div><div>skip</div></article></main>'
    assert html.article_of(advice, html.ADVICE_ARTICLE) == "Body text\n\ninner"
    assert html.article_of("<p>x</p>", html.ADVICE_ARTICLE) == "" and html.article_of(None) == ""


GOOD = '{"source_id":"S1","sentence_id":1,"insufficient_evidence":false}'


@pytest.mark.parametrize(
    ("draft", "outcome"),
    [
        (GOOD, "answered"), ("```json\n" + GOOD + "\n```", "answered"), (GOOD + " {}", "invalid_citation"), ("```json\n" + GOOD, "invalid_citation"), ("", "invalid_citation"),
        ("[]", "invalid_citation"), (GOOD.replace("1,", '"1",'), "invalid_citation"), (GOOD.replace("1,", "1.0,"), "invalid_citation"), (GOOD.replace("1,", "true,"), "invalid_citation"),
        (GOOD.replace("1,", "-1,"), "invalid_citation"), (GOOD.replace("1,", "3,"), "invalid_citation"), (GOOD.replace("1,", "0,"), "invalid_citation"), (GOOD.replace("S1", "S2"), "invalid_citation"),
        (GOOD.replace("false", "0"), "invalid_citation"), (GOOD.replace("}", ',"x":1}'), "invalid_citation"), (GOOD.replace("S1", "S" * 21), "invalid_citation"),
        ('{"source_id":"","sentence_id":0,"insufficient_evidence":true}', "insufficient_evidence"), (GOOD.replace("false", "true"), "invalid_citation"),
    ],
)
def test_strict_drafts(spark, draft, outcome):
    df = spark.createDataFrame([(draft,)], "x string").withColumn("d", json_text.parsed_draft(text.without_fence(F.col("x"))))
    assert df.select(json_text.draft_outcome(F.col("d"), F.lit("S1"), F.array(F.lit("a"), F.lit("b")))).first()[0] == outcome


def test_observation_json_and_decision_spans(spark):
    rows = [("message", [("visible_link", 'say "hi"\n'), ("wifi_off", "é")], [])]
    df = spark.createDataFrame(rows, "category string, signals array<struct<signal:string,evidence:string>>, issues array<string>")
    content = df.select(json_text.observation_json(F.col("category"), F.col("signals"), F.col("issues")).alias("c")).withColumn("s", json_text.decision_spans(F.col("c"))).first()
    import json

    expected = json.dumps({"category": "message", "signals": [{"signal": s, "evidence": e} for s, e in rows[0][1]], "issues": []}, ensure_ascii=False)
    assert content.c == expected
    assert {expected[a:b] for a, b in content.s} == {'"message"', "[", '"visible_link"', '}, {"signal"', '"wifi_off"', "]", "[]"}


def test_token_weights_and_completion_start(spark):
    df = spark.createDataFrame([([(0, 3), (3, 5), (5, 9)], [[4, 6]], [1, 2], [1, 2, 3])], "t array<struct<from:int,to:int>>, s array<array<int>>, p array<int>, f array<int>")
    row = df.select(json_text.token_weights(F.col("t"), F.col("s"), 4.0), json_text.completion_start(F.col("p"), F.col("f")), json_text.completion_start(F.col("f"), F.col("f"))).first()
    assert list(row) == [[1.0, 4.0, 4.0], 2, None]


def test_functions_by_their_sql_names(spark):
    from corvane.functions import sql
    from pyspark.sql import functions as F

    names = sql.register(spark)
    assert {"search_terms", "passage_terms", "dedup_key", "redacted", "chunk_text", "literal_cues", "article_text"} <= set(names)
    raw = ["see https://a.b/c?d now", "a&lt;b  &amp; c <fone no>", "mail to é.x+y@mail.example.com.", "call 0800 123 4567 now", "The Wi-Fi and the E-mail pop-ups, links", None]
    df = spark.createDataFrame([(x,) for x in raw], "x string")
    df.createOrReplaceTempView("texts_by_name")
    by_name = spark.sql("SELECT redacted(x), search_terms(x), passage_terms(x), dedup_key(x) FROM texts_by_name").collect()
    c = F.col("x")
    assert [tuple(r) for r in by_name] == [tuple(r) for r in df.select(text.redacted(c), text.search_terms(c), text.passage_terms(c), text.dedup_key(c)).collect()]
    one = spark.sql("SELECT literal_cues('Please send me $5 now'), chunk_text('A b c d e. F g h i j.', 5), article_text('<article><p>x</p></article>')").first()
    assert one[0][0].signal == "payment_request" and one[1] == ["A b c d e.", "F g h i j."] and one[2] == "x"


def test_entities_that_were_cut_off_are_text_where_asked_for(spark):
    raw = ["and&amp", "a &amp b &lt; c", "&ampx; &notit; &bogus; &#65 &#65; &#x42;", "&amp;lt;", None, ""]
    cut, closed = text.redacted(F.col("x")), text.redacted(F.col("x"), cut_entities=False)
    assert values(spark, raw, "string", closed) == ["and&amp", "a &amp b < c", "&ampx; &notit; &bogus; &#65 A B", "&lt;", None, ""]
    assert values(spark, raw, "string", cut) == ["and&", "a & b < c", "&x; ¬it; &bogus; A A B", "&lt;", None, ""]


def test_article_keeps_entities_that_were_cut_off_where_asked_for(spark):
    page = '<article class="a&ampb"><p>and&amp</p><p>a &amp b &lt;i&gt; &copy; x&</p></article>'
    assert html.article_of(page, cut_entities=False) == "and&amp\n\na &amp b <i> © x&"
    assert html.article_of(page) == "and&\n\na & b <i> © x&" and html.article_of(None, cut_entities=False) == ""
    assert html.article_of('<main id="x&y"><p> &amp</p></main>', html.Gate("main#x&y", ""), cut_entities=False) == "&amp"
    assert values(spark, [page], "string", html.article_text(cut_entities=False)(F.col("x"))) == ["and&amp\n\na &amp b <i> © x&"]


def test_weights_compute_spans_once_a_text(spark):
    """The spans are expressions over the whole text: computed for each token they took the square of its length."""
    n = F.length("text")
    tokens = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("from"), (i + 1).alias("to")))
    rows = spark.createDataFrame([("abcdef",), ("",)], "text string").select("text", tokens.alias("tokens"), F.array(F.array(F.floor(n / 2), F.floor(n / 2) + 2)).alias("spans"))
    found = rows.select(json_text.token_weights(F.col("tokens"), F.col("spans"), 4.0).alias("w"))
    assert sorted(r.w for r in found.collect()) == [[1.0, 1.0, 1.0, 4.0, 4.0, 1.0, 1.0], [4.0]]
    inside = found._jdf.queryExecution().optimizedPlan().toString().split("exists(")[1]
    assert "length(" not in inside.split("lambdafunction")[0]
