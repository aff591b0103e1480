import json

from pyspark.sql import functions as F

from corvane.functions import observation
from corvane.operators import evaluation, metrics, policy, training


def test_observation_texts_and_prompt(spark):
    df = spark.createDataFrame([("unknown", ["unsupported", "insufficient_context", "unsupported"]), ("wifi", [])], "category string, issues array<string>")
    rows = df.select(observation.summary(F.col("category")), observation.uncertainty(F.col("issues"))).collect()
    assert rows[0][1] == observation.ISSUE_TEXT["unsupported"] + " " + observation.ISSUE_TEXT["insufficient_context"] and rows[1][1] == observation.NO_ISSUE and rows[1][0].startswith("This describes")
    prompt = spark.range(1).select(observation.selection_prompt("s", F.lit('say "x"'), observation.unknown("unsupported"), F.lit("S1"), F.lit("T"), F.lit("authored_summary"), F.array(F.lit("One."), F.lit("Two."))).alias("p")).first().p
    content = {"input_text": 'say "x"', "analysis": {"category": "unknown", "signals": [], "issues": ["unsupported"]},
               "references": [{"source_id": "S1", "source_type": "authored_summary", "title": "T", "sentences": [{"id": 1, "text": "One."}, {"id": 2, "text": "Two."}]}]}
    assert [m.role for m in prompt] == ["system", "user"] and prompt[1].content == json.dumps(content)


def test_length_violations(spark):
    rows = [(1, [1, 2], [1, 2, 3]), (2, [1, 2], [1, 2]), (3, [2], [1, 2]), (4, [1], list(range(1, 1600))), (5, [1], list(range(1, 300)))]
    got = training.length_violations(spark.createDataFrame(rows, "i long, p array<int>, f array<int>"), "i", "p", "f")
    assert {r.id: r.rule for r in got.collect()} == {2: "completion_boundary", 3: "completion_boundary", 4: "sequence_length", 5: "completion_length"}


def test_epoch_groups_are_a_reproducible_order(spark):
    ids = spark.range(1000)
    one = training.epoch_groups(ids, "id", 1, 1, 16)
    places = {r.id: r.place for r in one.collect()}
    assert sorted(places.values()) == list(range(1000)) and places == {r.id: r.place for r in training.epoch_groups(ids.repartition(7), "id", 1, 1, 16).collect()}
    assert places != {r.id: r.place for r in training.epoch_groups(ids, "id", 1, 2, 16).collect()} and one.groupBy("group_no").count().where("count > 16").count() == 0


def test_checks_fail_where_nothing_can_be_decided(spark):
    row = {"actions": ["clarify"], "evidence_status": "policy_only", "handoff_status": "ready", "handoff_actions": ["clarify"], "handoff_text": policy.LIMITS, "explanation": "", "quote": None, "excerpt": "",
           "text": "secret", "private_markers": ["secret"]}
    kind = "actions array<string>, evidence_status string, handoff_status string, handoff_actions array<string>, handoff_text string, explanation string, quote string, excerpt string, text string, private_markers array<string>"
    fine = spark.createDataFrame([tuple(row.values())], kind).select(evaluation.contract_checks().alias("c")).first().c
    assert all(fine.values()) and len(fine) == 9
    bad = {**row, "actions": ["pay_requester"], "handoff_text": "secret", "explanation": "made up", "evidence_status": None}
    got = spark.createDataFrame([tuple(bad.values())], kind).select(evaluation.contract_checks().alias("c")).first().c
    assert [k for k, v in got.items() if v] == ["citation_provenance"]
    lost = spark.createDataFrame([("a", "message")], "k string, category string").join(spark.createDataFrame([], "k string, expected_category string"), "k", "left")
    lost = lost.withColumns({n: F.array().cast("array<string>") for n in ("levels", "required_flags", "flags", "actions_any", "actions")}).withColumn("level", F.lit("x"))
    assert lost.select(evaluation.challenge_checks()["category"]).first()[0] is False


def test_reference_checks(spark):
    kind = "status string, expected_status string, retrieved array<string>, cited array<string>, documents array<string>, explanation string, quote string, excerpt string, phrases array<string>"
    good = ("answered", "answered", ["a", "b"], ["a"], ["a"], "In the past, x. Today, y.", "In the past, x. Today, y.", "z In the past, x. Today, y.", ["TODAY"])
    none = ("uncertain_analysis", "uncertain_analysis", [], [], [], "", None, None, [])
    half = ("answered", "answered", ["b"], ["b"], ["a"], "In the past, x.", "In the past, x.", "other", ["no"])
    got = [r[0] for r in spark.createDataFrame([good, none, half], kind).select(evaluation.reference_checks()).collect()]
    assert all(got[0].values()) and all(got[1].values())
    assert sorted(k for k, v in got[2].items() if v) == ["explanation_is_exact_selected_evidence", "status_matches"]


def test_replay_tells_measures_and_changes(spark):
    kind = "id int, gold_category string, gold_signals array<string>, gold_issues array<string>, pred_category string, pred_signals array<string>, pred_issues array<string>, case_kind string, seconds double"
    before = spark.createDataFrame([(1, "message", ["a"], [], "alert", ["a"], [], "ordinary", 1.0), (2, "wifi", [], [], "wifi", [], [], "ordinary", 1.0)], kind)
    after = before.withColumn("pred_category", F.col("gold_category"))
    measures, changed = evaluation.replay(before, after, "id")
    assert {r.stage: r.category_correct for r in measures.collect()} == {"before": 1, "after": 2} and [r.id for r in changed.collect()] == [1]
    assert metrics.weighted_mean(spark.createDataFrame([("g", 1.0, 0.0)], "g string, v double, w double"), ["g"], "v", "w").first().weighted_mean is None


def test_displayed_sources_and_view(spark):
    kind = "k long, position int, document string, url string"
    got = policy.displayed_sources(spark.createDataFrame([(1, 1, "a", "u1")], kind), spark.createDataFrame([(1, 1, "a", "u2"), (1, 2, "b", "u3")], kind), "k")
    assert {(r.document, r.url, r.source_order) for r in got.collect()} == {("a", "u1", 0), ("b", "u3", 1)}
    shown = policy.displayable(F.lit("answered"), F.lit("gift_payment"), F.lit("x gift card pay"), F.array(F.lit("x gift card pay")), F.array(F.lit("a x gift card pay b")))
    risky = policy.displayable(F.lit("answered"), F.lit(None).cast("string"), F.lit("install it"), F.array(F.lit("install it")), F.array(F.lit("install it")))
    odd = policy.displayable(F.lit("answered"), F.lit("popup"), F.lit("x gift card pay"), F.array(F.lit("x gift card pay")), F.array(F.lit("a x gift card pay b")))
    assert list(spark.range(1).select(shown, risky, odd).first()) == ["x gift card pay", "", ""]
