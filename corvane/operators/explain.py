"""From a text to a quoted explanation and guidance: a plan with a status column instead of exceptions.

Model steps are functions from DataFrame to DataFrame. The defaults are deterministic: the
observer reads a text's cues and words, the selector takes the best-ranked sentence. A model
plugs in with the same signature, for instance by ``mapInArrow`` with one load per worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.cues import CONNECTIVITY, facts
from corvane.functions.json_text import draft_outcome, parsed_draft
from corvane.functions.relevance import about_prizes, explanation_topic, scored_for, sentence_scores
from corvane.functions.segment import sentence_units
from corvane.functions.text import GENERIC_TERMS, passage_terms, reject_reason, search_terms, trusted_urls, without_fence, words
from corvane.operators.policy import guidance, handoff
from corvane.operators.retrieval import search_passages
from corvane.operators.review import review
from corvane.session import settled

Step = Callable[[DataFrame], DataFrame]
NO_NAMES = "array<string>"
NO_SIGNALS = "array<struct<signal:string,evidence:string>>"
# What a query is widened by for each signal.
EXPANSIONS = {
    "payment_request": "payment money scam", "credential_request": "account password phishing", "verification_code_request": "verification security code account",
    "urgent_security_warning": "security warning account", "support_phone_number": "support phone number", "visible_link": "website link", "install_request": "software install download",
    "remote_access_request": "remote access support", "wifi_off": "iPhone Wi-Fi off", "airplane_mode_on": "iPhone airplane mode", "wifi_connected": "iPhone Wi-Fi connected checkmark",
    "no_internet": "iPhone Wi-Fi no internet connection", "wifi_password_prompt": "iPhone join network password", "unsecured_network": "public Wi-Fi security encryption",
}
LIMIT, PER_DOCUMENT, OPTIONS = 18, 6, 3


def cue_observer(rows: DataFrame) -> DataFrame:
    """rows(text, facts) with the struct ``observed``: category by cues and words, signals by cues."""
    cues = F.col("facts.cues")
    state = F.exists(cues, lambda c: c["signal"].isin(*CONNECTIVITY))
    category = F.when(state, "wifi").when(F.col("facts.reported_alert") | F.col("facts.settings_update"), "alert").otherwise("message")
    signals = F.when(category == "wifi", cues).otherwise(F.filter(cues, lambda c: ~c["signal"].isin(*CONNECTIVITY)))
    return rows.withColumn("observed", F.struct(category.alias("category"), signals.alias("signals"), F.array().cast(NO_NAMES).alias("issues")))


def first_sentence(rows: DataFrame) -> DataFrame:
    """rows(source_id, options) with ``draft`` (the model's JSON text), choosing the first option."""
    draft = F.to_json(F.struct("source_id", F.lit(1).alias("sentence_id"), F.lit(False).alias("insufficient_evidence")))
    return rows.withColumn("draft", draft)


def expansion(signals):
    """The phrases of an observation's signals, in order."""
    phrase = lambda name: F.coalesce(*[F.when(name == k, v) for k, v in EXPANSIONS.items()], F.lit(""))
    return F.array_join(F.transform(signals, lambda s: phrase(s["signal"])), " ")


def search_category(category):
    """The category of documents that an observation's category is searched in."""
    return F.when(category == "alert", "popup").otherwise(category)


def observed(inputs: DataFrame, observer: Step = cue_observer) -> DataFrame:
    """inputs(input_id, text) with facts, the reviewed observation, notes and rejection."""
    accepted = inputs.withColumn("rejected", reject_reason(F.col("text")))
    seen = observer(accepted.withColumn("facts", facts(F.col("text"))))
    generation = F.col("generation") if "generation" in seen.columns else F.lit(None).cast("string")
    looked = seen.withColumn("_r", review(F.col("text"), F.col("observed"), generation, F.col("facts")))
    return looked.withColumns({"category": F.col("_r.category"), "signals": F.col("_r.signals"), "issues": F.col("_r.issues"), "notes": F.col("_r.notes")}).drop("_r")


def sentence_table(passages: DataFrame) -> DataFrame:
    """passage_id, excerpt and units of every passage: its sentence units with their terms and their scores for each topic, whatever is asked."""
    unit = lambda u: F.struct(u.alias("unit"), F.array_distinct(passage_terms(u)).alias("terms"), sentence_scores(u).alias("known"))
    return passages.select("passage_id", F.col("text").alias("excerpt"), sentence_units()(F.col("text")).alias("found")).select("passage_id", "excerpt", F.transform("found", unit).alias("units"))


def shared_weight(terms, wanted):
    """How much of a query's terms a unit has, generic ones counted a fifth."""
    both = F.array_intersect(terms, wanted)
    generic = F.size(F.array_intersect(both, words(*GENERIC_TERMS)))
    return (F.size(both) - generic) * 10 + generic * 2


def best_units(units, wanted, topic, of_prizes):
    """At most OPTIONS units (order, at, unit) that may explain the topic: by relevance, then by shared terms, then in order."""
    rated = F.transform(
        units, lambda u, i: F.struct((-scored_for(u["known"], topic, of_prizes)).alias("order"), (-shared_weight(u["terms"], wanted)).alias("share"), i.alias("at"), u["unit"].alias("unit"))
    )
    return F.slice(F.array_sort(F.filter(rated, lambda x: x["order"] < 0)), 1, OPTIONS)


def alike(asked: DataFrame, documents: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id and ``same_as``: the first query that gets the same passages and sentences for certain.

    A search and the rating of sentences see of a query only the words that the corpus has, its
    expansion, category and topic, and whether it names a platform or is about prizes. Queries that
    agree in these are searched once.
    """
    marked = lambda mark, terms: F.transform(terms, lambda t: F.concat(F.lit(mark), t))
    corpus = documents.select(F.explode(marked("s:", F.concat(*[search_terms(x) for x in (F.col("title"), F.array_join("tags", " "), F.col("text"))]))).alias("term"))
    corpus = corpus.unionByName(passages.select(F.explode(marked("p:", passage_terms(F.col("text")))).alias("term"))).distinct()
    each = asked.select("query_id", F.explode(F.concat(marked("s:", search_terms(F.col("query"))), marked("p:", F.array_distinct(passage_terms(F.col("query")))))).alias("term"))
    known = each.join(corpus, "term", "left_semi").groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("known"))  # a query's own terms
    named = F.arrays_overlap(search_terms(F.col("query")), words("apple", "icloud"))
    seen = F.struct(F.coalesce("known", F.array().cast(NO_NAMES)).alias("known"), "expansion", "category", "topic", F.coalesce(named, F.lit(False)).alias("named"), F.coalesce(about_prizes(F.col("query")), F.lit(False)).alias("prizes"))
    keyed = settled(asked.join(known, "query_id", "left").select("query_id", F.sha2(F.to_json(seen), 256).alias("key")))
    first = keyed.groupBy(F.col("key").alias("same_key")).agg(F.min("query_id").alias("same_as")).select(F.concat("same_key", F.lit("")).alias("same_key"), "same_as")  # dealt anew
    return keyed.join(first.hint("merge"), F.col("key") == F.col("same_key")).select("query_id", "same_as")


def explain(inputs: DataFrame, documents: DataFrame, passages: DataFrame, observer: Step = cue_observer, selector: Step = first_sentence) -> DataFrame:
    """Every input with status, topic, explanation, quoted source and observation.

    documents(doc_id, title, category, platform, tags, urls, source_type, text);
    passages(doc_id, passage_id, text). Only inputs that pass a gate go on to the next step. A
    selector gives ``draft``, and may give ``complete``: no draft is generation_unavailable, one
    that isn't complete incomplete_generation.
    """
    seen = settled(observed(inputs, observer))  # Python looks at each text once
    seen = seen.withColumn("topic", explanation_topic(F.col("category"), F.transform("signals", lambda s: s["signal"]), F.col("facts")))
    clear = seen.where(F.col("rejected").isNull() & (F.col("category") != "unknown") & (F.size("issues") == 0))
    asked = clear.select(
        F.col("input_id").alias("query_id"), F.col("text").alias("query"), expansion(F.col("signals")).alias("expansion"),
        search_category(F.col("category")).alias("category"), "topic",
    )
    members = settled(alike(asked, documents, passages))
    few = settled(asked.join(members.where("query_id = same_as").select("query_id"), "query_id", "left_semi"))
    hits = search_passages(few.drop("topic"), documents, passages, LIMIT, PER_DOCUMENT)
    sources = documents.select("doc_id", "urls", trusted_urls(F.col("urls")).alias("trusted"))
    of_members = lambda found: members.join(found.withColumnRenamed("query_id", "same_as"), "same_as").drop("same_as")
    retrieved = of_members(hits.join(sources, "doc_id").groupBy("query_id").agg(F.bool_and("trusted").alias("all_trusted")))
    wanted = few.select("query_id", F.array_distinct(passage_terms(F.col("query"))).alias("wanted"), about_prizes(F.col("query")).alias("of_prizes"), "topic").where("topic <> 'none'")
    scored = hits.join(wanted, "query_id").join(sentence_table(passages), "passage_id")
    best = best_units(F.col("units"), F.col("wanted"), F.col("topic"), F.col("of_prizes"))
    offered = scored.select("query_id", "doc_id", "passage_id", "excerpt", "rank", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("source_id"), best.alias("best")).where(F.size("best") > 0)
    first = Window.partitionBy("query_id").orderBy(F.col("best")[0]["order"], "rank")
    one = offered.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("options", F.transform("best", lambda x: x["unit"])).drop("_n", "best", "rank")
    one = of_members(one)  # from here on each input goes its own way: a selector may be a model
    drafted = selector(one).withColumn("parsed", parsed_draft(without_fence(F.col("draft"))))
    complete = F.coalesce(F.col("complete"), F.lit(False)) if "complete" in drafted.columns else F.lit(True)
    outcome = F.when(F.col("draft").isNull(), "generation_unavailable").when(~complete, "incomplete_generation").otherwise(draft_outcome(F.col("parsed"), F.col("source_id"), F.col("options")))
    judged = drafted.withColumn("outcome", outcome)
    answers = judged.select("query_id", "outcome", F.col("doc_id").alias("cited_document"), "excerpt", F.when(F.col("outcome") == "answered", F.element_at("options", F.col("parsed.sentence_id").cast("int"))).alias("quote"))
    both = seen.join(retrieved.withColumnRenamed("query_id", "input_id"), "input_id", "left").join(answers.withColumnRenamed("query_id", "input_id"), "input_id", "left")
    status = (
        F.when(F.col("rejected").isNotNull(), "rejected_input")
        .when((F.col("category") == "unknown") | (F.size("issues") > 0), "uncertain_analysis")
        .when(~F.coalesce("all_trusted", F.lit(True)), "knowledge_unavailable")
        .otherwise(F.coalesce("outcome", F.lit("insufficient_evidence")))
    )
    answered = status == "answered"
    return both.withColumn("status", status).select(
        "input_id", "text", "category", "signals", "issues", "notes", "facts", "topic", "status",
        F.when(answered, F.col("quote")).otherwise("").alias("explanation"), F.when(answered, F.col("cited_document")).alias("cited_document"), F.when(answered, F.col("excerpt")).alias("excerpt"),
    )


def guide(inputs: DataFrame, documents: DataFrame, passages: DataFrame, observer: Step = cue_observer, selector: Step = first_sentence) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(explanations, guidance, handoffs) of inputs(input_id, text)."""
    explained = explain(inputs, documents, passages, observer, selector)
    guided = guidance(explained, "input_id", documents)
    return explained, guided, handoff(guided, "input_id", documents)
