"""Which topic an input is about, and whether a reference sentence may explain it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.cues import SENSITIVE
from corvane.functions.text import words

# States of a connection in the order in which they decide the topic.
STATE_TOPICS = ("no_internet", "unsecured_network", "wifi_password_prompt", "wifi_off", "wifi_connected")
# For each topic, its sentences' scores: (score, must match, must also match, must not match, words at least).
REJECTED = r"\b(?:reset|erase|forget|disable|usually safe|generally safe)\b|airplane mode is off|is a scammer"
PRIZES = r"lottery|sweepstakes|won money"
PRIZE_QUERY = r"(?i)lottery|sweepstakes|prize|won"
SENTENCE_RULES = {
    "secrets": [(4, r"password|personal information|verification code", r"steal|trick|do not share|never share|ask for your", r"billing|multi.factor|authentication makes|scan of your", 0)],
    "gift_payment": [(4, r"gift card", r"pay|money|number", None, 0)],
    "payment": [(3, r"\bpay\b|\bfee\b|\bpayment\b", r"scam|pressure|insist|impersonat", r"gift card|lottery|remote access", 12)],
    "remote_support": [(4, r"remote access", r"scam|impersonat", None, 0)],
    "popup": [(4, r"pop.?up|webpage|phone number", r"not proof|scam|never|do not|don't|warning", None, 0)],
    "no_internet": [(5, r"no internet connection", r"another device", None, 0)],
    "wifi_off": [(5, r"wi-fi is on|turn wi-fi on", None, None, 0)],
    "wifi_password_prompt": [(5, r"password", r"owner|administrator|recognize", None, 0)],
    "unsecured_network": [(6, r"https", r"address bar", None, 0), (2, r"encryption", r"website", r"devices", 0)],
    "wifi_connected": [(4, r"joining a network and having working internet|blue checkmark", None, None, 0)],
    "wifi_general": [(4, r"joining a network and having working internet|blue checkmark", None, None, 0)],
    "verify_source": [(3, r"contact the company|website you know|phone number.*know.*real", None, None, 0)],
}


def has(text: Column, pattern: str) -> Column:
    return text.rlike("(?U)" + pattern)


def topic_score(name: str, s: Column) -> Column:
    """What a sentence (in lower case) is worth for one topic."""
    score = F.lit(0)
    for points, must, also, never, least in reversed(SENTENCE_RULES[name]):
        fits = has(s, must)
        if also:
            fits &= has(s, also)
        if never:
            fits &= ~has(s, never)
        if least:
            fits &= F.size(F.filter(F.split(s, r"(?U)\s+", -1), lambda w: w != "")) >= least
        score = F.when(fits, points).otherwise(score)
    return score


def sentence_scores(sentence: Column) -> Column:
    """struct<scores, prizes>: a sentence's score for each topic, whatever the query, and whether it is about prizes."""
    s = F.lower(sentence)
    scores = F.create_map(*[x for name in SENTENCE_RULES for x in (F.lit(name), F.when(has(s, REJECTED), 0).otherwise(topic_score(name, s)).cast("int"))])
    return F.struct(scores.alias("scores"), has(s, PRIZES).alias("prizes"))


def about_prizes(query: Column | None) -> Column:
    return F.lit(False) if query is None else has(query, PRIZE_QUERY)


def scored_for(known: Column, topic: Column, of_prizes: Column) -> Column:
    """0 (not to be shown) to 6, from ``sentence_scores`` and whether the query is about prizes; sentences about prizes only answer such queries."""
    return F.when(known["prizes"] & ~of_prizes, 0).otherwise(F.coalesce(known["scores"][topic], F.lit(0))).cast("int")


def relevance_score(topic: Column, sentence: Column, query: Column | None = None) -> Column:
    """0 (not to be shown) to 6: what ``scored_for`` says of ``sentence_scores``, but only the rules of the topic at hand are tried, and whether the sentence is rejected only where they fit.

    The sentence in lower case and its points are elements of arrays here, so each is computed once.
    """
    of_prizes = about_prizes(query)

    def points(s: Column) -> Column:
        score = F.lit(0)
        for name in SENTENCE_RULES:
            score = F.when(topic == name, topic_score(name, s)).otherwise(score)
        return score

    def shown(s: Column, p: Column) -> Column:
        return F.when(p == 0, 0).when(has(s, REJECTED), 0).when(has(s, PRIZES) & ~of_prizes, 0).otherwise(p)

    once = lambda value, of: F.transform(F.array(value), of)[0]
    return once(F.lower(sentence), lambda s: once(points(s), lambda p: shown(s, p))).cast("int")


def explanation_topic(category: Column, signals: Column, facts: Column) -> Column:
    """The topic of an observation (names of its signals) and the facts of its text; ``none`` if nothing fits."""
    names = F.array_union(signals, F.transform(facts["cues"], lambda c: c["signal"]))
    sensitive = F.arrays_overlap(names, words(*SENSITIVE))
    name = lambda x: F.array_contains(names, x)
    only_link = (F.size(names) == 1) & name("visible_link") & ~facts["link_matters"]
    notice = (facts["code_notice"] | facts["settings_update"]) & ~sensitive
    topic = F.when(only_link | notice, "none").when(name("credential_request") | name("verification_code_request"), "secrets")
    topic = topic.when(name("payment_request"), F.when(facts["gift_card"], "gift_payment").otherwise("payment"))
    topic = topic.when(name("remote_access_request"), "remote_support")
    for state in STATE_TOPICS:
        topic = topic.when((category == "wifi") & name(state), state)
    return topic.when(category == "wifi", "wifi_general").when((category == "alert") & (F.size(names) > 0), "popup").when(F.size(names) > 0, "verify_source").otherwise("none")
