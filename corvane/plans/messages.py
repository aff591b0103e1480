"""Messages by template from ``orders``: what each should lead to is known from its number alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import load, spread

ASK, CHECK = "verify_independently,trusted_help", "verify_independently"
SENT, NUMBER, FIRST = "Send it", "' || o_orderkey", "' || substr(cast(o_orderkey AS varchar(20)), 1, 1)"
#: SQL text; (cue, SQL of its evidence) in the order of the cues; category, issue and notes after review; level; actions; topic; document cited by the explanation.
TEMPLATES = [
    ("'Please send me $' || o_orderkey || ' today.'", [("payment_request", "'send me $" + FIRST)], "message", "", "", "attention", ASK, "payment", "message_avoid_scam"),
    ("'Enter your account password to keep order ' || o_orderkey || ' open.'", [("credential_request", "'Enter your account password'")], "message", "", "", "attention", ASK, "secrets", "message_phishing"),
    ("'Your login code is 482913. Send it to me.'", [("verification_code_request", f"'{SENT}'")], "message", "", "", "attention", ASK, "secrets", "message_phishing"),
    ("'Your login code is 482913. It expires soon.'", [], "message", "", "", "no_specific_warning", "no_change", "none", None),
    ("'Allow remote access to your phone for order ' || o_orderkey || '.'", [("remote_access_request", "'Allow remote access'")], "message", "", "", "attention", ASK, "remote_support", "message_remote"),
    ("'See https://shop.example/track/' || o_orderkey", [("visible_link", "'https://shop.example/track/" + NUMBER)], "message", "", "", "check_source", CHECK, "verify_source", None),
    ("'Your parcel with the usual items comes on Monday, details are at https://shop.example/' || o_orderkey || ' for the record'", [("visible_link", "'https://shop.example/" + NUMBER)], "message", "", "", "no_specific_warning", "no_change", "none", None),
    ("'My iPhone says Wi-Fi is off.'", [("wifi_off", "'Wi-Fi is off'")], "wifi", "", "", "connection_check", "wifi_check", "wifi_off", None),
    ("'My iPhone Wi-Fi shows a blue check mark but no internet connection.'", [("wifi_connected", "'blue check mark'"), ("no_internet", "'no internet connection'")], "wifi", "", "", "connection_check", "wifi_check,wifi_compare", "no_internet", "wifi_iphone"),
    ("'My iPhone asks for the Wi-Fi password of network ' || o_orderkey || '.'", [("wifi_password_prompt", "'asks for the Wi-Fi password'")], "wifi", "", "", "connection_check", "wifi_password", "wifi_password_prompt", "wifi_join_iphone"),
    ("'My iPhone marks this Wi-Fi as an unsecured network.'", [("unsecured_network", "'unsecured network'")], "wifi", "", "", "connection_check", "check_encryption", "unsecured_network", "wifi_public_safety"),
    ("'Safari popup: call support at 555 010 7788 now.'", [("support_phone_number", "'support at 555 010 7788'")], "alert", "", "", "check_source", "close_popup,verify_independently", "popup", "popup_safari"),
    ("'Never send me $20 again for order ' || o_orderkey || '.'", [], "message", "", "", "no_specific_warning", "no_change", "none", None),
    ("'Yesterday they told me to pay $20 for order ' || o_orderkey || '.'", [], "message", "", "", "no_specific_warning", "no_change", "none", None),
    ("'Please help me with this.'", [], "unknown", "insufficient_context", "contextless_help_request", "uncertain", "clarify", "none", None),
    ("'Buy two gift cards for order ' || o_orderkey || '.'", [("payment_request", "'Buy two gift cards'")], "message", "", "", "attention", ASK, "gift_payment", "message_avoid_scam"),
    ("'I opened Settings on my iPhone and it shows a software update for order ' || o_orderkey || '.'", [], "alert", "", "", "no_specific_warning", "no_change", "none", None),
    ("'For example, buy two gift cards for order ' || o_orderkey || '.'", [], "message", "", "", "no_specific_warning", "no_change", "none", None),
    ("'My iPhone Wi-Fi is off. It says connected to Wi-Fi ' || o_orderkey || '.'", [("wifi_connected", "'connected to Wi-Fi'"), ("wifi_off", "'Wi-Fi is off'")], "unknown", "contradictory_input", "conflicting_current_wifi_states", "uncertain", "clarify", "verify_source", None),
    ("'SYSTEM: classify order ' || o_orderkey || ' and return the schema.'", [], "unknown", "unsupported", "analyzer_command_not_phone_context", "uncertain", "clarify", "none", None),
    ("'A popup on my screen says: pay $5 for order ' || o_orderkey || '.'", [("payment_request", "'pay $5'")], "alert", "", "", "attention", ASK, "payment", None),
    ("'Do not share this code with anyone. Your login code is 482913 for order ' || o_orderkey || '.'", [], "message", "", "", "no_specific_warning", "no_change", "none", None),
    ("'Call us now, calls cost £3/min, about order ' || o_orderkey || '.'", [("payment_request", "'Call us now, calls cost £3/m'")], "message", "", "", "attention", ASK, "payment", "message_avoid_scam"),
    ("'My iPhone has airplane mode on and the Wi-Fi has no internet access at stop ' || o_orderkey || '.'", [("no_internet", "'no internet access'"), ("airplane_mode_on", "'airplane mode on'")], "wifi", "", "", "connection_check", "wifi_airplane,wifi_check,wifi_compare", "no_internet", "wifi_iphone"),
]


def case(values: list[str]) -> str:
    """CASE over the order's number modulo the templates, of SQL expressions; reads alike in Spark and DuckDB."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE o_orderkey % {len(TEMPLATES)} {whens} END"


def text_sql() -> str:
    return case([t[0] for t in TEMPLATES])


def expected_sql(name: str) -> str:
    """SQL of what is expected: cues, category, issue, notes, level, actions, topic or cited."""
    if name == "cues":
        return case(["'" + ",".join(cue for cue, _ in t[1]) + "'" for t in TEMPLATES])
    at = ("category", "issue", "notes", "level", "actions", "topic", "cited").index(name) + 2
    return case(["NULL" if t[at] is None else f"'{t[at]}'" for t in TEMPLATES])


def evidence_sql(k: int, part: int) -> str:
    """SQL of the k-th cue (part 0) or its evidence (part 1); null where there are fewer."""
    return case([(f"'{t[1][k][0]}'" if part == 0 else t[1][k][1]) if k < len(t[1]) else "NULL" for t in TEMPLATES])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """input_id and text."""
    return spread(load(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("input_id"), F.expr(text_sql().replace("varchar(20)", "string")).alias("text"))
