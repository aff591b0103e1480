"""A small reference corpus of our own, by which guidance and its sources are tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: doc_id, title, category, platform, source_type, tags, urls, text
DOCUMENTS = [
    ("message_phishing", "Phishing messages", "message", "any", "original_html", ["phishing", "password", "code", "link"], ["https://consumer.ftc.gov/phishing"],
     "Scammers send messages to trick you into giving them your password or a verification code, so never share them. If a company is named, use a phone number or site you know is real, not one from the message."),
    ("message_avoid_scam", "Avoiding a scam", "message", "any", "original_html", ["scam", "payment", "money", "gift", "card"], ["https://consumer.ftc.gov/scams"],
     "Honest companies don't pressure you to pay, and anyone who wants you to pay with a gift card or to send money at once is running a scam. A stranger who insists that you pay a fee before you get anything may be pulling you into a scam. Before you do anything else, talk to someone you trust."),
    ("message_remote", "Remote access", "message", "any", "original_html", ["remote", "support", "access"], ["https://consumer.ftc.gov/remote"],
     "People who ask for remote access to your device to fix a problem you didn't report are often impersonating a company in a scam."),
    ("popup_safari", "Popups in Safari", "popup", "any", "authored_summary", ["popup", "safari", "warning", "support"], ["https://support.apple.com/popups"],
     "A popup with a phone number is not proof of a problem with your iPhone. If it is unfamiliar, close the tab with the browser's own controls."),
    ("wifi_iphone", "Wi-Fi on iPhone", "wifi", "ios", "authored_summary", ["wifi", "connection", "airplane", "checkmark"], ["https://support.apple.com/wifi"],
     "If an iPhone does not connect, check in Settings that Wi-Fi is on. Joining a network and having working internet are two different things. For a no internet connection message, try the same network on another device. Also see whether Airplane Mode is on."),
    ("wifi_join_iphone", "Joining a network", "wifi", "ios", "authored_summary", ["join", "password", "network"], ["https://support.apple.com/join"],
     "Choose a network that you recognize, and ask the owner of the network for its password."),
    ("wifi_public_safety", "Public Wi-Fi", "wifi", "any", "original_html", ["public", "encryption", "https", "security"], ["https://consumer.ftc.gov/wifi"],
     "In the past, public networks were risky. Today, most sites use encryption, and you can look for https in the address bar of your browser."),
]
SCHEMA = "doc_id string, title string, category string, platform string, source_type string, tags array<string>, urls array<string>, text string"


def knowledge(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOCUMENTS, SCHEMA)
