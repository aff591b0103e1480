"""Sessions of the form on a stream: drafts over restarts, repeated, late and stale events, and expiry."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest

from corvane.streaming import session

START = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)


def event(session_id, event_id, minute, kind, text=None):
    return {"session_id": session_id, "event_id": event_id, "at": None if minute is None else (START + timedelta(minutes=minute)).isoformat(), "kind": kind, "text": text}


class Form:
    """A stream whose files are written batch by batch, and which starts anew from its checkpoint for each run."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        session.use_state_store(spark)
        (folder / "in").mkdir()

    def send(self, *events):
        self.n += 1
        path = self.folder / f"in/{self.n:03d}.json"
        path.write_text("".join(json.dumps(e) + "\n" for e in events))
        os.utime(path, (1e9 + self.n, 1e9 + self.n))  # files are read in the order of their times
        return self

    def run(self):
        found = session.sessions(session.read_events(self.spark, str(self.folder / "in"), 1))
        query = found.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        rows = self.spark.read.parquet(str(self.folder / "out")).collect()
        minute = lambda at: None if at is None else int((at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at).timestamp() - START.timestamp()) // 60
        return sorted(((r.session_id, r.event_id, minute(r.at), r.outcome, r.text) for r in rows), key=repr)


@pytest.fixture
def form(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield Form(spark, tmp_path)
    spark.conf.set(key, before)


def test_drafts_live_over_a_restart_and_repeated_events_count_once(form):
    form.send(event("a", 1, 0, "edit", "first"), event("a", 2, 1, "prefill", "an example"), event("b", 1, 1, "edit", "b's"), event("b", 2, 2, "reset"), event("c", 9, 0, "odd"), event(None, 1, 0, "edit"), event("c", 1, None, "edit"))
    assert form.run() == []
    form.send(event("a", 3, 2, "submit"), event("b", 3, 3, "submit"), event("a", 3, 2, "submit"))
    assert form.run() == [("a", 3, 2, "submitted", "an example"), ("b", 3, 3, "submitted", "")]
    form.send(event("a", 3, 2, "submit"), event("a", 5, 4, "submit"), event("a", 4, 3, "edit", "edited after"), event("b", 4, 5, "submit", "given at once"))
    assert form.run()[1:] == [("a", 5, 4, "submitted", "edited after"), ("b", 3, 3, "submitted", ""), ("b", 4, 5, "submitted", "given at once")]


def test_late_events_are_dropped_and_stale_ones_told(form):
    form.send(event("a", 1, 20, "edit", "now"), event("z", 1, 30, "edit", "ahead"))
    form.send(event("y", 1, 31, "edit", "ahead"))
    form.send(event("a", 2, 19, "edit", "too late"), event("a", 3, 25, "submit"), event("z", 2, 29, "edit", "stale"), event("z", 3, 32, "submit"))
    assert form.run() == [("a", 3, 25, "submitted", "now"), ("z", 2, 29, "stale", "stale"), ("z", 3, 32, "submitted", "ahead")]


def test_an_idle_session_expires_and_begins_anew(form):
    form.send(event("a", 1, 0, "edit", "unsent"), event("b", 1, 0, "submit", "sent"))
    form.send(event("c", 1, 60, "edit", "later"))
    form.send(event("c", 2, 61, "submit"))
    rows = form.run()
    assert ("a", None, 30, "expired", "unsent") in rows and ("b", None, 30, "expired", None) in rows and ("c", 2, 61, "submitted", "later") in rows
    form.send(event("a", 2, 62, "submit"))
    assert ("a", 2, 62, "submitted", "") in form.run()


def test_what_is_submitted_is_checked(spark):
    rows = [("a", 1, START, "submitted", "Please send me $5 today."), ("a", 2, START, "submitted", ""), ("a", None, START, "expired", "Send me $5")]
    got = session.checked(spark.createDataFrame(rows, session.OUT)).collect()
    assert sorted((r.event_id, r.rejected is not None, r.level) for r in got)[0] == (1, False, "attention") and len(got) == 2
