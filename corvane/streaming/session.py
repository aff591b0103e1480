"""Sessions of an input form as a stream: drafts, examples that are put in, starting over, and what is submitted.

Each session has a state: its draft and when it last changed. Events are applied in the order of
their times (then ids) within a batch; ``edit`` and ``prefill`` replace the draft, ``reset`` empties
it, ``submit`` hands it on (with a text, that is the draft first). The draft stays after a submission,
as the form's does, and an example or a reset leaves nothing of an earlier check.

An event whose id was seen within the watermark's delay is dropped, and so is one that is older
than the watermark. One that is older than its session's last event is told as ``stale`` and
changes nothing. A session without events for ``idle`` ends by a timer: its state goes and
``expired`` is told with what was not submitted. So states are as many as sessions of the last while.

Rows of other kinds, and those without a session or a time, are left out. The state store must be
RocksDB (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.streaming.guard import levels

EVENTS = "session_id string, event_id long, at timestamp, kind string, text string"
KINDS = ("edit", "prefill", "reset", "submit")
OUT = "session_id string, event_id long, at timestamp, outcome string, text string"
#: Times are whole microseconds in the state and in Python, whatever the time zones of workers.
_OUT = "session_id string, event_id long, micros long, outcome string, text string"
LATE, IDLE = "10 minutes", timedelta(minutes=30)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class FormSession(StatefulProcessor):
    """One session's draft between its events."""

    def __init__(self, idle: timedelta):
        self.idle = idle // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.draft = handle.getValueState("draft", "text string, last long, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.draft.get() if self.draft.exists() else ("", None, False)
        text, last, unsent = held[0], held[1], held[2]
        for row in sorted(rows, key=lambda r: (r.micros, r.event_id is None, r.event_id or 0)):
            if last is not None and row.micros < last:
                yield Row(session_id=key[0], event_id=row.event_id, micros=row.micros, outcome="stale", text=row.text)
                continue
            last = row.micros
            if row.kind == "reset":
                text, unsent = "", False
            elif row.kind != "submit" or row.text is not None:
                text, unsent = row.text or "", True
            if row.kind == "submit":
                unsent = False
                yield Row(session_id=key[0], event_id=row.event_id, micros=row.micros, outcome="submitted", text=text)
        if last is not None:
            self.draft.update((text, last, unsent))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.idle) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        text, last, unsent = self.draft.get()
        self.draft.clear()
        yield Row(session_id=key[0], event_id=None, micros=last + self.idle, outcome="expired", text=text if unsent else None)

    def close(self) -> None:
        pass


def read_events(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """Events of JSON files, in the order in which the files appear."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).json(folder)


def sessions(events: DataFrame, late: str = LATE, idle: timedelta = IDLE) -> DataFrame:
    """session_id, event_id, at, outcome (submitted, stale, expired) and text of a stream of events."""
    known = events.where(F.col("kind").isin(*KINDS) & F.col("session_id").isNotNull() & F.col("at").isNotNull())
    once = known.withWatermark("at", late).dropDuplicatesWithinWatermark(["session_id", "event_id"])
    timed = once.withColumn("micros", F.unix_micros("at"))
    found = timed.groupBy("session_id").transformWithState(FormSession(idle), _OUT, "Append", "EventTime")
    return found.select("session_id", "event_id", F.timestamp_micros("micros").alias("at"), "outcome", "text")


def checked(outcomes: DataFrame) -> DataFrame:
    """session_id, event_id, at, and the levels of what was submitted (``guard.levels``)."""
    sent = outcomes.where("outcome = 'submitted'")
    seen = levels(sent.select(F.struct("session_id", "event_id", "at").alias("input_id"), "text"))
    return seen.select("input_id.*", *[c for c in seen.columns if c != "input_id"])
