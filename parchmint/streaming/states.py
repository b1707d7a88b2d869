"""Files of a growing queue as state kept from batch to batch: their statuses, and the cap of a session.

Both operators give the same records however the input is cut into batches, and go on from the
checkpoint after a restart. They need the state store that keeps timers; ``timed_store``
chooses it for the queries that are started inside.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parchmint.options import TIMED_OUT, Limits

#: Statuses of work that a cancellation or the time limit ends.
RUNNING = ("converting", "ocr")
WORKING = (*RUNNING, "docx")
#: What an event does to a file: the statuses it is legal in, and the status that follows.
TRANSITIONS: dict[str, tuple[tuple[str | None, ...], str]] = {
    "add": ((None,), "queued"),
    "too-large": ((None,), "size-exceeded"),
    "start": (("queued",), "converting"),
    "recognise": (("converting",), "ocr"),
    "read-docx": (("converting",), "docx"),
    "complete": (WORKING, "complete"),
    "no-text": (WORKING, "no-text"),
    "fail": (WORKING, "failed"),
    "encrypted": (WORKING, "encrypted"),
    "too-many-pages": (WORKING, "page-exceeded"),
    "invalid-format": (WORKING, "invalid-format"),
    "invalid-pdf": (WORKING, "invalid-pdf"),
    "invalid-docx": (WORKING, "invalid-docx"),
    "requeue": (("no-text",), "queued"),
}
RECORDS = "id string, n int, at_ms long, status string, progress int, error string"
_RECORD, _TAKEN = Row("id", "n", "at_ms", "status", "progress", "error"), Row("session", "path", "file_ord")
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state where timers and several values can be held."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def step(status: str | None, since: int, event: Row, limit_ms: int) -> tuple[list[tuple], str | None, int]:
    """The records of an event on a file, its new status (None: no such file) and when its work began.

    Work that is over its time has failed before the event is looked at, so when the timer itself runs
    does not matter. Illegal events change nothing and leave no record.
    """
    out: list[tuple] = []
    at, name = event["at_ms"], event["event"]
    if status in RUNNING and at >= since + limit_ms:
        out.append((since + limit_ms, "failed", None, TIMED_OUT))
        status = "failed"
    if name == "cancel" and status in RUNNING:
        out.append((at, "cancelled", None, None))
        return out, "cancelled", since
    if name == "cancel" and status is not None:
        out.append((at, "removed", None, None))
        return out, None, 0
    if name == "page" and status in RUNNING and event["pages"]:
        out.append((at, status, int(event["page"] / event["pages"] * 90 + 0.5), None))
        return out, status, since
    legal, then = TRANSITIONS.get(name, ((), ""))
    if status not in legal or (status is None and None not in legal):
        return out, status, since
    progress = 0 if then == "converting" else 100 if then in ("complete", "no-text") else None
    out.append((at, then, progress, event["error"] if then == "failed" else None))
    return out, then, at if then == "converting" else since


class FileStates(StatefulProcessor):
    """One file: its status (null once removed), when its work began, how many records it has, and a timer for the end of its time."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", "status string, since long, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        status, since, n = held if held else (None, 0, 0)
        timer = since + self.limit_ms if status in RUNNING else None
        for event in sorted(rows, key=lambda r: (r["at_ms"], r["seq"])):
            records, status, since = step(status, since, event, self.limit_ms)
            for record in records:
                n += 1
                yield _RECORD(key[0], n, *record)
        now = since + self.limit_ms if status in RUNNING else None
        if timer != now:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if now is not None:
                self.handle.registerTimer(now)
        if n:
            self.state.update((status, since, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        at = expiredTimerInfo.getExpiryTimeInMs()
        if held and held[0] in RUNNING and held[1] + self.limit_ms <= at:
            self.state.update(("failed", held[1], held[2] + 1))
            yield _RECORD(key[0], held[2] + 1, held[1] + self.limit_ms, "failed", None, TIMED_OUT)

    def close(self) -> None:
        pass


def file_states(events: DataFrame, limits: Limits = Limits(), late: str = "0 seconds") -> DataFrame:
    """Records (id, n, at_ms, status, progress, error) of every legal change of a file's state; n counts those of a file.

    ``events`` is a stream (id string, at timestamp, seq long, event string, page int, pages int, error string).
    Events of a file are taken by time and seq; an event may be ``late`` after others of its file in an earlier
    batch. Events are those of ``TRANSITIONS``, ``page``, and ``cancel``, which ends running work and removes any other
    file. Work fails with the fixed message when its time is over, by the stream's own clock. Rows with a null id, time or event are left out.
    """
    known = events.where("id IS NOT NULL AND at IS NOT NULL AND event IS NOT NULL")
    kept = known.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", late).select("id", "at", "at_ms", "seq", "event", "page", "pages", "error")
    return kept.groupBy("id").transformWithState(FileStates(limits.max_conversion_ms), RECORDS, "append", "eventTime")


def final_states(records: DataFrame) -> DataFrame:
    """The last record of each file (id, at_ms, status, error); removed files are left out."""
    last = records.groupBy("id").agg(F.max_by(F.struct("at_ms", "status", "error"), "n").alias("r")).select("id", "r.*")
    return last.where("status <> 'removed'")


class SessionCap(StatefulProcessor):
    """One upload session: how many of its files were taken."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.taken.get()[0] if self.taken.exists() else 0
        # At most ``limit`` rows of a batch are held, however many there are.
        first = heapq.nsmallest(self.limit - n, rows, key=lambda r: (r["order"] is not None, r["order"] or 0, r["path"])) if n < self.limit else []
        for i, row in enumerate(first, n + 1):
            yield _TAKEN(key[0], row["path"], i)
        if first:
            self.taken.update((n + len(first),))

    def close(self) -> None:
        pass


def capped_stream(files: DataFrame, session: Column, order: Column, limits: Limits = Limits()) -> DataFrame:
    """Rows (session, path, file_ord) of the first ``max_files`` files of each session, in any batch.

    Files count in the order of the batches and, within one, of ``order`` and path. Where batches follow that order, the
    result is that of ``gates.capped`` over all files. A null session is one session; ``order`` is a number, and a null one comes first.
    """
    keyed = files.select(F.coalesce(session.cast("string"), F.lit("")).alias("session"), order.alias("order"), "path")
    return keyed.groupBy("session").transformWithState(SessionCap(limits.max_files), "session string, path string, file_ord int", "append", "none")
