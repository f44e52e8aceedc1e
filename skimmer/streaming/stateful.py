"""Streams with state of their own: counts that take back what changed, and a memory that forgets.

Both keep one small value for each key in the state store, so they need the RocksDB provider (``with_state``), and read a key's rows one by one. All rows of a
key in a micro-batch go to one task; how many come at once is the source's admission (``maxFilesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB; other streams of the session stay as they are."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _LastStatus(StatefulProcessor):
    """Of each key the latest (us, event_id, status); a change of status is told as -1 of the old one and +1 of the new one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long, event_id long, status int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.last.get()  # each call to the state is a way to the JVM and back
        best = before
        for row in rows:  # one that is late or comes again is not later than what is known
            if best is None or (row["us"], row["event_id"]) > (best[0], best[1]):
                best = (row["us"], row["event_id"], row["status"])
        if best is before:
            return
        self.last.update(best)
        if before is None or before[2] != best[2]:
            if before is not None:
                yield Row(status=before[2], change=-1)
            yield Row(status=best[2], change=1)

    def close(self) -> None:
        pass


def status_changes(changes: DataFrame, key: str = "article") -> DataFrame:
    """(status, change) from a stream of (key, event_id, ts, status): sums of ``change`` by status are how many keys have that status now.

    Latest is meant by ts, then event_id; rows that come late, twice or in any order give the same sums. Rows with a null key, ts, event_id or status are left out.
    """
    rows = changes.dropna(subset=[key, "ts", "event_id", "status"]).select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", F.col("status").cast("int").alias("status"))
    return rows.groupBy(key).transformWithState(_LastStatus(), "status int, change int", "append", "none")


def counts_of(told: DataFrame) -> DataFrame:
    """(status, n) from what ``status_changes`` has told so far."""
    return told.groupBy("status").agg(F.sum("change").alias("n")).where("n <> 0")


class _Memory(StatefulProcessor):
    """Of each key (first, last, n) until ``keep`` microseconds of event time after its last row, then told and forgotten."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = stored = self.seen.get()  # each call to the state is a way to the JVM and back
        for us in sorted(row["us"] for row in rows):
            if known and us > known[1] + self.keep:  # the watermark had not come by yet
                yield self._told(key, known)
                known = None
            first, last, n = known or (us, us, 0)
            known = (min(first, us), max(last, us), n + 1)
        before, now = stored and self._timer(stored), self._timer(known)
        if before != now:  # the timer of a key is that of what is stored of it
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(now)
        self.seen.update(known)

    def _timer(self, known) -> int:
        return -(-(known[1] + self.keep) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if (known := self.seen.get()) is not None:
            yield self._told(key, known)
            self.seen.clear()

    def _told(self, key, known) -> Row:
        return Row(key=key[0], first=known[0], last=known[1], n=known[2])

    def close(self) -> None:
        pass


def forgotten(rows: DataFrame, key: str, ts: str = "ts", days: float = 30, delay: str = "1 hour") -> DataFrame:
    """(key, first_ts, last_ts, n) of each key when nothing of it has come for ``days`` days of event time; then its state is gone, and it begins anew if it comes again.

    A key is told once the watermark (``delay`` behind the newest time) has passed its time, so the state holds the keys of that span only. Rows later than
    the watermark, and rows with a null key or time, are left out. The times of a key in one micro-batch are sorted in its task.
    """
    kind = rows.schema[key].dataType.simpleString()
    timed = rows.dropna(subset=[key, ts]).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).withWatermark("ts", delay)
    told = timed.groupBy("key").transformWithState(_Memory(int(days * 86_400_000_000)), f"key {kind}, first long, last long, n long", "append", "eventTime")
    return told.select(F.col("key").alias(key), F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"), "n")
