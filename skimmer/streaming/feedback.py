"""The same feedback and ingestion steps as streams. Each is a transformation of a streaming frame plus a way to run it until what is there is done."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from skimmer.operators.store import new_rows

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def drained(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Runs a stream over all that is there, and stops: what a scheduler starts every hour."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def due(last_run: Column, today: Column) -> Column:
    """Whether the day's work is still to be done: never done, or done on another day."""
    return F.coalesce(last_run != today, F.lit(True))


def batch_due(settings: Column, last_run: Column, today: Column) -> Column:
    """Whether the day's batch is to be made without being asked for: the flag and the first set-up are 'true', and the day's work is still to be done."""
    on = lambda key: F.coalesce(settings[key] == "true", F.lit(False))
    return on("auto_batch") & on("initialized") & due(last_run, today)


class Progress(StreamingQueryListener):
    """Keeps what streams of this session report: (name, batch, rows, state), the newest ``most``."""

    def __init__(self, most: int = 1000):
        self.events: deque[tuple[str, int, int, str]] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        self.events.append((event.name or str(event.id), -1, 0, "started"))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.events.append((p.name or str(p.id), p.batchId, p.numInputRows, "running"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.events.append((str(event.id), -1, 0, "failed" if event.exception else "done"))


def latest_status(changes: DataFrame, key: str = "article") -> DataFrame:
    """(key, status, event_id, ts) for each key whenever changes of it come, in update mode: an aggregate whose state is one row for each key.

    Latest is meant by ts, then event_id. A change that comes late and is older than the latest gives the latest once more.
    """

    best = F.max(F.struct("ts", "event_id", "status")).alias("best")
    return changes.groupBy(key).agg(best).select(key, "best.status", "best.event_id", "best.ts")


def first_seen(rows: DataFrame, key: str = "id", ts: str = "ts", delay: str = "30 days") -> DataFrame:
    """Each key once within the watermark; the state forgets keys after ``delay``."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def add_new(spark: SparkSession, path: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends to the table at ``path`` what it does not have yet."""

    def sink(batch: DataFrame, _: int) -> None:
        stored = spark.read.schema(batch.schema).parquet(path)
        new_rows(batch, stored, order, required=()).write.mode("append").parquet(path)

    return sink


def hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Number and sum of values by kind and hour; an hour is given out once, when the watermark has passed it."""
    windowed = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windowed.select(F.col("w.start").alias("hour"), "event_type", "n", "total")
