"""Queries that run streams over the event table until what is there is done, and give the rows that they leave."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.operators.store import last_by
from skimmer.plans.registry import query
from skimmer.sources.tables import EVENT_ARTICLE_SQL, FEEDBACK_SQL, dealt_events, table
from skimmer.streaming import feedback as W
from skimmer.streaming import stateful as K


def _folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one that spark.checkpoint.dir names; on one machine without it, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream, whether it is one file or a folder of files."""
    return spark.readStream.schema(W.EVENTS).parquet(f"{d}/events*.parquet")


@query(f"""WITH {FEEDBACK_SQL}
SELECT {EVENT_ARTICLE_SQL} AS article, arg_max(status, (ts, event_id)) AS status FROM feedback GROUP BY 1""")
def feedback_stream_latest(spark: SparkSession, d: str) -> DataFrame:
    out = _folder(spark, "latest")
    changes = dealt_events(_events(spark, d), spark, d)
    # each batch's changes are a folder of its number, so that a batch that comes again writes over itself; the last of each article counts
    sink = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={k}")
    W.drained(W.latest_status(changes).writeStream.outputMode("update").foreachBatch(sink), f"{out}/checkpoint")
    rows = spark.read.parquet(f"{out}/rows")
    return last_by(rows, ["article"], F.col("ts"), F.col("event_id")).select("article", "status")


@query("SELECT DISTINCT user_id AS id FROM events WHERE user_id IS NOT NULL")
def ingest_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = _folder(spark, "ingest")
    rows = _events(spark, d).where("user_id IS NOT NULL").select(F.col("user_id").alias("id"), "ts")
    W.drained(W.first_seen(rows, delay="3650 days").select("id").writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows"), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events
GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def events_hourly_window(spark: SparkSession, d: str) -> DataFrame:
    """An addition of this engine: what the watermark has closed of hourly counts."""
    out = _folder(spark, "hourly")
    W.drained(W.hourly(_events(spark, d)).writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows"), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


def by_time(rows: DataFrame, n: int) -> list[Column]:
    """Conditions that deal ``rows`` into ``n`` spans of equal time, in order."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.coalesce(F.min(us), F.lit(0)), F.coalesce(F.max(us), F.lit(0))).first()
    return [F.floor((us - low) * n / (high - low + 1)) == k for k in range(n)]


def _fed(spark: SparkSession, rows: DataFrame, parts: list[Column], folder: str) -> DataFrame:
    """A stream of ``rows`` in as many micro-batches as ``parts``, conditions on them: one file each, written one after another."""
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(folder)


@query(f"""WITH {FEEDBACK_SQL}, latest AS (SELECT {EVENT_ARTICLE_SQL} AS article, arg_max(status, (ts, event_id)) AS status FROM feedback GROUP BY 1)
SELECT status, count(*) AS n FROM latest GROUP BY 1""")
def status_counts_stream(spark: SparkSession, d: str) -> DataFrame:
    """How many articles have each status, kept by taking back what changed: the events come in three batches without order, and a third of them comes again."""
    out = _folder(spark, "counts")
    rows = dealt_events(table(spark, d, "events"), spark, d)
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    stream = _fed(spark, rows, [third == 2, third == 0, third == 1, third == 0], f"{out}/in")
    with K.with_state(spark):
        W.drained(K.status_changes(stream).writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows"), f"{out}/checkpoint")
    return K.counts_of(spark.read.schema("status int, change int").parquet(f"{out}/rows"))


@query(f"""WITH {FEEDBACK_SQL}, e AS (SELECT {EVENT_ARTICLE_SQL} AS article, ts FROM feedback),
begun AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 3 DAY THEN 1 ELSE 0 END AS anew FROM e WINDOW w AS (PARTITION BY article ORDER BY ts)),
spans AS (SELECT *, sum(anew) OVER (PARTITION BY article ORDER BY ts ROWS UNBOUNDED PRECEDING) AS span FROM begun)
SELECT article, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n FROM spans GROUP BY article, span
HAVING max(ts) + INTERVAL 3 DAY < (SELECT max(ts) FROM e) - INTERVAL 1 HOUR OR span < (SELECT max(s.span) FROM spans s WHERE s.article = spans.article)""")
def feedback_forgotten(spark: SparkSession, d: str) -> DataFrame:
    """What a memory of three days gives out of the feedback of a month, in four batches by time."""
    out = _folder(spark, "forgotten")
    rows = dealt_events(table(spark, d, "events"), spark, d)
    stream = _fed(spark, rows, by_time(rows, 4), f"{out}/in")
    with K.with_state(spark):
        W.drained(K.forgotten(stream, "article", days=3).writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows"), f"{out}/checkpoint")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.schema("article long, first_ts timestamp, last_ts timestamp, n long").parquet(f"{out}/rows").select("article", shown("first_ts"), shown("last_ts"), "n")
