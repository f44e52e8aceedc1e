"""Queries over the article store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.functions import text as T
from skimmer.operators import store as S
from skimmer.plans.registry import query
from skimmer.sources.tables import AS_OF, ARTICLES_SQL, EVENT_ARTICLE_SQL, FEEDBACK_SQL, articles, dealt_events, table

A = f"WITH {ARTICLES_SQL}\n"


def _time(c: str = "timestamp"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(A + "SELECT status, count(*) AS n FROM articles GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.count_by_status(articles(spark, d))


@query(A + """SELECT count(*) FILTER (status = 0) AS unread, count(*) FILTER (status = 1) AS clicked, count(*) FILTER (status = 2) AS liked,
  count(*) FILTER (status = 3) AS skipped, count(*) FILTER (status = -1) AS disliked, count(*) FILTER (status = 2) >= 5 AS ready FROM articles""")
def stats_pivot(spark: SparkSession, d: str) -> DataFrame:
    return S.stats(articles(spark, d))


@query(A + "SELECT count(*) AS n FROM articles WHERE status = 2")
def liked_count(spark: SparkSession, d: str) -> DataFrame:
    return S.count_where(articles(spark, d), 2)


@query(A + "SELECT count(*) FILTER (status = 2) >= 5 AS by_count, false AS by_setting FROM articles")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    return S.stats(articles(spark, d)).select(F.col("ready").alias("by_count"), F.lit(False).alias("by_setting"))


@query(A + "SELECT id, title, status, score FROM articles WHERE status = 0 ORDER BY score DESC, id LIMIT 50")
def list_by_status(spark: SparkSession, d: str) -> DataFrame:
    return S.listing(articles(spark, d), 0).select("id", "title", "status", "score")


@query(A + "SELECT id, title, status, score FROM articles ORDER BY score DESC, id LIMIT 50 OFFSET 100")
def list_all_paged(spark: SparkSession, d: str) -> DataFrame:
    return S.listing(articles(spark, d), None, 50, 100).select("id", "title", "status", "score")


@query(A + "SELECT id, title, score, category FROM articles WHERE id = '7'")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).where("id = '7'").select("id", "title", "score", "category").limit(1)


@query(A + """SELECT id, status, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp FROM articles
  WHERE status IN (1, 2, -1) AND timestamp >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY""")
def recent_feedback(spark: SparkSession, d: str) -> DataFrame:
    return S.recent_feedback(articles(spark, d), AS_OF).select("id", "status", _time())


@query(A + "SELECT id, status FROM articles WHERE timestamp >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY")
def retention_keep(spark: SparkSession, d: str) -> DataFrame:
    return S.kept_since(articles(spark, d), AS_OF).select("id", "status")


@query(A + "SELECT count(*) AS n FROM articles WHERE timestamp < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY")
def retention_delete_count(spark: SparkSession, d: str) -> DataFrame:
    return S.dropped_before(articles(spark, d), AS_OF).agg(F.count("*").alias("n"))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored: ids that 3 does not divide; incoming: ids that 2 does not divide, each in two versions."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"), "source")
    stored = docs.where("doc_id % 3 <> 0").select("id", "title", "source")
    again = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("").alias("mark")), F.struct(F.lit(1).alias("k"), F.lit(" (again)").alias("mark")))).alias("v")
    new = docs.where("doc_id % 2 <> 0").select("doc_id", "id", "title", "source", again)
    return stored, new.select("id", F.concat("title", "v.mark").alias("title"), "source", (F.col("doc_id") * 2 + F.col("v.k")).alias("seq"))


_SPLIT_SQL = """WITH stored AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS title, source FROM documents WHERE doc_id % 3 <> 0),
incoming AS (SELECT CAST(doc_id AS VARCHAR) AS id, text || mark AS title, source, doc_id * 2 + k AS seq
  FROM documents, (VALUES (0, ''), (1, ' (again)')) v(k, mark) WHERE doc_id % 2 <> 0),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM incoming WHERE title IS NOT NULL AND source IS NOT NULL)
  WHERE r = 1 AND id NOT IN (SELECT id FROM stored))
"""


@query(_SPLIT_SQL + "SELECT id, title, source FROM stored UNION ALL SELECT id, title, source FROM fresh")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    stored, new = _split(spark, d)
    return S.insert_ignore(new, stored, "seq").select("id", "title", "source")


@query(_SPLIT_SQL + "SELECT count(*) AS n FROM fresh")
def insert_ignore_count(spark: SparkSession, d: str) -> DataFrame:
    stored, new = _split(spark, d)
    return S.new_rows(new, stored, "seq").agg(F.count("*").alias("n"))


@query(_SPLIT_SQL + "SELECT id, id IN (SELECT id FROM stored) AS known FROM (SELECT DISTINCT id FROM incoming)")
def new_vs_existing(spark: SparkSession, d: str) -> DataFrame:
    stored, new = _split(spark, d)
    ids = new.select("id").distinct()
    return ids.join(stored.select("id", F.lit(True).alias("known")), "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query(_SPLIT_SQL + "SELECT DISTINCT id FROM incoming WHERE id IN (SELECT id FROM stored)")
def existing_ids(spark: SparkSession, d: str) -> DataFrame:
    stored, new = _split(spark, d)
    return S.existing(new, stored)


def _scores(rows: DataFrame) -> DataFrame:
    """For the ids that 4 divides, and some that nothing is stored for, two scores each."""
    n = F.col("id").cast("long")
    two = rows.where(n % 4 == 0).select(F.when(n % 12 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), n.alias("n"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return two.select("id", ((F.col("n") % 100) / F.lit(100.0) / F.col("seq")).alias("score"), "seq")


@query(A + """SELECT a.id, CASE WHEN CAST(a.id AS BIGINT) % 4 = 0 AND CAST(a.id AS BIGINT) % 12 <> 0
  THEN CAST(CAST(a.id AS BIGINT) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) / 2 ELSE a.score END AS score FROM articles a""")
def score_merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d)
    return S.merge_scores(rows, _scores(rows), "seq").select("id", "score")


@query(A + """SELECT a.id, CASE WHEN CAST(a.id AS BIGINT) % 4 = 0 AND CAST(a.id AS BIGINT) % 12 <> 0
  THEN CAST(CAST(a.id AS BIGINT) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) ELSE a.score END AS score, a.status FROM articles a""")
def score_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d)
    return S.merge(rows, _scores(rows).where("seq = 1").select("id", "score"), ["score"]).select("id", "score", "status")


@query(f"""WITH {FEEDBACK_SQL}
SELECT {EVENT_ARTICLE_SQL} AS article, arg_max(status, (ts, event_id)) AS status FROM feedback WHERE event_id IS NOT NULL GROUP BY 1""")
def status_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    changes = dealt_events(table(spark, d, "events"), spark, d)
    return S.latest_status(changes, "article", ["ts", "event_id"])


@query(A + "SELECT id, CASE status WHEN 0 THEN 3 ELSE status END AS status FROM articles")
def mark_all_read(spark: SparkSession, d: str) -> DataFrame:
    return S.mark_all_read(articles(spark, d)).select("id", "status")


@query(A + "SELECT id, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 'note ' || id WHEN 1 THEN NULL ELSE 'old' END AS comment FROM articles")
def comment_empty_null(spark: SparkSession, d: str) -> DataFrame:
    stored = articles(spark, d).select("id", F.lit("old").alias("comment"))
    n = F.col("id").cast("long") % 3
    return S.set_comment(stored, stored.where(n < 2).select("id", F.when(n == 0, F.concat(F.lit("note "), "id")).otherwise("").alias("comment")))


@query(A + """SELECT id, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN NULL ELSE (CASE WHEN k % 5 - k % 7 >= 0 THEN '+' ELSE '' END) || CAST(k % 5 - k % 7 AS VARCHAR) END AS votes
  FROM (SELECT id, CAST(id AS BIGINT) AS k FROM articles)""")
def votes_net(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("long")
    rows = articles(spark, d).select("id", F.nullif(k % 5, F.lit(0)).alias("ax_upvotes"), F.nullif(k % 7, F.lit(0)).alias("ax_downvotes"))
    return rows.select("id", S.net_votes().alias("votes"))


@query("""WITH changes AS (SELECT event_type AS key, CAST(event_id AS VARCHAR) AS value, event_id AS at_ FROM events),
stored AS (SELECT DISTINCT event_type AS key, 'old' AS value, -1 AS at_ FROM events UNION ALL SELECT 'theme', 'dark', -1)
SELECT key, arg_max(value, at_) AS value FROM (SELECT * FROM changes UNION ALL SELECT * FROM stored) GROUP BY key""")
def settings_upsert(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    stored = events.select(F.col("event_type").alias("key"), F.lit("old").alias("value")).distinct().union(spark.sql("SELECT 'theme', 'dark'"))
    return S.upsert_settings(stored, events.select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), "event_id"), "event_id")


@query("""SELECT event_id, event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE '|u' || coalesce(CAST(user_id AS VARCHAR), '') END AS categories, CAST(CASE WHEN event_id % 7 = 0 THEN 20 ELSE event_id % 60 END AS INTEGER) AS daily_papers,
  CASE WHEN value IS NULL THEN 0.3 ELSE greatest(0, least(1, CAST(value AS DOUBLE))) END AS diversity_ratio, event_id % 2 = 0 AS auto_batch, event_id % 5 = 0 AS initialized FROM events""")
def settings_parse(spark: SparkSession, d: str) -> DataFrame:
    """Settings made of each event: numbers that do not parse, ratios out of range, flags that are not exactly 'true'."""
    n = F.col("event_id")
    raw = F.create_map(
        F.lit("categories"), F.concat(F.lit(" "), F.col("event_type"), F.lit(" ,,"), F.when(n % 3 != 0, F.concat(F.lit("u"), F.coalesce(F.col("user_id").cast("string"), F.lit("")))).otherwise(" ")),
        F.lit("daily_papers"), F.when(n % 7 == 0, "many").otherwise((n % 60).cast("string")), F.lit("diversity_ratio"), F.col("value").cast("string"),
        F.lit("auto_batch"), F.when(n % 2 == 0, "true").otherwise("yes"), F.lit("initialized"), F.when(n % 5 == 0, "true").otherwise("True"),
    )
    return table(spark, d, "events").withColumn("settings", raw).select("event_id", *S.parsed_settings(F.col("settings")))


@query(A + """SELECT id, CASE WHEN length(title) > 60 THEN substring(title, 1, 60) || '...' ELSE title END AS short,
  CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'T' || id ELSE title END AS shown FROM articles""")
def display_fields(spark: SparkSession, d: str) -> DataFrame:
    translated = F.when(F.col("id").cast("long") % 2 == 0, F.concat(F.lit("T"), "id")).otherwise("")
    rows = articles(spark, d).withColumn("translated_title", translated)
    return rows.select("id", T.truncated(F.col("title"), 60).alias("short"), S.display("title", "translated_title").alias("shown"))


@query(f"""WITH {ARTICLES_SQL}, {FEEDBACK_SQL},
latest AS (SELECT CAST({EVENT_ARTICLE_SQL} AS VARCHAR) AS id, arg_max(status, (ts, event_id)) AS new FROM feedback GROUP BY 1)
SELECT a.id, tab, a.status AS old, l.new,
  CASE WHEN a.status = l.new OR tab = 'all' THEN true WHEN tab = 'unread' THEN l.new IN (0, 1) WHEN tab = 'liked' THEN l.new = 2 ELSE false END AS stays
FROM articles a JOIN latest l USING (id), (VALUES ('all'), ('unread'), ('liked'), ('clicked')) t(tab)""")
def tab_visibility(spark: SparkSession, d: str) -> DataFrame:
    changes = dealt_events(table(spark, d, "events"), spark, d).withColumn("id", F.col("article").cast("string"))
    latest = S.latest_status(changes, "id", ["ts", "event_id"]).withColumnRenamed("status", "new")
    rows = articles(spark, d).select("id", F.col("status").alias("old")).join(latest, "id")
    tabs = rows.withColumn("tab", F.explode(F.array(*map(F.lit, ("all", "unread", "liked", "clicked")))))
    return tabs.select("id", "tab", "old", "new", S.stays_visible(F.col("tab"), F.col("old"), F.col("new")).alias("stays"))


@query("SELECT CAST(count(*) AS BIGINT) AS updated, CAST(0 AS BIGINT) AS failed, count(*) FILTER (event_id % 3 <> 0) AS really FROM events")
def vote_update_counts(spark: SparkSession, d: str) -> DataFrame:
    scrapes = table(spark, d, "events").select(F.when(F.col("event_id") % 3 != 0, 1).alias("hf_upvotes"), F.lit(None).cast("int").alias("ax_upvotes"))
    both = S.vote_update_counts(scrapes, compat=True)
    return both.join(F.broadcast(S.vote_update_counts(scrapes).select(F.col("updated").alias("really"))))  # one row each
