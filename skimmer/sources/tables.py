"""Tables: schemas of the article store, Parquet readers, and the adapter that shows the driver tables as articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNREAD, CLICKED, LIKED, SKIPPED, DISLIKED = 0, 1, 2, 3, -1

#: Columns of an article; what a source lacks is null.
ARTICLE = T.StructType(
    [
        T.StructField(name, kind, name not in ("id", "title", "link", "source"))
        for name, kind in (
            ("id", T.StringType()), ("title", T.StringType()), ("link", T.StringType()), ("abstract", T.StringType()), ("source", T.StringType()),
            ("vector", T.ArrayType(T.FloatType())), ("status", T.IntegerType()), ("score", T.DoubleType()), ("translated_title", T.StringType()),
            ("translated_abstract", T.StringType()), ("author", T.StringType()), ("category", T.StringType()), ("hf_upvotes", T.IntegerType()),
            ("ax_upvotes", T.IntegerType()), ("ax_downvotes", T.IntegerType()), ("votes_updated_at", T.TimestampType()), ("comment", T.StringType()),
            ("recommend_date", T.DateType()), ("batch_order", T.IntegerType()), ("timestamp", T.TimestampType()),
        )
    ]
)

#: What "now" is in the queries over the driver tables.
AS_OF = "2024-02-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of an article: additive evolution, what is missing is null, status 0 and score 0."""
    have = set(df.columns)
    default = {"status": F.lit(UNREAD), "score": F.lit(0.0)}
    return df.select(*[(F.col(f.name) if f.name in have else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in ARTICLE])


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``labels`` as articles (id, title, abstract, link, source, category, status, score, timestamp).

    The title is the text's first line, the abstract its first 2000 letters, as ingestion cuts it. Status comes from the labels, score and age from the number, so that every query has an SQL counterpart.
    """
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("_labelled"))
    status = (
        F.when(F.col("_labelled").isNull(), UNREAD)
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), LIKED)
        .when(F.col("quality") == 1, CLICKED)
        .when(F.col("toxic") == 1, DISLIKED)
        .otherwise(SKIPPED)
    )
    n = F.col("doc_id")
    # texts are cut before the join, so that it moves what is kept of them
    cut = d.select("doc_id", "source", "lang", F.split("text", "\n", 2)[0].alias("title"), F.substring("text", 1, 2000).alias("abstract"))
    return cut.join(marks, "doc_id", "left").select(
        n.cast("string").alias("id"), "title", "abstract",
        F.concat(F.lit("https://arxiv.org/abs/"), n.cast("string")).alias("link"), "source", F.col("lang").alias("category"), status.cast("int").alias("status"),
        ((n * 7919 % 1000) / F.lit(1000.0) - F.lit(0.2)).alias("score"), F.timestamp_add("DAY", (n % 45).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("timestamp"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding, label) of all vectors, which articles share."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def dealt_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with vec_id, the number of their vector: they are dealt over all numbers that vectors have."""
    last = vectors(spark, sf_dir).agg(F.max("vec_id")).first()[0]
    return articles(spark, sf_dir).withColumn("vec_id", F.col("id").cast("long") % F.lit(1 if last is None else last + 1))


#: The same adapter in DuckDB's SQL, as a common table expression.
ARTICLES_SQL = """articles AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, string_split(d.text, chr(10))[1] AS title, substring(d.text, 1, 2000) AS abstract,
         'https://arxiv.org/abs/' || CAST(d.doc_id AS VARCHAR) AS link, d.source, d.lang AS category,
         CASE WHEN l.doc_id IS NULL THEN 0 WHEN l.quality = 1 AND l.toxic = 0 THEN 2 WHEN l.quality = 1 THEN 1 WHEN l.toxic = 1 THEN -1 ELSE 3 END AS status,
         CAST(d.doc_id * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) - CAST(0.2 AS DOUBLE) AS score,
         TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 45 AS INTEGER)) AS timestamp, d.doc_id % (SELECT coalesce(max(vec_id) + 1, 1) FROM embeddings) AS vec_id
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def feedback_events(events: DataFrame) -> DataFrame:
    """(event_id, ts, user_id, status) of an event table or stream: each kind of event as the status that it stands for."""
    kind = F.create_map(*[F.lit(x) for x in ("click", CLICKED, "purchase", LIKED, "error", DISLIKED, "signup", SKIPPED)])
    return events.select("event_id", "ts", "user_id", F.coalesce(kind[F.col("event_type")], F.lit(UNREAD)).alias("status"))


def dealt_events(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as feedback with article, the number of the article that each is about: they are dealt over all numbers that documents have."""
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    return feedback_events(events).withColumn("article", F.col("event_id") % F.lit(1 if last is None else last + 1))


#: White space of Unicode, for patterns of DuckDB.
SPACE_SQL = r"[\s\x0B\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trimmed_sql(x: str) -> str:
    """``x`` without white space at either end, in DuckDB's SQL."""
    return f"regexp_replace({x}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


EVENT_ARTICLE_SQL = "event_id % (SELECT coalesce(max(doc_id) + 1, 1) FROM documents)"
FEEDBACK_SQL = """feedback AS (
  SELECT event_id, ts, user_id, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN -1 WHEN 'signup' THEN 3 ELSE 0 END AS status FROM events)"""
