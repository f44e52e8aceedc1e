"""Queries of the store on disk: written, changed by buckets, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.operators import papers
from skimmer.operators.bucketed import BucketedStore
from skimmer.plans.registry import query
from skimmer.plans.stream_queries import _folder
from skimmer.sources.tables import ARTICLES_SQL, AS_OF, articles, conform, table

A = f"WITH {ARTICLES_SQL}"
STORE_BUCKETS = 32


def _store(spark: SparkSession, tag: str) -> BucketedStore:
    return BucketedStore(spark, f"{_folder(spark, tag)}/articles", STORE_BUCKETS)


@query(A + """, k AS (SELECT *, CAST(id AS BIGINT) AS n FROM articles),
scored AS (SELECT id, CASE WHEN n % 4 = 0 THEN CAST(length(title) AS DOUBLE) / CAST(2 AS DOUBLE) ELSE score END AS score, CASE WHEN n % 6 = 0 THEN nullif(substring(title, 1, 9), '') END AS comment,
  CASE WHEN n % 10 = 1 THEN 2 ELSE status END AS status, CASE WHEN n % 5 = 0 THEN 'T ' || title END AS translated_title, n FROM k)
SELECT id, score, comment, CASE WHEN status = 0 THEN 3 ELSE status END AS status, translated_title FROM scored""")
def store_updates(spark: SparkSession, d: str) -> DataFrame:
    """Scores (two for each id, the last counts), comments, a status and translations by id, then all unread marked as read, each on the written table."""
    rows = conform(articles(spark, d))
    n, store = F.col("id").cast("long"), _store(spark, "updates")
    store.create(rows)
    twice = rows.where(n % 4 == 0).select("id", F.length("title").cast("double").alias("l"), F.explode(F.array(F.lit(2), F.lit(1))).alias("seq"))
    twice = twice.unionByName(rows.limit(1).select(F.lit("unknown").alias("id"), F.lit(1.0).alias("l"), F.lit(1).alias("seq")))
    store.update(twice.select("id", (F.col("l") / F.col("seq")).alias("score"), "seq"), ["score"], "seq")
    store.update(rows.where(n % 6 == 0).select("id", F.nullif(F.substring("title", 1, 9), F.lit("")).alias("comment")), ["comment"])
    store.update(rows.where(n % 10 == 1).select("id", F.lit(2).alias("status")), ["status"])
    store.update(rows.where(n % 5 == 0).select("id", F.concat(F.lit("T "), "title").alias("translated_title")), ["translated_title"])
    store.mark_all_read()
    return store.rows().select("id", "score", "comment", "status", "translated_title")


@query(A + """SELECT id, title, source FROM articles WHERE (CAST(id AS BIGINT) % 3 <> 0 OR (title IS NOT NULL AND source IS NOT NULL)) AND timestamp >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY""")
def store_insert_retain(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the articles stored, then all come in, some twice; known ones are ignored, and what is older than 30 days goes."""
    rows = conform(articles(spark, d))
    n, store = F.col("id").cast("long"), _store(spark, "inserts")
    store.create(rows.where(n % 3 != 0))
    again = rows.where((n % 2 == 0) & F.col("title").isNotNull()).withColumns({"title": F.lit("a later version"), "seq": F.lit(1)})
    store.insert(rows.withColumn("seq", F.lit(0)).unionByName(again), "seq")
    store.retain(AS_OF)
    return store.rows().select("id", "title", "source")


@query("""SELECT 'docs/' || doc_id AS paper, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'preferences', string_agg('- ' || source || ': ' || n, chr(10) ORDER BY source)
FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)""")
def paper_files_back(spark: SparkSession, d: str) -> DataFrame:
    """Every text written as a file of its own, a profile as a Markdown file, and both read back."""
    docs, out = table(spark, d, "documents"), _folder(spark, "files")
    papers.write_paper_files(docs.select(F.concat(F.lit("docs/"), "doc_id").alias("paper"), "text"), f"{out}/papers")
    lines = F.sort_array(F.collect_list(F.struct("source", F.concat(F.lit("- "), "source", F.lit(": "), "n").alias("line"))))
    liked = docs.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    papers.write_profile(liked, f"{out}/profile")
    return papers.paper_files(spark, f"{out}/papers").unionByName(papers.paper_files(spark, f"{out}/profile", "md"))
