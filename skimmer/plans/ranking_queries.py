"""Queries that rank: the flagship daily batch, recommendation lists, similarity scores, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.operators import clusters as C
from skimmer.operators import ranking as R
from skimmer.operators import store as S
from skimmer.plans.registry import query
from skimmer.sources.tables import ARTICLES_SQL, articles, dealt_articles, vectors

A = f"WITH {ARTICLES_SQL}"
BATCH_DATE = "2024-02-15"


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return C.weighted_means(dealt_articles(spark, d), vectors(spark, d))


def with_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Articles with their vector."""
    return dealt_articles(spark, d).join(vectors(spark, d).select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left")


def vector_scores(spark: SparkSession, d: str, centroids: DataFrame) -> DataFrame:
    """(vec_id, score): articles that share a vector share its score, so vectors are scored, not articles."""
    return R.score_all(vectors(spark, d).withColumnRenamed("embedding", "vector"), centroids).select("vec_id", "score")


def scored_articles(spark: SparkSession, d: str) -> DataFrame:
    return dealt_articles(spark, d).drop("score").join(vector_scores(spark, d, _centroids(spark, d)), "vec_id")


CENTROIDS_SQL = A + """,
rated AS (SELECT vec_id, CASE status WHEN -1 THEN 'negative' ELSE 'positive' END AS type, sum(CASE status WHEN 2 THEN 2.0 ELSE 1.0 END) AS w
  FROM articles WHERE status IN (1, 2, -1) GROUP BY 1, 2),
parts AS (SELECT r.type, e.label, CAST(r.w AS DOUBLE) AS w, generate_subscripts(e.embedding, 1) AS k, CAST(unnest(e.embedding) AS DOUBLE) AS x
  FROM rated r JOIN embeddings e USING (vec_id)),
means AS (SELECT type, label, k, sum(w * x) / sum(w) AS c FROM parts GROUP BY 1, 2, 3),
centroids AS (SELECT type, label, list(c ORDER BY k) AS centroid FROM means GROUP BY 1, 2),
products AS (SELECT e.vec_id, c.type, list_dot_product(CAST(e.embedding AS DOUBLE[]), c.centroid) AS sim
  FROM embeddings e, centroids c),
sims AS (SELECT vec_id, max(sim) FILTER (type = 'positive') AS p, coalesce(max(sim) FILTER (type = 'negative'), 0) AS n FROM products GROUP BY vec_id),
scored AS (SELECT a.* EXCLUDE (score), coalesce(s.p - 1.5 * s.n, 0) AS score FROM articles a JOIN sims s USING (vec_id))
"""


def split_sql(rows: str, first: str, more: str, seed: int) -> str:
    """The score part and the drawn part of a table of few rows, with their order."""
    return f""", ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({rows})),
parted AS (SELECT *, r <= {first} AS s FROM ranked),
lots AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('{seed}:' || id), id) AS lot FROM parted),
picked AS (SELECT *, CASE WHEN s THEN 'score' ELSE 'diversity' END AS recommendation_type,
  CAST(row_number() OVER (ORDER BY s DESC, score DESC, id) - 1 AS INTEGER) AS position FROM lots WHERE s OR lot <= {more})
"""


def _top_sql(table: str, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT * FROM {table} WHERE {where} ORDER BY score DESC, id LIMIT 1000) WHERE score > 0"


@query(CENTROIDS_SQL + split_sql(_top_sql("scored", "status = 0"), "14", "6", 42) + f"""SELECT id, title, round(score, 6) AS score,
  recommendation_type, position AS batch_order, '{BATCH_DATE}' AS recommend_date FROM picked""")
def daily_batch(spark: SparkSession, d: str) -> DataFrame:
    batch = R.daily_batch(scored_articles(spark, d), BATCH_DATE)
    return batch.select("id", "title", F.round("score", 6).alias("score"), "recommendation_type", "batch_order", F.date_format("recommend_date", "yyyy-MM-dd").alias("recommend_date"))


@query(A + split_sql(_top_sql("articles"), "14", "6", 42) + "SELECT id, score, recommendation_type, position FROM picked")
def recommend_score_diverse(spark: SparkSession, d: str) -> DataFrame:
    return R.recommend(articles(spark, d)).select("id", "score", "recommendation_type", "position")


@query(A + split_sql(_top_sql("articles"), "16", "9", 7) + "SELECT id, score, recommendation_type, position FROM picked")
def recommend_float_split(spark: SparkSession, d: str) -> DataFrame:
    """25 rows at a ratio of 0.4: the 32-bit split gives 16 to the scores, not 15."""
    return R.recommend(articles(spark, d), 25, 0.4, 7).select("id", "score", "recommendation_type", "position")


@query(A + split_sql("SELECT * FROM (SELECT * FROM articles ORDER BY score DESC, id LIMIT 1000) ORDER BY score DESC, id LIMIT 1000 OFFSET 10", "21", "9", 42) + "SELECT id, score, recommendation_type, position FROM picked")
def recommend_offset(spark: SparkSession, d: str) -> DataFrame:
    return R.recommend_with_offset(articles(spark, d), 30, 10).select("id", "score", "recommendation_type", "position")


@query(A + split_sql("SELECT * FROM (SELECT * FROM articles WHERE status = 0 AND id NOT IN ('1', '5', '9') ORDER BY score DESC, id LIMIT 1000)", "21", "9", 42) + "SELECT id, score, recommendation_type, position FROM picked")
def recommend_exclude_shown(spark: SparkSession, d: str) -> DataFrame:
    rows = R.without_shown(articles(spark, d), "1,5,9")
    return R.recommend_with_offset(rows, 30).select("id", "score", "recommendation_type", "position")


@query(A + split_sql(_top_sql("articles"), "14", "6", 42) + "SELECT CAST(nullif(min(position) FILTER (recommendation_type = 'diversity'), 0) AS INTEGER) AS divider FROM picked")
def recommend_divider(spark: SparkSession, d: str) -> DataFrame:
    return R.divider(R.recommend(articles(spark, d)))


@query(A + split_sql(_top_sql("articles"), "14", "6", 42) + "SELECT id, title, abstract FROM articles WHERE id IN (SELECT id FROM picked)")
def translate_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d)
    return rows.select("id", "title", "abstract").join(F.broadcast(R.recommend(rows).select("id")), "id", "left_semi")  # n rows


@query(CENTROIDS_SQL + "SELECT id, round(score, 6) AS score FROM scored")
def maxsim_score(spark: SparkSession, d: str) -> DataFrame:
    return scored_articles(spark, d).select("id", F.round("score", 6).alias("score"))


@query(CENTROIDS_SQL + "SELECT vec_id, round(p, 6) AS score FROM sims")
def maxsim_no_negative(spark: SparkSession, d: str) -> DataFrame:
    found = vector_scores(spark, d, _centroids(spark, d).where("type = 'positive'"))
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, CAST(0 AS DOUBLE) AS score FROM embeddings")
def maxsim_no_positive(spark: SparkSession, d: str) -> DataFrame:
    return vector_scores(spark, d, _centroids(spark, d).where("type = 'negative'"))


@query(CENTROIDS_SQL + """SELECT vec_id, round(max(round(sim, 4)) FILTER (type = 'positive'), 4) + 0.0 AS positive,
  round(coalesce(max(round(sim, 4)) FILTER (type = 'negative'), 0), 4) + 0.0 AS negative FROM products GROUP BY vec_id""")
def similarity_explain(spark: SparkSession, d: str) -> DataFrame:
    sets = F.broadcast(R.centroid_sets(_centroids(spark, d)))  # one row
    each = lambda side: F.array_max(F.transform(side, lambda c: F.round(R.dot(F.col("embedding"), c), 4)))
    rows = vectors(spark, d).join(sets)
    return rows.select("vec_id", (F.round(each(F.col("positive")), 4) + 0.0).alias("positive"), (F.round(F.coalesce(each(F.col("negative")), F.lit(0.0)), 4) + 0.0).alias("negative"))


@query(CENTROIDS_SQL + "SELECT type, label, CAST(k - 1 AS INTEGER) AS k, round(c, 6) AS c FROM means")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _centroids(spark, d).select("type", "label", F.posexplode("centroid").alias("k", "c")).withColumn("c", F.round("c", 6))


@query(CENTROIDS_SQL + "SELECT type, count(*) AS n FROM centroids GROUP BY type")
def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    return _centroids(spark, d).groupBy("type").agg(F.count("*").alias("n"))


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return with_vectors(spark, d).select("status", "vector")


@query()
def kmeans_weighted_positive(spark: SparkSession, d: str) -> DataFrame:
    found = C.fit_centroids(_rated(spark, d), "positive")
    return found if found is not None else spark.createDataFrame([], C.CENTROIDS)


@query()
def kmeans_negative(spark: SparkSession, d: str) -> DataFrame:
    found = C.fit_centroids(_rated(spark, d), "negative")
    return found if found is not None else spark.createDataFrame([], C.CENTROIDS)


@query(A + """, rated AS (SELECT CASE WHEN a.status = -1 THEN 'negative' ELSE 'positive' END AS type, CASE WHEN a.status = 2 THEN 2.0 ELSE 1.0 END AS w, e.embedding
  FROM articles a JOIN embeddings e USING (vec_id) WHERE a.status IN (-1, 1, 2) AND e.embedding IS NOT NULL)
SELECT type, least(10, count(DISTINCT embedding)) AS n_clusters, CAST(sum(w) AS DOUBLE) AS weight, true AS at_rest FROM rated GROUP BY type HAVING count(*) >= 5""")
def kmeans_at_rest(spark: SparkSession, d: str) -> DataFrame:
    """Of each type the clusters, the weight of all their vectors, and whether each centroid is the weighted mean of the vectors that are nearest to it."""
    out = []
    for kind in ("positive", "negative"):
        found = C.fit_centroids(_rated(spark, d), kind)
        if found is not None:
            centers = np.array([r["centroid"] for r in found.orderBy("cluster_id").collect()])  # ten at most
            means, weight, _ = C.moved(C.weighted_vectors(_rated(spark, d), kind), {0: centers})[0]
            out.append((kind, len(centers), float(weight.sum()), bool(np.abs(means - centers).max() < 1e-4)))
    return spark.createDataFrame(out, "type string, n_clusters long, weight double, at_rest boolean")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Articles of two days: those that 7 divides were tagged on the first, those that 11 divides on the second."""
    n = F.col("id").cast("long")
    day = F.when(n % 7 == 0, F.lit("2024-02-14")).when(n % 11 == 0, F.lit(BATCH_DATE)).cast("date")
    return articles(spark, d).withColumn("recommend_date", day).withColumn("batch_order", F.when(F.col("recommend_date").isNotNull(), (n % 100).cast("int")))


@query("SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN '2024-02-14' ELSE '2024-02-15' END AS recommend_date FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def recommendation_dates(spark: SparkSession, d: str) -> DataFrame:
    return S.recommendation_dates(_tagged(spark, d)).select(F.date_format("recommend_date", "yyyy-MM-dd").alias("recommend_date"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id % 100 AS INTEGER) AS batch_order FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 = 0")
def batch_readback(spark: SparkSession, d: str) -> DataFrame:
    return S.batch_of(_tagged(spark, d), BATCH_DATE).select("id", "batch_order")


@query(A + split_sql(_top_sql("articles", "status = 0"), "14", "6", 42) + f"""SELECT a.id,
  CASE WHEN p.id IS NOT NULL THEN '{BATCH_DATE}' WHEN CAST(a.id AS BIGINT) % 7 = 0 THEN '2024-02-14' END AS recommend_date,
  CASE WHEN p.id IS NOT NULL THEN p.position WHEN CAST(a.id AS BIGINT) % 7 = 0 THEN CAST(CAST(a.id AS BIGINT) % 100 AS INTEGER) END AS batch_order
FROM articles a LEFT JOIN picked p ON a.id = p.id""")
def tag_batch(spark: SparkSession, d: str) -> DataFrame:
    tagged = R.tag_batch(_tagged(spark, d), BATCH_DATE)
    return tagged.select("id", F.date_format("recommend_date", "yyyy-MM-dd").alias("recommend_date"), "batch_order")
