"""Every query against its SQL counterpart on the smallest tables, and what no SQL says about the rest."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

import __spark_entry__
from skimmer.functions.providers import hashed_embedding
from skimmer.operators import clusters as C
from skimmer.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([r[k] for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    found = catalogue.queries()[name](spark, sf_dir)
    wanted = duck.sql(SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(wanted.columns, wanted.fetchall())


def test_clusters_keep_what_must_hold(spark, sf_dir):
    centers = catalogue.queries()["kmeans_weighted_positive"](spark, sf_dir).collect()
    assert 1 <= len(centers) <= 10
    assert all(len(c["centroid"]) == 64 and max(map(abs, c["centroid"])) <= 1 for c in centers)
    assert catalogue.queries()["kmeans_negative"](spark, sf_dir).columns == ["type", "cluster_id", "centroid"]


def test_clusters_are_weighted_means_of_their_vectors(spark):
    r = np.random.default_rng(3)
    v, w = r.normal(size=(120, 4)), np.array([2.0 if k % 3 else 1.0 for k in range(120)])
    rows = spark.createDataFrame([(x.tolist(), 2 if k % 3 else 1) for k, x in enumerate(v)], "vector array<float>, status int")
    centers = np.array([c["centroid"] for c in C.fit_centroids(rows, "positive", most=4).orderBy("cluster_id").collect()])
    own = ((v[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
    for k in range(len(centers)):
        assert np.abs(np.average(v[own == k], axis=0, weights=w[own == k]) - centers[k]).max() < 0.05
    cost = (w * ((v - centers[own]) ** 2).sum(1)).sum()
    assert cost < (w * ((v - np.average(v, axis=0, weights=w)) ** 2).sum(1)).sum()


def test_restarts_cost_no_more_than_one_after_another(spark):
    r = np.random.default_rng(5)
    v = np.concatenate([r.normal(size=(60, 3)) + 6 * r.normal(size=3) for _ in range(6)])
    rows = spark.createDataFrame([(x.tolist(), 2 if k % 3 else 1) for k, x in enumerate(v)], "vector array<double>, status int")
    w = np.array([2.0 if k % 3 else 1.0 for k in range(len(v))])
    cost = lambda centers: float((w * ((v[:, None, :] - centers[None]) ** 2).sum(2).min(1)).sum())
    data = spark.createDataFrame([(x.tolist(), float(y)) for x, y in zip(v, w)], "v array<double>, w double").select(array_to_vector("v").alias("features"), "w")
    theirs = min(cost(np.array(KMeans(k=6, seed=42 + k, weightCol="w", maxIter=50).fit(data).clusterCenters())) for k in range(10))
    found = [c["centroid"] for c in C.fit_centroids(rows, "positive", most=6).orderBy("cluster_id").collect()]
    assert cost(np.array(found)) <= theirs * (1 + 1e-6)
    assert found == [c["centroid"] for c in C.fit_centroids(rows.repartition(7), "positive", most=6).orderBy("cluster_id").collect()]


def test_first_centers_are_drawn_by_weight(spark):
    data = [([float(k), 0.0], 2 if k % 2 else 1) for k in range(2)]
    rows = spark.createDataFrame([x for x in data for _ in range(3)], "vector array<double>, status int")
    assert sorted((r["v"][0], r["w"], r["n"]) for r in C.weighted_vectors(rows, "positive").collect()) == [(0.0, 3.0, 3), (1.0, 6.0, 3)]
    first = [own[0][0] for own in C._drawn(C.weighted_vectors(rows, "positive"), [np.empty((0, 2))] * 3000, 1)]
    assert abs(np.mean(first) - 2 / 3) < 0.04


def test_clusters_of_odd_vectors(spark):
    rows = [(None, 2), ([], 2), ([1.0, None], 2), ([float("nan"), 1.0], 2), ([float("inf"), 1.0], 1), ([1.0, 2.0, 3.0], 2), *[([1.0, 2.0], 2)] * 5]
    got = C.fit_centroids(spark.createDataFrame(rows, "vector array<double>, status int"), "positive").collect()
    assert [(r["type"], r["cluster_id"], r["centroid"]) for r in got] == [("positive", 0, [1.0, 2.0])]
    assert C.fit_centroids(spark.createDataFrame(rows[:8], "vector array<double>, status int"), "positive") is None
    assert C.fit_centroids(spark.createDataFrame([], "vector array<double>, status int"), "positive") is None


def test_vectors_of_whole_texts_against_one_by_one(spark, sf_dir):
    made = {r["doc_id"]: r["vector"] for r in catalogue.queries()["embed_with_provider"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert made.keys() == texts.keys()
    for k, text in texts.items():
        wanted = hashed_embedding()([(text or "")[:8000]])[0]
        assert (made[k] is None) == (wanted is None) and (wanted is None or np.allclose(made[k], wanted, atol=1e-6))


def test_provider_scores_only_the_unread(spark, sf_dir):
    before = {r["id"]: (r["status"], r["score"]) for r in catalogue.queries()["score_merge"](spark, sf_dir).collect()}
    found = catalogue.queries()["score_with_provider"](spark, sf_dir).collect()
    assert len(found) == len(before)
    assert all(0 <= r["score"] <= 1 for r in found if r["status"] == 0)


def test_entry_has_rows_in_order(spark):
    got = __spark_entry__.entry(spark).collect()
    assert got and [r["batch_order"] for r in sorted(got, key=lambda r: r["batch_order"])] == list(range(len(got)))
    kinds = [r["recommendation_type"] for r in sorted(got, key=lambda r: r["batch_order"])]
    assert kinds == sorted(kinds, reverse=True)


def test_plans_have_no_cartesian_product(spark, sf_dir):
    for name in ("daily_batch", "recommend_score_diverse", "list_by_status", "insert_ignore", "score_merge"):
        plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
    plan = catalogue.queries()["list_by_status"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
