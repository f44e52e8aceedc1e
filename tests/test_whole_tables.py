"""Queries over tables larger than the test tables: no row is dropped for its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from skimmer.plans import catalogue


def test_id_from_url_keeps_large_ids(spark, tmp_path):
    ids = [0, 99_999, 100_000, 1_234_567, 98_765_432_101]
    spark.createDataFrame([(k,) for k in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["k"]): (r["id"], r["older"]) for r in catalogue.queries()["id_from_url"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [(n, k) for n in ids for k in range(4)]
    for n in ids:
        new = f"2401.{n % 100000:05d}"
        assert [got[n, k] for k in range(4)] == [(f"hep-ph/{n % 10000000:07d}", "hep"), (new, new), ("2402.00001", "2402.00001"), (None, None)]


def test_every_vector_is_scored_and_learned_from(spark, tmp_path):
    spark.range(1400).selectExpr("id AS doc_id", "'some text' AS text", "'en' AS lang", "'x' AS source", "9L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1400).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    made = spark.range(700).selectExpr("id AS vec_id", "array(CAST(id AS FLOAT), 1F) AS embedding", "CAST(id DIV 350 AS INT) AS label")
    made.write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path))
    for name in ("maxsim_no_negative", "maxsim_no_positive", "similarity_explain"):
        assert run(name).select("vec_id").distinct().count() == 700, name
    assert run("maxsim_score").count() == 1400
    # every vector is shared by two articles of one status, so the means are those of all vectors
    means = {r["label"]: r["c"] for r in run("label_centroids").where(F.col("k") == 0).collect()}
    assert means == {0: 174.5, 1: 524.5}
