"""Nearest neighbours: recall and exact scores against brute force, odd vectors, small tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skimmer.llm.neighbours import TOP, neighbour_graph, op7_nn_descent, search, told, usable


def nearest(ids, v, query, top=TOP):
    s = v @ v[query]
    order = np.lexsort((ids, -s))
    return [int(ids[k]) for k in order if k != query][:top]


def recall(got, ids, v):
    at = {int(i): k for k, i in enumerate(ids)}
    hits = [len(set(found) & set(nearest(ids, v, at[q]))) / len(nearest(ids, v, at[q])) for q, found in got.items()]
    return sum(hits) / len(hits)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    at = {int(i): k for k, i in enumerate(ids)}
    got: dict[int, list[int]] = {}
    for r in op7_nn_descent(spark, sf_dir).orderBy("query_id", "rank").collect():
        own = got.setdefault(r["query_id"], [])
        own.append(r["vec_id"])
        assert r["rank"] == len(own) and abs(r["score"] - v[at[r["query_id"]]] @ v[at[r["vec_id"]]]) < 1e-12
    assert sorted(got) == sorted(int(i) for i in ids if i % 20 == 0) and all(len(x) == TOP and len(set(x)) == TOP for x in got.values())
    assert recall(got, ids, v) >= 0.95


def test_popular_and_equal_vectors(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(600, 16))
    v[:200] = v[0]  # a group of equal vectors
    v[300] *= 20  # one that is near to many
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    graph = neighbour_graph(frame)
    assert graph.groupBy("id").count().agg(F.max("count")).first()[0] <= 30
    got: dict[int, list[int]] = {}
    for row in search(frame, graph, frame.where("id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    assert recall({q: f for q, f in got.items() if q >= 200}, np.arange(600), v) >= 0.9
    s = v @ v.T
    for q, f in got.items():  # among equal ones any score as high counts
        assert sum(s[q, x] for x in f) >= 0.95 * sum(s[q, x] for x in nearest(np.arange(600), v, q))


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [0.0, -1.0])]
    frame = usable(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, e array<double>, id int"), "vec_id", "e")
    assert sorted(r["id"] for r in frame.collect()) == [0, 9, 20]
    got = search(frame, neighbour_graph(frame), frame.where("id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 20, 0.5), (0, 9, 0.0), (20, 0, 0.5), (20, 9, -0.5)]


def test_empty_and_single(spark):
    for rows in ([], [(0, [1.0, 2.0])]):
        frame = usable(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
        assert search(frame, neighbour_graph(frame), frame).count() == 0


def test_copies_are_found_by_id(spark, tmp_path):
    r = np.random.default_rng(3)
    v = r.normal(size=(700, 16))
    v[r.permutation(700)[:300]] = v[7]  # more copies than a list holds, dealt over the ids
    v[r.permutation(700)[:90]] = v[11]
    v[690] = -v[7]
    # distinct vectors that are equally near to one another
    v = np.concatenate([v, np.eye(16)[r.integers(0, 16, 100)] * 9])
    ids = r.permutation(len(v))
    frame = spark.createDataFrame([(int(i), x.tolist(), 0) for i, x in zip(ids, v)], "vec_id long, embedding array<double>, label int")
    frame.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got: dict[int, list[int]] = {}
    for row in op7_nn_descent(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        own = got.setdefault(row["query_id"], [])
        own.append(row["vec_id"])
        assert row["rank"] == len(own)
    assert sorted(got) == [k for k in range(len(v)) if k % 20 == 0] and all(len(set(x)) == TOP and q not in x for q, x in got.items())
    at = {int(i): k for k, i in enumerate(ids)}
    s = np.array([[sum((a * b).tolist()) for b in v] for a in v[[at[q] for q in sorted(got)]]])
    share = {}
    for row, q in zip(s, sorted(got)):
        best = [int(ids[k]) for k in np.lexsort((ids, -row)) if ids[k] != q][:TOP]
        share[q] = len(set(best) & set(got[q])) / TOP
    copied = [q for q in got if sum((v == v[at[q]]).all(1)) > TOP]
    assert len(copied) >= 10 and all(share[q] == 1 for q in copied)
    assert np.mean(list(share.values())) >= 0.95


def test_a_full_list_takes_an_equal_one_with_a_smaller_id():
    ids, v, edges = np.array([5, 1, 9]), np.ones((3, 1), np.float32), np.array([0, 3])
    of = lambda worst, last, n: sorted((i, o) for b in told(ids, v, worst, last, np.ones(3, bool), edges, n) for i, o, _ in zip(*(c.to_pylist() for c in b.columns)))
    assert of(np.ones(3, np.float32), np.array([9, 9, 1]), 8) == [(1, 5), (5, 1)]
    assert of(np.full(3, -np.inf, np.float32), np.zeros(3, np.int64), 1) == [(1, 5), (5, 1), (9, 1)]


def test_places_are_compared_as_one_by_one():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 40, 50)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    n = int(edges[-1])
    ids, v, fresh = r.permutation(n), r.normal(size=(n, 8)).astype(np.float32), r.random(n) < 0.5
    worst = r.normal(size=n).astype(np.float32)
    got = {(i, o) for b in told(ids, v, worst, np.zeros(n, np.int64), fresh, edges, 5) for i, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    wanted = set()
    for a, b in zip(edges, edges[1:]):
        for k in range(a, b):
            near = sorted((-float(v[k] @ v[j]), int(ids[j])) for j in range(a, b) if j != k and (fresh[k] or fresh[j]) and v[k] @ v[j] > worst[k])[:5]
            wanted |= {(int(ids[k]), o) for _, o in near}
    assert got == wanted


def test_repeated_and_ragged_rows(spark, tmp_path):
    r = np.random.default_rng(6)
    v = r.normal(size=(120, 6))
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    rows += [(0, v[0].tolist()), (20, (v[20] + 1).tolist()), (40, v[41].tolist()), (500, [1.0, 2.0]), (520, [1.0] * 7), (60, [1.0])]
    spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, id int").write.parquet(f"{tmp_path}/embeddings.parquet")
    by: dict[int, list] = {}
    for i, x in rows:
        if len(x) == 6:
            by.setdefault(i, []).append(x)
    one = {i: min(x) for i, x in by.items()}
    got: dict[int, list] = {}
    for row in op7_nn_descent(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"]))
    assert sorted(got) == [0, 20, 40, 60, 80, 100]
    for q, found in got.items():
        best = sorted((-sum(a * b for a, b in zip(one[q], one[i])), i) for i in one if i != q)[:TOP]
        assert found == [(k + 1, i) for k, (_, i) in enumerate(best)]


def test_large_components(spark, tmp_path):
    v = np.random.default_rng(8).normal(size=(300, 4)) * 1e100
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got: dict[int, list[int]] = {}
    for row in op7_nn_descent(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    assert len(got) == 15 and recall(got, np.arange(300), v) >= 0.95


def test_recall_on_the_largest_table(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got: dict[int, list[int]] = {}
    for r in op7_nn_descent(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert recall(got, ids, v) >= 0.9
