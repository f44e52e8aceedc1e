"""Merkle trees: what equal and different roots tell, the next document, the query against brute force."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from skimmer.llm import merkle as M


def prints(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", M.fingerprint(F.col("t")).alias("f"))
    return [r["f"] for r in rows.orderBy("k").collect()]


def test_equal_roots_for_equal_texts_only(spark):
    texts = ["a b c", "a b c", "a b  c", "a b c\n", "", None, "\n", " ", "a", "x " * 50_000, "x " * 50_000 + "y", "é\né", "é\n\né"]
    f = prints(spark, texts)
    keys = [t or "" for t in texts]
    for i in range(len(f)):
        for j in range(len(f)):
            assert (f[i] == f[j]) == (keys[i] == keys[j]) == (f[i][:64] == f[j][:64])


def test_changed_paragraphs_and_likeness(spark):
    base = [f"paragraph number {k} has some words of its own {k * 7}" for k in range(40)]
    edit = [*base[:10], "something else entirely now", *base[11:]]
    rows = spark.createDataFrame([("\n".join(base), "\n".join(edit)), ("\n".join(base), "\n".join(base)), ("a", "b"), (None, "")], "a string, b string")
    fa, fb = M.fingerprint(F.col("a")), M.fingerprint(F.col("b"))
    got = rows.select(M.changed_paragraphs(fa, fb).alias("c"), M.likeness(fa, fb).alias("l"), M.sections(fa).alias("s"), M.sections(fb).alias("t")).collect()
    assert got[0]["c"] == [10] and 0.9 < got[0]["l"] < 1
    assert len(set(got[0]["t"]) - set(got[0]["s"])) <= 2 < len(got[0]["s"])  # only the branch of the edit differs
    assert got[1]["c"] == [] and got[1]["l"] == 1.0 and got[2]["l"] == 0.0 and got[3]["l"] == 1.0


def test_edits_tell_what_came_went_and_moved(spark):
    cases = [("a\nb", "a\nb\na", 2, 0, 1, 0, 1, 0), ("a\nb\nc", "a\nc", 1, 1, 0, 1, 0, 0), ("a\nb", "b\na", 0, 2, 2, 0, 0, 2), ("a\nb\nc", "a\nx\nc", 1, 1, 1, 1, 1, 0), ("a\na\na", "a", 1, 2, 0, 1, 0, 0), ("", "a", 0, 1, 1, 1, 1, 0)]
    lines = [f"line {k} of some text" for k in range(300)]
    text = "\n".join
    cases += [(text(lines), text([*lines[:100], "new", *lines[100:]]), 100, 0, 1, 0, 1, 0), (text(lines), text([*lines[:100], *lines[130:]]), 100, 30, 0, 30, 0, 0), (text(lines), text([*lines[:50], *lines[60:200], *lines[50:60], *lines[200:]]), 50, 150, 150, 0, 0, 150)]
    rows = spark.createDataFrame([(k, *x[:2]) for k, x in enumerate(cases)], "k int, a string, b string")
    e = M.edits(M.fingerprint(F.col("a")), M.fingerprint(F.col("b")))
    got = {r["k"]: r["e"] for r in rows.select("k", e.alias("e")).collect()}
    for k, x in enumerate(cases):
        assert (got[k]["first"], got[k]["before"], got[k]["after"], len(got[k]["deleted"]), len(got[k]["inserted"]), len(got[k]["moved"])) == x[2:], x
    assert rows.where("k = 0").select(M.edits(M.fingerprint(F.col("a")), M.fingerprint(F.col("a"))).alias("e")).first()["e"] is None


def test_one_far_id_makes_no_bucket_large(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = rows.union(spark.createDataFrame([((1 << 61), "far"), (-(1 << 62), "low")], "doc_id long, text string"))
    size = rows.groupBy(M._bucket(F.col("doc_id"), M._quantiles(rows, "doc_id", 10)).alias("b")).count().collect()
    assert len(size) >= 9 and max(r["count"] for r in size) <= 3000
    got = {r["doc_id"]: r["next_text"] for r in M.with_next(rows, "doc_id", ["text"]).collect()}
    assert got == {k: str(k + 1) for k in range(19_999)} | {19_999: "far", 1 << 61: "low", -(1 << 62): "0"}


def test_next_document_over_any_buckets(spark):
    ids = [5, 1, 9, None, 9, -(1 << 62), (1 << 62) + 5, 3, 3, 2]
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    wanted = sorted((str(a), b[1]) for a, b in zip(ordered, [*ordered[1:], ordered[0]]))
    for size in (1, 2, 3, 100):
        got = M.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"], bucket_rows=size).collect()
        assert sorted((str((r["doc_id"], r["text"])), r["next_text"]) for r in got) == wanted, size
    one = M.with_next(spark.createDataFrame([(7, "x")], "doc_id long, text string"), "doc_id", ["text"]).collect()
    assert [(r["doc_id"], r["next_text"]) for r in one] == [(7, "x")]
    assert M.with_next(spark.createDataFrame([], "doc_id long, text string"), "doc_id", ["text"]).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in M.op3_merkle_tree(spark, sf_dir).collect()}
    assert sorted(got) == [d for d, _ in docs]
    for k, (d, text) in enumerate(docs):
        q = len(text) // 4
        edited = text[: len(text) - q] + docs[(k + 1) % len(docs)][1][:q]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    near = [r["near_edited"] for r in got.values() if r["n_chars"] > 2000]
    assert sum(near) / len(near) > 0.6


def test_main_path_is_native(spark, sf_dir):
    plan = M.op3_merkle_tree(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
