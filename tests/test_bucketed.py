"""The store on disk: what a change touches is rewritten, nothing else."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skimmer.operators.bucketed import BucketedStore
from skimmer.operators.store import merge
from skimmer.sources.tables import conform


def files(path):
    return {p.relative_to(path).parent.name: sorted(x.name for x in p.parent.glob("*.parquet")) for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    rows = conform(spark.range(400).selectExpr("CAST(id AS STRING) AS id", "'t' || id AS title", "'l' AS link", "'s' AS source", "CAST(id % 4 AS INT) AS status", "timestamp_seconds(id * 86400) AS timestamp"))
    own = BucketedStore(spark, f"{tmp_path}/articles", 16)
    own.create(rows)
    assert sorted(files(own.path)) == sorted(f"bucket={k}" for k in range(16))
    return own


def test_untouched_files_keep_their_names(spark, store):
    before, plain = files(store.path), store.rows().collect()
    changes = spark.createDataFrame([("7", 0.5, 1), ("7", 0.7, 2), ("8", None, 1), ("nobody", 1.0, 1)], "id string, score double, seq int")
    touched = store.update(changes, ["score"], "seq")
    after = files(store.path)
    assert 1 <= len(touched) <= 3
    assert {b for b in before if before[b] != after[b]} == {f"bucket={k}" for k in touched} and all(len(x) == 1 for x in after.values())
    found = {r["id"]: r["score"] for r in store.rows().collect()}
    assert len(found) == len(plain) == 400 and found["7"] == 0.7 and found["8"] is None and found["9"] == 0.0


def test_every_change_equals_the_whole_table_merge(spark, store):
    changes = spark.range(0, 400, 3).selectExpr("CAST(id AS STRING) AS id", "'c' || id AS comment")
    wanted = merge(store.rows(), changes, ["comment"]).collect()
    store.update(changes, ["comment"])
    assert sorted(map(repr, store.rows().collect())) == sorted(map(repr, wanted))
    store.update(changes, ["comment"])  # again: the same
    assert sorted(map(repr, store.rows().collect())) == sorted(map(repr, wanted))


def test_inserts_add_files_and_ignore_known_keys(spark, store):
    before = files(store.path)
    new = store.rows().where("id IN ('1', '2')").select("*").withColumn("seq", F.lit(1))
    added = new.withColumn("id", F.lit("new")).limit(1).unionByName(new).unionByName(new.where("id = '1'").withColumn("id", F.lit("new")).withColumn("title", F.lit("first")).withColumn("seq", F.lit(0)))
    touched = store.insert(added, "seq")
    after = files(store.path)
    assert len(touched) == 1 and all(set(before[b]) <= set(after[b]) for b in before) and sum(map(len, after.values())) == sum(map(len, before.values())) + 1
    assert store.rows().count() == 401 and store.rows().where("id = 'new'").first()["title"] == "first"
    assert store.insert(added, "seq") == [] and store.insert(added.limit(0), "seq") == []


def test_conditions_touch_the_buckets_that_hold_such_rows(spark, store):
    assert store.update_where(F.col("id") == "5", {"status": F.lit(2)}) == store._holding(F.col("id") == "5")
    store.mark_all_read()
    assert store.mark_all_read() == [] and store.rows().where("status = 0").count() == 0 and store.rows().where("status = 3").count() == 200
    store.retain("1971-01-01 00:00:00")
    assert store.rows().count() == 400 - 335
    assert store.retain("1971-01-01 00:00:00") == []


def test_buckets_from_which_all_rows_go(spark, store):
    store.delete_where(F.col("id").cast("int") >= 0)
    assert files(store.path) == {} and store.rows().count() == 0
    one = conform(spark.createDataFrame([("a", "t", "l", "s"), (None, "t", "l", "s")], "id string, title string, link string, source string")).withColumn("seq", F.lit(0))
    assert len(store.insert(one, "seq")) == 1 and [r["id"] for r in store.rows().collect()] == ["a"]
