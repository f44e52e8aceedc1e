"""Streams against the same rows in a batch, with late and repeated rows."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from skimmer.operators.store import last_by
from skimmer.streaming import feedback as W
from skimmer.streaming.profile import ProfileLedger

T0 = dt.datetime(2024, 1, 1)


def test_latest_status_over_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, article long, status int"
    parts = [[(1, T0, 1, 1), (2, T0 + dt.timedelta(hours=2), 1, 2)], [(3, T0 + dt.timedelta(hours=1), 1, -1), (4, T0, 2, 3)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sink = lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))
        W.drained(W.latest_status(stream).writeStream.outputMode("update").foreachBatch(sink), str(tmp_path / "checkpoint"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    got = {r["article"]: r["status"] for r in last_by(rows, ["article"], F.col("ts"), F.col("event_id")).collect()}
    assert got == {1: 2, 2: 3}
    assert {r["status"] for r in rows.where("article = 1").collect()} == {2}  # the late change says nothing


def test_add_new_appends_each_id_once(spark, tmp_path):
    schema = "id string, n long"
    table = str(tmp_path / "table")
    spark.createDataFrame([("a", 1)], schema).write.parquet(table)
    sink = W.add_new(spark, table, "n")
    sink(spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], schema), 0)
    sink(spark.createDataFrame([("b", 5), ("c", 6)], schema), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [("a", 1), ("b", 3), ("c", 6)]


def test_profile_updates_are_asked_again(spark, tmp_path):
    schema = "event_id long, ts timestamp, article long, status int"
    day = lambda n: T0 + dt.timedelta(days=n)
    asked, told = [], {}

    def update(window, batch, k):
        asked.append(k)
        if len(asked) % 2:
            raise RuntimeError("no network")
        told[k] = (sorted((r["article"], r["status"]) for r in window.collect()), sorted(r["event_id"] for r in batch.collect()))

    ledger = ProfileLedger(spark, str(tmp_path), update)
    ledger.sink(spark.createDataFrame([(1, day(0), 1, 0)], schema), 0)
    assert asked == [] and ledger.open() == [] and ledger.settle() == []
    ledger.sink(spark.createDataFrame([(2, day(0), 1, 2), (3, day(1), 2, 1), (4, day(1), 3, 0)], schema), 1)
    assert asked == [1] and told == {} and ledger.open() == [1]
    ledger.sink(spark.createDataFrame([(5, day(30), 1, -1), (6, day(31), 3, 3)], schema), 2)
    assert asked == [1, 1, 2] and ledger.open() == [2]
    again = ProfileLedger(spark, str(tmp_path), update)  # what is open outlives the program
    assert again.settle() == []
    assert told == {1: ([(1, 2), (2, 1)], [2, 3]), 2: ([(1, -1)], [5, 6])}  # 3 is only skipped, 2 is older than 30 days
    again.sink(spark.createDataFrame([(5, day(30), 1, -1), (6, day(31), 3, 3)], schema), 2)
    assert again.open() == [2] and again.settle() == [] and again.batch(2).count() == 2


def test_due(spark):
    rows = spark.createDataFrame([(None, "2024-01-02"), ("2024-01-02", "2024-01-02"), ("2024-01-01", "2024-01-02")], "a string, b string")
    assert [r["x"] for r in rows.select(W.due(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True]


def test_batch_gate(spark):
    rows = spark.createDataFrame([("true", "true", None), ("true", "True", None), ("false", "true", None), ("true", "true", "2024-01-02"), (None, "true", None)], "a string, i string, last string")
    settings = F.create_map(F.lit("auto_batch"), F.col("a"), F.lit("initialized"), F.col("i"))
    got = rows.select(W.batch_due(settings, F.col("last"), F.lit("2024-01-02")).alias("x")).collect()
    assert [r["x"] for r in got] == [True, False, False, False, False]


def test_progress_is_told(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "n long").write.parquet(str(tmp_path / "in"))
    listener = W.Progress()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("n long").parquet(str(tmp_path / "in"))
        W.drained(stream.writeStream.queryName("told").format("noop"), str(tmp_path / "checkpoint"))
        for _ in range(100):
            if any(e[3] == "done" for e in listener.events):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert ("told", -1, 0, "started") in listener.events and any(e[0] == "told" and e[2] == 2 for e in listener.events)
