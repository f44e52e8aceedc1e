"""Streams with state of their own, over several runs, with late and repeated rows."""

from __future__ import annotations

import datetime as dt

from skimmer.streaming import feedback as W
from skimmer.streaming import stateful as K

T0 = dt.datetime(2024, 1, 1)


def at(**x):
    return T0 + dt.timedelta(**x)


def test_counts_stay_right_when_a_status_changes(spark, tmp_path):
    schema = "event_id long, ts timestamp, article long, status int"
    parts = [
        [(1, at(hours=1), 1, 0), (2, at(hours=2), 1, 2), (3, T0, 2, 0), (9, None, 3, 1), (8, T0, None, 1)],
        [(4, at(hours=3), 1, 3), (2, at(hours=2), 1, 2), (5, T0, 2, 1)],
        [(6, at(minutes=30), 1, -1), (5, T0, 2, 1), (7, at(hours=4), 1, 3)],
    ]
    wanted = [{2: 1, 0: 1}, {3: 1, 1: 1}, {3: 1, 1: 1}]
    told = []
    for rows, counts in zip(parts, wanted):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with K.with_state(spark):
            W.drained(K.status_changes(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "checkpoint"))
        rows = spark.read.schema("status int, change int").parquet(str(tmp_path / "out"))
        assert {r["status"]: r["n"] for r in K.counts_of(rows).collect()} == counts
        told.append(rows.count())
    assert told == [2, 6, 6]  # what is late, repeated or no change tells nothing
    assert "HDFS" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_memory_forgets_after_its_days(spark, tmp_path):
    schema = "id string, ts timestamp"
    parts = [
        [("a", T0), ("a", at(days=1)), ("b", T0), ("b", at(days=40)), (None, T0), ("c", None)],  # b is silent for 40 days in one batch
        [("c", at(days=50))],
        [("a", at(days=60)), ("c", at(days=51)), ("a", at(days=2))],  # a begins anew; its late row is too late
        [("d", at(days=200))],
        [("d", at(days=200))],
    ]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with K.with_state(spark):
            W.drained(K.forgotten(stream, "id").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    got = sorted((r["id"], r["first_ts"], r["last_ts"], r["n"]) for r in spark.read.schema("id string, first_ts timestamp, last_ts timestamp, n long").parquet(str(tmp_path / "out")).collect())
    assert got == [("a", T0, at(days=1), 2), ("a", at(days=60), at(days=60), 1), ("b", T0, T0, 1), ("b", at(days=40), at(days=40), 1), ("c", at(days=50), at(days=51), 2)]
