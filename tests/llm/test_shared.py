"""Slices of batches, bounded memories, scratch tables."""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
import pytest

from skimmer.llm import shared as S


@pytest.mark.parametrize("sizes", [[], [0], [5] * 100, [0] * 50, [10_000, 1, 1, 10_000, 0, 3], [1, 99_999]])
def test_slices_hold_every_row_once_and_few_bytes(sizes):
    texts = pa.array([None if n == 3 else "x" * n for n in sizes], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), texts], names=["k", "t"])
    parts = list(S.slices(batch, batch.column(1), size=100, rows=30))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(len(sizes)))
    for p in parts:
        assert p.num_rows <= 30 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) < 200 or max(len(t or "") for t in p.column(1).to_pylist()) > 100)
    assert [t for p in S.slices(texts, size=100) for t in p.to_pylist()] == texts.to_pylist()


def test_memories_stay_within_their_budget():
    kept = S.Kept(10_000, longest=20)
    for k in range(1000):
        kept.keep(f"key {k}", k, 50)
        assert kept.weight <= 10_000 and len(kept) <= 40
    assert kept["key 999"] == 999
    kept.keep("x" * 21, 1, 1)
    assert "x" * 21 not in kept


def test_a_cluster_must_name_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default: default)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        S.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))
    context.getCheckpointDir = lambda: "hdfs://shared"
    assert S.shared_folder(SimpleNamespace(conf=conf, sparkContext=context)) == "hdfs://shared"


def test_scratch_tables_go_when_they_are_done_with(spark):
    table = S.written(spark.range(3), "tried")
    assert table.count() == 3
    S.done_with(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
