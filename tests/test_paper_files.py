"""One file for each paper: round trips, and nothing of a failed task."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skimmer.operators import papers


def test_round_trip(spark, tmp_path):
    rows = [("a/b", "x\r\ny\n"), ("c d%", ""), ("ü.", "é" * 1000), ("none", None), (None, "lost"), ("..", "dots")]
    df = spark.createDataFrame(rows, "paper string, text string").repartition(3)
    path = str(tmp_path / "out")
    papers.write_paper_files(df, path)
    assert sorted(map(tuple, papers.paper_files(spark, path).collect())) == sorted(r for r in rows if None not in r)
    assert len(list(Path(path).rglob("*.txt"))) == 4 and not list(Path(path).rglob("_open/*"))
    papers.write_paper_files(df.where("paper = 'a/b'"), path)  # written again: what was there goes
    assert [tuple(r) for r in papers.paper_files(spark, path).collect()] == [rows[0]]
    papers.write_profile(spark.createDataFrame([("# Likes\n- graphs",)], "text string"), str(tmp_path / "profile"))
    assert [p.read_text() for p in tmp_path.glob("profile/*/preferences.md")] == ["# Likes\n- graphs"]


def test_nothing_of_a_failed_job_stays(spark, tmp_path):
    path = str(tmp_path / "out")
    papers.write_paper_files(spark.createDataFrame([("kept", "before")], "paper string, text string"), path)

    @F.udf("string")
    def fails(k):
        if k == 150:
            raise RuntimeError("no")
        return f"text {k}"

    bad = spark.range(200).repartition(4).select(F.concat(F.lit("p"), "id").alias("paper"), fails("id").alias("text"))
    with pytest.raises(Exception, match="no"):
        papers.write_paper_files(bad, path)
    assert [tuple(r) for r in papers.paper_files(spark, path).collect()] == [("kept", "before")]
    assert [p.name for p in Path(path).rglob("*.txt") if "_open" not in p.parts] == ["kept.txt"]
