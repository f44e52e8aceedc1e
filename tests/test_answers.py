"""Answers that are kept, and services that fail."""

from __future__ import annotations

from skimmer.functions.providers import embedded
from skimmer.operators.answers import AnswerCache


def test_only_misses_are_asked(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def service(texts):
        calls.add(len(texts))
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad"), (None, "b")], "id long, text string").coalesce(1)
    cache = AnswerCache(spark, str(tmp_path / "answers"))
    ask = lambda rows, at, **more: {r["id"]: (r["answer"], r["cached"]) for r in cache.answered(rows, service, f"2024-01-01 {at}:00", **more).collect()}
    assert ask(rows, "10:00", size=1) == {1: ("A", False), 2: ("B", False), 3: ("A", False), 4: ("", False), 5: (None, False), None: ("B", False)}
    assert calls.value == 4  # a, b, the empty text and the bad one, each once
    more = rows.union(spark.createDataFrame([(6, "c" * 7000)], rows.schema))
    assert ask(more, "10:30", size=1) == {1: ("A", True), 2: ("B", True), 3: ("A", True), 4: ("", True), 5: (None, False), 6: ("C" * 6000, False), None: ("B", True)}
    assert calls.value == 6
    assert ask(rows.limit(0), "10:40") == {} and calls.value == 6
    assert {x for _, x in ask(rows, "11:31", size=1).values()} == {False} and calls.value == 10  # an hour later nothing counts


def test_vectors_of_failing_calls_are_null(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(k, "bad" if k == 3 else "x" * k) for k in range(6)], "id long, text string").coalesce(1)
    assert {r["id"]: r["vector"] for r in embedded(rows, embed).collect()} == {0: [0.0], 1: [1.0], 2: [2.0], 3: None, 4: [4.0], 5: [5.0]}
