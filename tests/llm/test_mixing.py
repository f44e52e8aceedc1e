"""Mixing: budgets against brute force, targets against a plain loop, hot sizes, odd tables."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from skimmer.llm.mixing import fill_budget, mix, op8_budget_mixing, source_targets


def test_budgets_are_met_as_well_as_can_be():
    r = random.Random(2)
    for _ in range(200):
        sizes = r.sample(range(1, 40), r.randint(1, 4))
        counts = [r.randint(1, 4) for _ in sizes]
        budget = r.randint(0, sum(s * c for s, c in zip(sizes, counts)) + 3)
        best = max(t for x in itertools.product(*(range(c + 1) for c in counts)) if (t := sum(s * k for s, k in zip(sizes, x))) <= budget)
        take = fill_budget(np.array(sizes), np.array(counts), budget)
        got = int((take * np.array(sizes)).sum())
        assert (take >= 0).all() and (take <= counts).all() and got <= budget
        start = sum(s * (c * budget // max(1, sum(a * b for a, b in zip(sizes, counts)))) for s, c in zip(sizes, counts))
        assert got >= max(start, best - max(sizes))


def test_many_small_documents_meet_the_budget_exactly():
    sizes, counts = np.arange(1, 500), np.full(499, 3)
    for budget in (1, 777, 100_001, 373_000):
        assert int((fill_budget(sizes, counts, budget) * sizes).sum()) == budget
    assert int((fill_budget(np.array([10**9, 3]), np.array([5, 10**6]), 10**9 + 30, 64)).sum()) > 0
    assert fill_budget(np.array([0, 5]), np.array([9, 2]), 100).tolist() == [0, 2]


def plain_targets(totals, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    goal, held = share * sum(totals.values()), {}
    while True:
        rest = [s for s in order if s not in held]
        total = sum(w[s] for s in rest)
        left = goal - sum(held.values())
        over = [s for s in rest if left * w[s] / total > most * totals[s]]
        if not over:
            return held | {s: left * w[s] / total for s in rest}
        held |= {s: most * totals[s] for s in over}


@pytest.mark.parametrize("totals", [{"a": 100, "b": 100, "c": 100, None: 50}, {"a": 1000, "b": 1, "é": 5, "z": 700, "Z": 3}, {"a": 10}, {"a": 0, "b": 10}, {"b": 5, "a": 10**6, "c": 10**6}])
def test_targets(spark, totals):
    frame = spark.createDataFrame(list(totals.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(frame).collect()}
    wanted = plain_targets(totals)
    assert got.keys() == wanted.keys() and all(abs(got[s] - wanted[s]) <= 1e-6 * max(1, wanted[s]) for s in wanted)


def check(rows, got):
    """Rows (id, source, size): what must hold of the copies."""
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        by.setdefault(r["_source"], []).append(r)
        assert 0 <= r["_copies"] <= 2
    totals: dict = {}
    for _, s, n in rows:
        totals[s] = totals.get(s, 0) + (n or 0)
    targets = plain_targets(totals)
    for s, own in by.items():
        taken, largest = sum(r["_copies"] * r["_size"] for r in own), max(r["_size"] for r in own)
        assert own[0]["_source_size"] == totals[s]
        assert abs(taken - targets[s]) <= max(1, largest)


@pytest.mark.parametrize("group_rows", [100_000, 7])
def test_mix_over_hot_sources_and_sizes(spark, group_rows):
    r = random.Random(6)
    rows = [(k, "hot" if k % 3 == 0 else r.choice(["a", "b", None, "c"]), 40 if k % 2 else r.randint(0, 300)) for k in range(900)]
    frame = spark.createDataFrame([(*x, "x") for x in rows], "_id long, _source string, _size long, note string")
    first, again = mix(frame, group_rows=group_rows).collect(), mix(frame.repartition(3), group_rows=group_rows).collect()
    check(rows, first)
    assert {(x["_id"], x["_copies"]) for x in first} == {(x["_id"], x["_copies"]) for x in again}
    assert all(x["note"] == "x" for x in first)


def test_edges_of_tables(spark):
    schema = "_id long, _source string, _size long"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    assert [r["_copies"] for r in mix(spark.createDataFrame([(1, None, 0), (1, None, 0)], schema)).collect()] == [0, 0]
    assert len(mix(spark.createDataFrame([(None, "a", 5), (None, "a", 5), (2, "a", 5)], schema)).collect()) == 3


def test_query_over_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()
    rows = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs}
    got = op8_budget_mixing(spark, sf_dir).collect()
    totals: dict = {}
    for s, n in rows.values():
        totals[s] = totals.get(s, 0) + n
    targets, taken = plain_targets(totals), dict.fromkeys(totals, 0)
    for r in got:
        s, n = rows[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, totals[s]) and abs(r["target"] - targets[s]) < 1e-6 * targets[s] + 1e-6 and r["taken"] <= 2 * n
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - targets[s]) <= max(1, max(n for t, n in rows.values() if t == s)) for s in totals)
