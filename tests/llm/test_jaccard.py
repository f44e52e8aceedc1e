"""N-gram Jaccard join against all pairs, with copies, short texts, ties and large groups."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from skimmer.llm import components as C
from skimmer.llm import jaccard as J
from skimmer.llm.components import components
from skimmer.llm.jaccard import THRESHOLD, jaccard_classes, op6_jaccard_forest


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=THRESHOLD):
    """doc: (class, links, links to other texts, copies) by comparing all texts."""
    words = {d: tuple((t or "").lower().split()) for d, t in rows}
    by = defaultdict(list)
    for d, w in words.items():
        if w:
            by[w].append(d)
    texts = sorted(by)
    sets = [grams(" ".join(w)) for w in texts]
    near = defaultdict(set)
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                near[i].add(j)
                near[j].add(i)
    out, seen = {d: (d, 0, 0, 0) for d, w in words.items() if not w}, set()
    for i in range(len(texts)):
        if i in seen:
            continue
        stack, part = [i], {i}
        while stack:
            for j in near[stack.pop()] - part:
                part.add(j)
                stack.append(j)
        seen |= part
        first = min(d for k in part for d in by[texts[k]])
        for k in part:
            for d in by[texts[k]]:
                copies = len(by[texts[k]]) - 1
                out[d] = (first, copies + sum(len(by[texts[j]]) for j in near[k]), len(near[k]), copies)
    return out


def found(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "_row long, _text string, key string")
    return {r["_row"]: (r["class_row"], r["n_links"], r["n_text_links"], r["n_copies"]) for r in jaccard_classes(docs, **how).collect()}


def corpus(seed, groups=12, of=14):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 30, 120, 400]))]
        for _ in range(r.randint(1, of)):
            w = list(base)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((n, " ".join(w) if r.random() < 0.7 else "  ".join(w).upper()))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "one"), (n + 4, "One")]


@pytest.mark.parametrize("seed, block", [(1, 1 << 19), (2, 300), (3, 1000)])
def test_against_all_pairs(spark, seed, block):
    rows = corpus(seed)
    assert found(spark, rows, block=block) == brute(rows)


def test_one_large_group_loses_no_link(spark):
    r = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(700):
        w = list(base)
        w[r.randrange(200)] = f"new{k % 350}"
        rows.append((k, " ".join(w)))
    assert found(spark, rows, block=4000) == brute(rows)


@pytest.fixture
def lengths(monkeypatch):
    """The prefix lengths that a join matched, in order."""
    seen = []
    real = J._members
    monkeypatch.setattr(J, "_members", lambda texts, length, *rest: (seen.append(length), real(texts, length, *rest))[1])
    return seen


def pairs_of(share, n, words=200, seed=4):
    """n pairs of texts whose sets of shingles have about ``share`` in common."""
    r = random.Random(seed)
    rows, cut = [], round(words * (1 - share) / (1 + share))
    for k in range(n):
        base = [f"p{k}w{r.randrange(10**6)}" for _ in range(words)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[: words - cut], *(f"q{k}x{x}" for x in range(cut))]))]
    return rows


@pytest.mark.parametrize("share, wanted", [(0.96, [7]), (0.806, [7, 6])])
def test_prefixes_are_shortened_as_the_links_found_tell(spark, lengths, share, wanted):
    rows = pairs_of(share, 40)
    assert found(spark, rows) == brute(rows)
    assert lengths == wanted


def test_other_thresholds_shorten_further(spark, lengths):
    rows = pairs_of(0.55, 30)
    assert found(spark, rows, threshold=0.5) == brute(rows, 0.5)
    assert lengths == [7, 6, 5, 4, 3, 2]


def test_no_pair_is_counted_twice_over_rounds(spark, lengths):
    rows = [*corpus(7), *((1000 + k, t) for k, t in pairs_of(0.806, 40))]
    assert found(spark, rows, block=500) == brute(rows)
    assert lengths == [7, 6]


def test_recall_is_estimated_by_what_was_found():
    assert J.estimated_recall(np.zeros(20), 0.8, 32, 7) == 1.0
    low, high = np.zeros(20), np.zeros(20)
    low[0], high[-1] = 100, 100
    assert J.estimated_recall(low, 0.8, 32, 7) == pytest.approx(J.meeting(0.8, 32, 7))
    assert J.estimated_recall(high, 0.8, 32, 7) > 0.999999


def test_minima_agree_as_often_as_sets_do():
    r = np.random.default_rng(0)
    every = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = round(1000 * (1 - share) / (1 + share))
        a, b = (J.signature(np.unique(every[k : 1000 + k]), 4000) for k in (0, n))
        assert abs(np.mean(a == b) - share) < 0.05


def test_edges_of_tables(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, "a b"), (2, None)]) == {1: (1, 0, 0, 0), 2: (2, 0, 0, 0)}
    repeated = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c")], "_row long, _text string")
    assert Counter((r["_row"], r["class_row"], r["n_copies"]) for r in jaccard_classes(repeated).collect()) == {(1, None, 2): 2, (None, None, 2): 1}


def test_components(spark, monkeypatch):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(120)] + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(50)] + [(2000, 2000 + k) for k in range(1, 80)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    for bound in (512, 7):
        monkeypatch.setattr(C, "HUB_LINKS", bound)
        got = {row["node"]: row["root"] for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: top(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_text_links"], r["n_copies"]) for r in op6_jaccard_forest(spark, sf_dir).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("one, other", [(0, 65535), (0, 1), (32767, 32768), (65534, 65535), (0, 0), (65535, 65535), (32768, 32768)])
def test_shortened_prefixes_count_where_children_differ(spark, one, other):
    marks = [np.array([7, v], ">u2").tobytes() for v in (one, other)] + [np.array([8, 9], ">u2").tobytes()]
    texts = spark.createDataFrame([(bytes([k]), k, 1, bytearray(m), 5) for k, m in enumerate(marks)], "_node binary, _row long, _weight long, _marks binary, _size long")
    rows = J._members(texts, 1, 2, 1, 1 << 19).collect()
    assert sorted(r["_row"] for r in rows) == ([0, 1] if one != other else [])


def test_one_shuffle_of_the_forest_tells_of_two_prefix_lengths(spark):
    schema, trees, depth = "_node binary, _row long, _weight long, _marks binary, _size long", 2, 3
    values = np.random.default_rng(3).integers(0, 4, (90, trees, depth)).astype(">u2")
    texts = spark.createDataFrame([(bytes([k]), k, 1, bytearray(v.tobytes()), 5) for k, v in enumerate(values)], schema)
    near = J._near(texts, depth - 1, depth, trees)
    got = sorted((r["_n"], r["_alike"], r["_apart"]) for r in near.collect())
    want = []
    for t in range(trees):
        for k in range(len(values)):
            below = (values[:, t, : depth - 1] == values[k, t, : depth - 1]).all(1)
            alike = int((below & (values[:, t, depth - 1] == values[k, t, depth - 1])).sum())
            if below.sum() > 1:
                want.append((int(below.sum()), alike, alike < below.sum()))
    assert got == sorted(want)
    assert near._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    # no two of all values count as one child
    every = spark.range(65536).selectExpr("encode(string(id), 'UTF-8') AS _node", "unhex('0007' || lpad(hex(id), 4, '0')) AS _marks")
    assert J._near(every, 1, 2, 1).selectExpr("max(_alike)", "min(_n)", "count(*)").first()[:] == (1, 65536, 65536)
