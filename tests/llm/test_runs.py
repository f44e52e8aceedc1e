"""Periodic runs against looking at every period of every text."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from skimmer.llm import runs as K

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words):
    """All maximal stretches of every period, less those with a smaller one."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        k = 0
        while k < n - q:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            length = k - start + q
            own = words[start : start + length]
            if length >= max(6, 4 * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def fast_runs(words):
    names = {}
    codes = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    return K.text_runs(codes, K.recurrences(codes, np.zeros(len(codes), np.int64)))


def made(r):
    """Words with nested and neighbouring repetitions."""
    out = []
    while len(out) < r.choice([0, 5, 30, 120, 300]):
        kind = r.random()
        if kind < 0.3:
            out += [r.choice("abc") for _ in range(r.randint(1, 9))]
        elif kind < 0.8:
            unit = [r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13, 21]))]
            n = int(len(unit) * r.choice([3.9, 4, 4.5, 5, 7, 12]))
            out += (unit * 13)[:n]
        elif out:
            a = r.randrange(len(out))
            out += out[a:] * r.choice([1, 3, 4])
        out = out[:400]
    return out


def test_runs_of_every_short_text():
    for n in range(0, 13):
        for code in range(2**n):
            words = [code >> k & 1 for k in range(n)]
            assert fast_runs(words) == slow_runs(words), words


@pytest.mark.parametrize("seed", range(12))
def test_runs_against_every_period(seed, monkeypatch):
    monkeypatch.setattr(K, "KEY_WORDS", [1 << 14, 16][seed % 2])
    r = random.Random(seed)
    for _ in range(40):
        words = made(r)
        assert fast_runs(words) == slow_runs(words), words


def test_long_texts_take_time_in_proportion():
    r = random.Random(1)
    unit = [r.randrange(50) for _ in range(5000)]
    texts = [[1] * 60_000, [1, 2, 3] * 20_000, unit * 12, ([7] * 6 + [8] * 6) * 5000, [*range(60_000)], [r.randrange(2) for _ in range(60_000)], ([5] * 4999 + [6]) * 12]
    begin = time.perf_counter()
    found = [fast_runs(words) for words in texts]
    assert time.perf_counter() - begin < 60
    assert found[0] == [(0, 60_000, 1)] and found[1] == [(0, 60_000, 3)] and found[4] == []
    assert (0, 60_000, 5000) in found[2] and len(found[3]) == 10_001 and (0, 60_000, 12) in found[3]
    assert sorted(found[6]) == sorted([(0, 60_000, 5000)] + [(k * 5000, 4999, 1) for k in range(12)])


def planted(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = slow_runs(words)
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    left = " ".join(w for k, w in enumerate(words) if k not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(lines), sha(left))


def got(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


def test_odd_tables(spark, tmp_path):
    r = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (None, "a a a a a a a"), (None, None), (4, "b " * 4000), (4, "b " * 4000), (5, "a a a a a"), (6, "x\x0by x\x0cy x\ry x\ty x y"), (7, "\x1c a\x1c \xa0 " * 9)]
    rows += [(k, " ".join(made(r))) for k in range(10, 150)]
    spark.createDataFrame([(*x, "y", [1]) for x in rows], "doc_id long, text string, collapsed string, runs array<int>").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(K.op12_periodic_runs(spark, str(tmp_path))) == sorted((expected(*x) for x in rows), key=repr)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert K.periodic_runs(docs.limit(0)).count() == 0
    plain = {r["doc_id"]: r for r in K.periodic_runs(docs.where("doc_id IN (2, 4, 5)")).collect()}
    assert plain[4]["collapsed"] == "b" and [tuple(x) for x in plain[4]["runs"]] == [(0, 4000, 1)] and plain[4]["n_words"] == 4000
    assert plain[5]["collapsed"] == "a a a a a" and plain[5]["runs"] == [] and plain[2]["collapsed"] == ""


def test_query_over_all_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r[0]: r for r in got(K.op12_periodic_runs(spark, sf_dir))}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        if len(WORDS.findall(text or "")) < 1500:  # the slow way takes squares
            assert found[doc_id] == expected(doc_id, text)
