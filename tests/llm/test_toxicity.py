"""Toxicity: restoring disguised words, held-out accuracy, what may not enter a score, odd tables."""

from __future__ import annotations

import itertools
import time
import zlib

import numpy as np
import pytest

from skimmer.llm import toxicity as X


@pytest.fixture(scope="module")
def restorer():
    counts = np.zeros(X.CODES**3)
    words = ("the a letter reader wonderful people stupid garbage idiot moron with about their trash you are is not and house green little " * 50).split()
    c = X.codes_of("\n\n" + "\n\n".join(words) + "\n")
    keep = np.ones(len(c), bool)
    keep[2:] = (c[2:] != 0) | (c[1:-1] != 0)
    c = c[keep]
    np.add.at(counts, (c[:-2] * X.CODES + c[1:-1]) * X.CODES + c[2:], 1)
    return X.Restorer(X.language_model(counts))


@pytest.mark.parametrize("token, words", [("stupid", ["stupid"]), ("stup1d", ["stupid"]), ("s+upid", ["stupid"]), ("g@rb4ge", ["garbage"]), ("sssstuuuupid", ["stupid"]), ("st.up.id", ["stupid"]), ("tr4$h!!", ["trash"]), ("house,", ["house"]), ("2024", []), ("...", []), ("idi0t", ["idiot"])])
def test_restoring(restorer, token, words):
    assert restorer.words(token) == words or words in restorer.readings(token)


@pytest.mark.parametrize("token", ["st1p1d", "i d i o t", "mo ron", "aab-b", "1d10t", "g@rb", "a*b", "t r 4 s h"])
def test_decoding_is_exact(restorer, token):
    """Against all paths through the lattice."""
    ended: dict[str, float] = {}
    for path in itertools.product(*(restorer.ways(token, k, -0.5) for k in range(len(token)))):
        text, a, b, score = "", 0, 0, 0.0
        for c, cost in path:
            score += cost
            if c and not (c == " " and not b):
                code = 0 if c == " " else int(X.codes_of(c)[0])
                score, a, b, text = score + float(restorer.model[a, b, code]), b, code, text + c
        score += float(restorer.model[a, b, 0]) if b else 0.0
        ended[text] = max(score, ended.get(text, -1e9))
    best = max(ended.values())
    order = [t for t in sorted(ended, key=lambda t: (-ended[t], t)) if ended[t] >= best - X.MARGIN][: X.PATHS]
    got = restorer.decode(token)
    assert len(got) == len(order) and all(abs(ended[x] - ended[y]) < 1e-9 for x, y in zip(got, order))


def test_long_tokens_are_decoded_whole(restorer):
    token = "the_m0r0n_" * 3000 + "stup1d"
    assert restorer.decode(token)[0].split() == ["the", "moron"] * 3000 + ["stupid"]
    start = time.time()
    assert len(restorer.decode("edin " * 20_000)) == X.PATHS and restorer.readings("a1" * 50_000)
    assert time.time() - start < 60


def test_spaced_letters_are_one_stretch(restorer):
    import pyarrow as pa

    tokens, index, first = X.tokens_of(pa.array(["you are s t u p i d today", "a b", None, "i d i o t"]), restorer)
    rows = [[w for k in index[a:b] for w in restorer.words(tokens[k])] for a, b in zip(first[:-1], first[1:])]
    assert rows[0] == ["you", "are", "stupid", "today"] and rows[3] == ["idiot"] and rows[1] == ["a", "b"] and rows[2] == []


def _said(restorer, text):
    import pyarrow as pa

    tokens, index, _ = X.tokens_of(pa.array([text]), restorer)
    return [w for k in index for w in restorer.words(tokens[k])]


@pytest.mark.parametrize("text, words", [
    ("s  t  u  p  i  d", ["stupid"]), ("s t  u p\ni d", ["stupid"]), ("s.t.u.p.i.d!", ["stupid"]), ("you s t u p 1 d.", ["you", "stupid"]), ("y o u m o r o n", ["you", "moron"]), ("y-o-u a r e s t u p i d", ["you", "are", "stupid"]), ("their idi ot with", ["their", "idiot", "with"]), ("the mo ron is", ["the", "moron", "is"]),
    ("morron", ["moron"]), ("sstupid", ["stupid"]), ("little green letter", ["little", "green", "letter"]), ("you are not the", ["you", "are", "not", "the"]),
    ("with_about_house_people_reader_green_m0r0n_letter", ["moron"]),
])
def test_spaces_doubles_and_long_tokens_are_decoded(restorer, text, words):
    said = _said(restorer, text)
    assert said == words or "_" in text and set(words) <= set(said)


def test_tokens_that_no_mark_fits_tell_nothing(restorer):
    worth = {"=stupid": 3.0, "mor*": 1.0, "tras*": 2.0, "=at": 1.0}
    heads = X.Heads(worth)
    tokens = ["stupid", "house", "greenn", "at", "a", "", "étudiant", "st1p", "moron.", "y o u", "zebra", "ss", "tra", "\"house,", "(tra)", "stupid'", "x.tra", "...", "tra!!"]
    assert heads.among(tokens) == [k for k, t in enumerate(tokens) if heads.fit(t)]
    for token in ["stupid", "sstupid", "stuppid", "moron", "morron", "mmorrons", "trash", "traash", "letter", "greenn", "at", "att", "st1p", "y o u", "house", "aat", "ssttuuppiidd", "mooron", "stu pid", "mor on", "s tupid", "sstu pid", "the house", "tr ash", "a t", "mo r on", "stup pid"]:
        told = max(sum(max(worth.get(m, 0.0) for m in X.marks(w)) for w in words) for words in restorer.readings(token))
        assert heads.fit(token) or told == 0, token


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in X.op9_toxicity(spark, d).collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    own = [(labels[k], r["score"]) for k, r in got.items() if r["held_out"] and labels.get(k) is not None]
    plus, minus = [s for t, s in own if t == 1], [s for t, s in own if t == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in plus for b in minus]) if plus and minus else 1.0
    assert auc >= 0.8
    assert np.mean([s >= 0.5 for s in minus]) <= 0.05


def test_only_the_text_enters_a_score(spark):
    texts = ["you are stupid garbage people"] * 8 + ["the little house is green"] * 40
    docs = spark.createDataFrame([(k, f"{t} {k}", "en" if k % 2 else None, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(k, int(k < 8)) for k in range(48)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    again = spark.createDataFrame([(k + 1000, f"{t} {k}") for k, t in enumerate(texts)], "doc_id long, text string")
    first = {r["text"]: r["s"] for r in docs.select("text", X.scorer(model)("text").alias("s")).collect()}
    second = {r["text"]: r["s"] for r in again.select("text", X.scorer(model)("text").alias("s")).collect()}
    assert first == second


def test_edges_of_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "word", None), (2, "word", None)], "doc_id long, text string, held_out string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    got = X.score_toxicity(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert X.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_words_with_accents_and_parted_words_are_told_apart_quickly(monkeypatch):
    heads, calls = X.Heads({"=stupid", "idio*", "=éclat", "=moron"}), []
    fit = X.Heads.fit
    monkeypatch.setattr(X.Heads, "fit", lambda self, token: calls.append(token) or fit(self, token))
    assert heads.among(["écran", "naïve", "été", "«ü»", "éclat,", "zz", ""]) == [3, 4] and calls == ["«ü»", "éclat,", "zz", ""]
    calls.clear()
    assert heads.among(["st up id", "ab cd", "mo ro n", "x st", "a b c d"]) == [0, 2] and len(calls) == 5  # no call for each of the words in them
    assert [heads.fit(t) for t in ("iddiotic", "sttupid", "stuppid", "bookkeeper", "mmoorroonn", "aabbcc dd")] == [True, True, True, False, True, False]


def test_beginnings_rule_out_no_word_that_fits():
    r = np.random.default_rng(1)
    heads = X.Heads({"=abab", "aab*", "=bba", "abba*", "=cabb"})

    def fits(token):
        at, words = [k for k in range(len(token) - 1) if token[k] == token[k + 1]], {token}
        for k in reversed(at):
            words |= {w[:k] + w[k + 1 :] for w in words}
        return any(not heads.names.isdisjoint(X.marks(w)) for w in words)

    tokens = ["".join(r.choice([*"abc"], r.integers(1, 9))) for _ in range(4000)]
    assert all(heads.fit(t) for t in tokens if fits(t)) and not all(heads.fit(t) for t in tokens)
    parts = [" ".join("".join(r.choice([*"abc"], r.integers(1, 4))) for _ in range(r.integers(2, 5))) for _ in range(2000)]
    for p in parts:
        own = p.split(" ")
        assert heads.fit(p) or not any(fits("".join(own[i:j])) for i in range(len(own)) for j in range(i + 1, len(own) + 1))
