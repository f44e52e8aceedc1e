"""Re-Pair shards: exact round trips, random access, order and starts, odd tables."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skimmer.llm import repair as R

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(12))
def test_round_trip_and_random_access(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, [3, 10, 50_000][seed % 3], 400)
    counts = r.integers(0, 300, 30) if seed else np.zeros(0, int)
    ids = np.concatenate([np.resize(np.roll(base, int(k)), n) for k, n in enumerate(counts)] or [np.zeros(0)]).astype("<u4")
    own = [None if k == 3 else k * 5 for k in range(len(counts))]
    record = R.Record(R.write_record(own, ids, counts))
    assert (record.all_ids() == ids).all() and record.doc_ids == own
    ends = np.cumsum(counts)
    for k, n in enumerate(counts):
        assert (record.document(k) == ids[ends[k] - n : ends[k]]).all()
    for _ in range(40 if len(ids) else 0):
        a, b = sorted(r.integers(0, len(ids) + 1, 2).tolist())
        assert a == b or (record.ids(a, b) == ids[a:b]).all()


def test_grammar_is_smaller_and_honest():
    ids = np.resize(np.arange(64), 64 * 200).astype("<u4")
    symbols, rules, lengths, _ = R.grammar(ids, np.zeros(1, int), 64)
    assert len(symbols) + 2 * len(rules) < len(ids) / 8
    known = {}
    for k, (a, b) in enumerate(rules.tolist()):
        known[64 + k] = known.get(a, 1) + known.get(b, 1)
        assert lengths[k] == known[64 + k]
    runs = np.full(1000, 7, "<u4")
    assert (R.Record(R.write_record([0], runs, np.array([1000]))).all_ids() == runs).all()
    with pytest.raises(ValueError):
        R.Record(b"nope")


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def read(spark, rows, tmp_path, **how):
    path = f"file://{tmp_path}/shards"
    R.write_shards(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int"), path, PATH, **how)
    return [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in R.read_shards(spark, path).orderBy("start").collect()]


@pytest.mark.parametrize("shard_ids", [1, 50, 1 << 20])
def test_table_round_trip(spark, tmp_path, shard_ids):
    rows = [(5, "hello world"), (1, None), (None, "no id"), (3, ""), (9, "word " * 3000), (7, "naïve <|endoftext|> \x01 \x00 text\n\n\n  end "), (7, "again"), (7, "again"), (-4, "漢字 123")]
    assert read(spark, rows, tmp_path, shard_ids=shard_ids) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert read(spark, [], tmp_path) == []


def test_query_against_the_library(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = R.op5_repair_shards(spark, sf_dir).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == expected(rows)


def rounds(ids, first_of, round_pairs, least):
    """The rounds of ``grammar`` as they are told, over all symbols each time: how many there are, and what is left as nested pairs."""
    owner = np.searchsorted(first_of, np.arange(len(ids)), "right")
    symbols, n_rules, top = list(zip(ids.tolist(), owner.tolist())), 0, int(ids.max()) + 1
    while True:
        pairs = [(a[0], b[0]) if a[1] == b[1] else None for a, b in zip(symbols, symbols[1:])]
        n = {}
        for p in pairs:
            if p:
                n[p] = n.get(p, 0) + 1
        best = sorted(sorted((p for p in n if n[p] >= least), key=lambda p: (-n[p], p))[:round_pairs])
        if not best:
            return [s for s, _ in symbols], n_rules
        hits, used = [k for k, p in enumerate(pairs) if p in set(best)], set()
        for k in hits:
            if k - 1 not in used:
                used.add(k)
        names = {p: top + k for k, p in enumerate(p for p in best if any(pairs[u] == p for u in used))}
        symbols = [(names[pairs[k]], s[1]) if k in used else s for k, s in enumerate(symbols) if k - 1 not in used]
        n_rules, top = n_rules + len(names), top + len(names)


@pytest.mark.parametrize("seed", range(6))
def test_looking_only_where_something_changed_gives_the_same_grammar(seed):
    r = np.random.default_rng(seed)
    counts = r.integers(0, 60, 12) + 1
    first = np.cumsum(counts) - counts
    ids = np.resize(r.integers(0, [2, 5, 12][seed % 3], 90), counts.sum()).astype("<u4")
    ids[: len(np.unique(ids))] = np.arange(len(np.unique(ids)))
    base = int(ids.max()) + 1
    symbols, rules, _, _ = R.grammar(ids, first, base, 3, 4)
    assert (symbols.tolist(), len(rules)) == rounds(ids, first, 3, 4)


def test_units_go_to_the_model_in_one_call():
    from skimmer.llm.bpe import PieceEncoder

    import pyarrow as pa

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own, library = PieceEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        library.encode_special_tokens = True
        calls, lines = [], own._units
        own._units = lambda units: calls.append(len(units)) or lines(units)
        texts = ["Some plain words and naïve élan", "ªº µm ß 漢字 mixed1 <|endoftext|>", "", "a" * 5000, "x\ny \x01 z"]
        ids, n = own.encode(pa.array(texts))
        want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == sum(want, []) and n.tolist() == [*map(len, want)] and len(calls) == 1 and calls[0] > 4


def test_pieces_met_again_stay_remembered_when_others_go(monkeypatch):
    from skimmer.llm import bpe

    import pyarrow as pa

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
        own, library = bpe.PieceEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        asked, lines = [], own._units
        own._units = lambda units: asked.extend(map(str, units)) or lines(units)
        letters = np.array(list("abcdefghij"))
        for k in range(12):
            rare = ["".join(letters[[int(c) for c in str(k * 1000 + j)]]) for j in range(1000, 1100)]
            text = " usual " + " ".join(rare) + " usual"
            ids, n = own.encode(pa.array([text, "z" * 400]))
            want = [x.ids for x in library.encode_batch([text, "z" * 400], add_special_tokens=False)]
            assert ids.tolist() == sum(want, []) and n.tolist() == [*map(len, want)]
        assert sum(w.strip() == "usual" for w in asked) == 1 and len(asked) > 1000
        assert own.pieces.nbytes + own.ids.nbytes <= 20_000
