"""Packing: sequences are whole, gapless and few; the encoder equals the library; odd tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skimmer.llm import packing as K
from skimmer.llm.bpe import PieceEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(8))
def test_plan_holds_each_piece_once_and_few_sequences(seed):
    r = random.Random(seed)
    capacity = [64, 4096, 100, 4096][seed % 4]
    lengths = Counter(min(capacity, max(1, int(r.lognormvariate(5 if capacity > 200 else 3, 1.2)))) for _ in range(r.choice([1, 5, 3000, 20_000])))
    runs = K.plan_packing(lengths, capacity)
    held = Counter()
    for own, n in runs:
        assert n > 0 and own and sum(own) <= capacity
        for x in own:
            held[x] += n
    assert held == lengths
    least = -(-sum(k * n for k, n in lengths.items()) // capacity)
    assert sum(n for _, n in runs) <= max(least + 2, 1.02 * least) or seed % 4 == 2 and sum(n for _, n in runs) <= 1.06 * least + 2
    assert K.plan_packing({}) == []


def test_least_squares_is_not_negative():
    r = np.random.default_rng(0)
    for _ in range(20):
        a, x = r.random((12, 8)), np.maximum(r.normal(size=8), 0)
        found = K.nonnegative_least_squares(a, a @ x)
        assert (found >= 0).all() and np.allclose(a @ found, a @ x, atol=1e-6)


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    out = []
    for doc_id, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(doc_id, k, k * 4096, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(4096, len(ids), 4096)))]
    return Counter(out)


def check(rows, got):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected(rows)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r["length"] for r in got) // 4096)
    assert len(by) <= 1.05 * least + 2


def test_table_of_documents(spark):
    rows = [(1, "word " * 9000), (1, "word " * 9000), (2, None), (None, "no id"), (3, ""), *((k, f"text number {k} " * (k % 50)) for k in range(10, 400)), (7, "Naïve <|endoftext|> \x01 İ ß\n\n  漢字")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int")
    first = K.best_fit_packing(docs, PATH).collect()
    check(rows, first)
    again = K.best_fit_packing(docs.repartition(3), PATH).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    assert K.best_fit_packing(docs.limit(0), PATH).count() == 0


def test_query_over_all_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, K.op10_pattern_packing(spark, sf_dir).collect())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    r = random.Random(8)
    signs = ["a", "B", "é", "É", "ß", "İ", "ı", "漢", "1", "²", ".", ",", "'", "'s", "'LL", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x01", " ", "​", "́", "<|endoftext|>", "</w>", "word", "Word", "_", "-", "$", "😀", "ǅ", "ﬁ", "À", " "]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    ids, counts = PieceEncoder(path).encode(pa.array([*texts, None]))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, own in zip([*texts, ""], parts):
        assert own.tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
