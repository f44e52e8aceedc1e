"""Token counts equal the library's, text by text."""

from __future__ import annotations

import json
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skimmer.llm import tokens as K

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, path=PATH, limit=2048):
    tok = Tokenizer.from_file(path)
    n = [len(tok.encode(text or "", add_special_tokens=False).ids) for _, text in rows]
    return Counter((i, len((text or "").encode()), k, k > limit) for (i, text), k in zip(rows, n))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pre_tokens_add_up_to_the_library(name):
    path = public_tokenizers.path(name)
    tok, own, r = Tokenizer.from_file(path), K.PreTokens(path), random.Random(4)
    signs = ["a", "B", "é", "É", "ß", "İ", "ı", "Σ", "漢", "1", "²", ".", ",", "'", "'s", "'LL", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x01", "\0", "\x1c", "\x0b", "\x85", " ", "​", "́", "<|endoftext|>", "<|startoftext|>", "<|end", "</w>", "word", "_", "-", "$", "😀", "ǅ", "ﬁ", "À", " "]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    names, doc, at, total = own.counted(pa.array([*texts, None]))
    pieces = [len(own.tokenizer.model.tokenize(p)) if p else 1 for p in names]
    found = [0] * (len(texts) + 1)
    for d, k, n in zip(doc.tolist(), at.tolist(), total.tolist()):
        found[d] += n * pieces[k]
    for text, n in zip([*texts, ""], found):
        assert n == len(tok.encode(text, add_special_tokens=False).ids), repr(text)


def test_odd_tables(spark, monkeypatch):
    rows = [(1, "word " * 9000), (1, "word " * 9000), (2, None), (2, None), (None, "no id"), (None, "no id"), (None, None), (3, ""), (4, " \n\t "), (5, "x" * 70 + " " + "-" * 300 + " " + "x" * 70)]
    rows += [(k, f"text number {k} Überraschung " * (k % 50)) for k in range(10, 300)] + [(7, "Naïve <|endoftext|> \x01 İ ß\n\n  漢字<|startoftext|><|endoftext|>")]
    docs = spark.createDataFrame([(*r, "y", 5, b"z") for r in rows], "doc_id long, text string, row string, n int, n_bytes binary")
    for share in (K.SHARE, 20, 0):  # 20: most pre-tokens meet the dictionary in a shuffle, 0: all do
        monkeypatch.setattr(K, "SHARE", share)
        assert Counter(map(tuple, K.count_tokens(docs, PATH).collect())) == expected(rows)
        assert Counter(map(tuple, K.count_tokens(docs.repartition(3), PATH, limit=9).collect())) == expected(rows, limit=9)
    empty = K.count_tokens(docs.limit(0), PATH)
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and empty.count() == 0


def test_pieces_are_counted_once_for_each_pre_token(spark):
    docs = spark.createDataFrame([(k, f"Common words, {k} <|endoftext|>") for k in range(40)], "doc_id long, text string")
    found = K.piece_counts(docs.repartition(4), PATH).collect()
    assert len({r["key"] for r in found}) == len(found) == len({bytes(r["hash"]) for r in found})
    by = {r["key"]: (r["n"], r["pieces"]) for r in found}
    assert by["common"] == (40, 1) and by[""] == (40, 1) and by[","] == (40, 1)
    assert sum(n for n, _ in by.values()) == 40 * 4 + sum(len(str(k)) for k in range(40))


def test_tokens_that_depend_on_their_place_raise(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        made = json.load(file)
    made["added_tokens"][0]["lstrip"] = True
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(made))
    with pytest.raises(ValueError):
        K.PreTokens(str(path))


def test_query_over_all_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, K.op11_token_counts(spark, sf_dir).collect())) == expected(rows)
