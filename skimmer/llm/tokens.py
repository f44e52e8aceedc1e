"""Token counts (operator 11): pieces are counted once for each distinct pre-token.

A first pass gathers the distinct pre-tokens of all texts; each is cut into pieces once. A second pass takes each
document's pre-token frequencies to that dictionary and sums frequency times pieces: no token id is ever made for a
text. Pre-tokens with at least one in ``SHARE`` of all occurrences are at most ``SHARE``, so those meet a broadcast part of the
dictionary; the others meet the whole of it in a shuffle, where none of them can be hot.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.llm.bpe import _BYTES, _SIGN, _opening
from skimmer.llm.shared import Kept, slices, small_batches, written

LIMIT = 2048
#: The dictionary's entries with at least one in so many of all occurrences are broadcast: at most as many, of 20 bytes each (40 MB).
SHARE = 1 << 21
#: Longer pre-tokens meet the dictionary by a digest.
LONGEST = 64
CACHE_BYTES = 48 << 20
CHUNK_BYTES = 2 << 20
#: A pre-tokenizer that always cuts between a letter and a sign, and keeps letters together.
WORDS_AND_SIGNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PreTokens:
    """The pre-tokens of texts, as one tokenizer file cuts them.

    Strings of added tokens are found first, as the library does by default, and are one token each. If the tokenizer drops
    white space, texts are cut there and each different part goes through its normalizer and pre-tokenizer once; otherwise whole texts do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        added = made["added_tokens"]
        odd = [t["content"] for t in added if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
        if odd or self.tokenizer.pre_tokenizer is None:
            raise ValueError(f"pre-tokens of {path} depend on more than themselves: {odd or 'no pre-tokenizer'}")
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, contents)) + ")" if contents else r"(?!)()")
        self.drops_space = not any(re.search(r"\s", c) for c in contents) and self._cut("a b \n c") == [*self._cut("a"), *self._cut("b"), *self._cut("c")]
        steps = [x.get("pattern", {}).get("Regex") or x["type"] for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        forms = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        #: letters are cut from signs beforehand, and Latin words are their own lower case
        self.plain = steps == [WORDS_AND_SIGNS, "ByteLevel"] and forms == ["NFC", "Replace", "Lowercase"]
        self.uncut = "|".join([r"\x01", _opening(), *("".join(rf"\x{{{ord(c):x}}}" for c in x) for x in contents)])
        self.known: dict[str, tuple[str, ...]] = Kept(CACHE_BYTES)

    def _cut(self, text: str) -> list[str]:
        normalizer, parts = self.tokenizer.normalizer, self.added.split(text)
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append("")  # an added token
            elif part:
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normalizer.normalize_str(part) if normalizer else part) if p]
        return out

    def of(self, text: str) -> tuple[str, ...]:
        """The pre-tokens of ``text`` in order; an empty string stands for an added token."""
        if self.plain and text.isalpha():
            if text.isascii():
                return (text.lower(),)
            if max(text) < "\u0100":
                return (text.lower().encode().decode("latin-1").translate(_BYTES),)
        found = self.known.get(text)
        if found is None:
            found = tuple(self._cut(text))
            self.known.keep(text, found, 60 * len(found) + 2 * len(text))
        return found

    def counted(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens, and by (text, pre-token) that occur: place of the text, place of the pre-token, how often."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.drops_space:
            cut = pc.replace_substring_regex(texts, r"[\t\n\r]", " ")
            if self.plain:
                cut = pc.if_else(pc.match_substring_regex(texts, self.uncut), cut, pc.replace_substring_regex(cut, _SIGN, r"\1 \2"))
            lists = pc.split_pattern(cut, " ")
            coded = pc.dictionary_encode(pc.list_flatten(lists))
            parts, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            words = np.diff(lists.offsets.to_numpy())
        else:
            parts, index, words = texts.to_pylist(), np.arange(len(texts)), np.ones(len(texts), np.int64)
        own: dict[str, int] = {}
        cut = [[own.setdefault(p, len(own)) for p in self.of(x)] for x in parts]
        held = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter((k for x in cut for k in x), np.int64, int(held.sum()))
        first = np.cumsum(held) - held
        doc = np.repeat(np.arange(len(words)), words)
        # (text, part) first, so that what a part holds is laid out once for each text
        pair, times = np.unique(doc * max(1, len(parts)) + index, return_counts=True)
        doc, part = np.divmod(pair, max(1, len(parts)))
        n = held[part]
        ends = np.cumsum(n)
        at = flat[np.repeat(first[part] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        code, place = np.unique(np.repeat(doc, n) * max(1, len(own)) + at, return_inverse=True)
        total = np.bincount(place, np.repeat(times, n), len(code)).astype(np.int64)
        doc, at = np.divmod(code, max(1, len(own)))
        return [*own], doc, at, total


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    """One for each worker process and file."""
    return PreTokens(path)


def _key(pre_token: str) -> str:
    return pre_token if len(pre_token) <= LONGEST else "\0" + hashlib.sha256(pre_token.encode()).hexdigest()


def piece_counts(docs: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """The distinct pre-tokens of all texts: key, hash (128 bits), n (occurrences), pieces. Null texts have none; an added token's key is empty."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pre_tokens(tokenizer)
        for part in (part for batch in batches for part in slices(batch, batch.column(0), CHUNK_BYTES)):
            names, _, at, total = own.counted(part.column(0))
            n = np.bincount(at, total, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n)], names=["pre_token", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = pre_tokens(tokenizer).tokenizer.model.tokenize
        for batch in batches:
            names = batch.column(0).to_pylist()
            pieces = pa.array([len(tokenize(p)) if p else 1 for p in names], pa.int64())
            keys, hashes = pa.array(map(_key, names), pa.string()), pa.array(map(xxhash.xxh3_128_digest, names), pa.binary())
            yield pa.RecordBatch.from_arrays([keys, hashes, batch.column(1), pieces], names=["key", "hash", "n", "pieces"])

    small_batches(docs.sparkSession)
    found = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(gathered, "pre_token string, n long")
    return found.groupBy("pre_token").agg(F.sum("n").alias("n")).mapInArrow(cut, "key string, hash binary, n long, pieces long")


class Common:
    """The pieces of common pre-tokens, by 128-bit hash: one array of the first half, sorted, one of the second, one of pieces."""

    def __init__(self, table: pa.Table):
        halves = np.frombuffer(b"".join(table.column("hash").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        order = np.argsort(halves[:, 0], kind="stable")
        self.first, self.second = halves[order, 0], halves[order, 1]
        self.pieces = table.column("pieces").to_numpy()[order].astype(np.int32)

    def of(self, names: list[str]) -> np.ndarray:
        """The pieces of each pre-token; -1 for those that are not here, which also says one whose first half another entry has."""
        if not len(self.first):
            return np.full(len(names), -1, np.int32)
        halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names)), ">u8").astype(np.uint64).reshape(-1, 2)
        at = np.minimum(np.searchsorted(self.first, halves[:, 0]), len(self.first) - 1)
        return np.where((self.first[at] == halves[:, 0]) & (self.second[at] == halves[:, 1]), self.pieces[at], -1)


def pre_token_sums(docs: DataFrame, tokenizer: str, common, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: row (its number), doc_id, n_bytes, n (tokens of its pre-tokens that ``common``, a broadcast ``Common``, holds), rest (the others: key, times)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = pre_tokens(tokenizer), common.value
        for part in (part for batch in batches for part in slices(batch, batch.column(3), CHUNK_BYTES)):
            names, doc, at, total = own.counted(part.column(3))
            pieces = held.of(names)
            here = pieces[at] >= 0
            n = np.bincount(doc[here], (total * pieces[at])[here], len(part)).astype(np.int64)
            keys = pa.array([_key(names[k]) for k in at[~here].tolist()], pa.string())
            ends = np.cumsum(np.bincount(doc[~here], minlength=len(part)))
            rest = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.StructArray.from_arrays([keys, pa.array(total[~here])], ["key", "times"]))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n), rest], names=["row", "doc_id", "n_bytes", "n", "rest"])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return narrow.mapInArrow(summed, "row long, doc_id long, n_bytes long, n long, rest array<struct<key string, times long>>")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens), one row for each row of ``docs``.

    A null text counts as empty: no bytes, no tokens. A null id is kept as null. Repeated rows are counted each. Other columns are ignored, whatever their
    names; an empty table gives an empty one. Strings of added tokens inside a text are one token each. The tokenizer is a file of the tokenizers
    library with a pre-tokenizer; one whose added tokens strip space, ask for whole words or are sought in normal form raises ValueError.
    """
    spark = docs.sparkSession
    counts = written(piece_counts(docs, tokenizer, text_column), "pieces")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = spark.sparkContext.broadcast(Common(counts.where(F.col("n") * SHARE >= F.lit(total)).select("hash", "pieces").toArrow()))  # at most SHARE rows
    # rows are numbered as they are written, once: whoever reads the table sees the same numbers
    sums = written(pre_token_sums(docs, tokenizer, common, id_column, text_column), "token-sums")
    rest = sums.select("row", F.explode("rest").alias("x")).select("row", "x.key", "x.times").join(counts.select("key", "pieces"), "key")
    seldom = rest.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("times") * F.col("pieces")).alias("n"))
    whole = sums.select("row", "doc_id", "n_bytes", "n").unionByName(seldom).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents under word_bpe_49k.json."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
