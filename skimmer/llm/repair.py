"""Token-ID / binary output (operator 5): shards compressed by Re-Pair grammars.

Documents are encoded in ascending id order and cut into shards. In a shard the most frequent id pairs
are replaced by nonterminals again and again; what is left, the rules and the length of each rule's
expansion are stored in one binary record. A document, or any range of a shard's ids, is decoded
without the rest of the shard.

A record: magic ``RPG1``; six little-endian u64 (first nonterminal, rules, symbols, documents, ids, bytes of a symbol: 2
or 4); rules as u32 pairs; expansion lengths as u32; symbols; per document: id as i64, null flag as u8, first symbol as u64, first id as u64.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skimmer.llm.bpe import CHUNK_BYTES, encoder
from skimmer.llm.shared import give_back, scratch_path, slices, small_batches, written

MAGIC = b"RPG1"
END_ID = 0
#: Ids of a shard, about.
SHARD_IDS = 1 << 20
#: Pairs that a round replaces together, at most, and how often a pair must occur to save more than its rule takes: 12 bytes.
ROUND_PAIRS, LEAST = 1024, 8


def grammar(ids: np.ndarray, first_of: np.ndarray, base: int, round_pairs: int = ROUND_PAIRS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, rules, expansion lengths, first symbol of each document).

    A round takes the most frequent pairs, at most ``round_pairs``, no two of which could claim the same id:
    of each chain of overlapping places every second is replaced. Rounds end when no pair occurs ``least`` times. Pairs do not cross document starts
    (``first_of``: ascending positions, one for each document), so that each document has symbols of its own.
    Ties go to the smaller pair. Fewer than two ids leave the input as it is.
    """
    # inside, symbols are numbered without gaps, so that pairs of them fit small integers
    used = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    number = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
    number[used] = np.arange(len(used))
    first_new = top = len(used)
    symbols = number.astype(np.int32).take(ids)
    n_ids = len(symbols)
    starts = np.asarray(first_of, np.int64)
    rules, lengths = [], np.ones(first_new, np.int64)
    # a symbol that went into the one before it stays as a gap: each knows the places beside it; place n_ids is outside
    after, before = np.arange(1, n_ids + 2, dtype=np.int32), np.arange(-1, n_ids, dtype=np.int32)
    before[:1] = n_ids
    gone, touched, ends = np.zeros(n_ids + 1, bool), np.zeros(n_ids + 1, bool), np.zeros(n_ids + 1, bool)
    ends[-1:] = True
    ends[n_ids - 1 : n_ids] = True
    ends[starts[(starts > 0) & (starts < n_ids)] - 1] = True
    # a pair comes up in one round, where a symbol is new, and from then on only loses places: its group of places is sorted once
    pair_of, n_of, begin = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)  # of each group: its pair, how many places are left, where they begin
    places, group = np.zeros(0, np.int32), np.full(n_ids + 1, -1, np.int32)  # the group of each place; -1: its pair is rare or gone
    new = np.flatnonzero(~ends[:-1])
    while len(new) or len(n_of):
        keys = symbols.take(new).astype(np.int64)
        keys *= top
        keys += symbols.take(after.take(new))
        bits = len(new).bit_length()
        if (top * top).bit_length() + bits <= 63:
            keys <<= bits  # the place beside its pair: one sort for both
            keys |= np.arange(len(new))
            keys.sort()
            order = keys & ((1 << bits) - 1)
            keys >>= bits
        else:
            order = np.argsort(keys, kind="stable")
            keys = keys.take(order)
        edge = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])[: len(keys)])
        n = np.diff(edge, append=len(keys))
        good = n >= least
        held = new.take(order.take(np.flatnonzero(np.repeat(good, n))))
        keys, n = keys.take(edge[good]), n[good]
        group[held] = np.repeat(np.arange(len(n_of), len(n_of) + len(n), dtype=np.int32), n)
        places = np.concatenate([places, held.astype(np.int32)])
        pair_of, n_of, begin = np.concatenate([pair_of, keys // top << 32 | keys % top]), np.concatenate([n_of, n]), np.concatenate([begin, begin[-1] + np.cumsum(n)])
        best = np.flatnonzero(n_of >= least)
        if not len(best):
            break
        if len(best) > round_pairs:
            best = best[np.lexsort((pair_of[best], -n_of[best]))[:round_pairs]]
        best = best[np.argsort(pair_of[best])]
        n = begin[best + 1] - begin[best]
        at = places.take(np.arange(n.sum()) + np.repeat(begin[best] - (np.cumsum(n) - n), n))
        rank = np.repeat(np.arange(len(best)), n)
        still = np.flatnonzero(group.take(at) == np.repeat(best, n))
        at = np.sort(at.take(still).astype(np.int64) << 20 | rank.take(still))  # by place
        at, where = at >> 20, at & ((1 << 20) - 1)
        head = np.flatnonzero(np.concatenate([[True], after.take(at[:-1]) != at[1:]]))
        even = np.flatnonzero((np.arange(len(at)) - np.repeat(head, np.diff(head, append=len(at)))) % 2 == 0)
        at, where = at.take(even), where.take(even)
        times = np.bincount(where, minlength=len(best))
        where = (np.cumsum(times > 0) - 1)[where]
        pairs = pair_of[best[times > 0]]
        pairs = np.stack([pairs >> 32, pairs & ((1 << 32) - 1)], 1)
        rules.append(pairs)
        lengths = np.concatenate([lengths, lengths[pairs].sum(1)])
        symbols[at] = top + where
        taken = after.take(at)
        gone[taken] = True
        ends[at] = ends.take(taken)
        follows = after.take(taken)
        after[at] = follows
        before[follows] = at
        touched[at] = True
        left = before.take(at)
        new = np.concatenate([at, left.take(np.flatnonzero(~touched.take(left)))])
        touched[at] = False
        lost = np.concatenate([new, taken])
        own = group.take(lost)
        n_of -= np.bincount(own[own >= 0], minlength=len(n_of))
        group[lost] = -1
        new = new.take(np.flatnonzero(~ends.take(new)))
        top += len(pairs)
    kept = np.flatnonzero(~gone[:-1])
    outside = np.concatenate([used, base + np.arange(top - first_new)])
    return (
        outside[symbols[kept]].astype("<u4"),
        (outside[np.concatenate(rules)] if rules else np.zeros((0, 2))).astype("<u4"),
        lengths[first_new:].astype("<u4"),
        np.searchsorted(kept, starts),
    )


def write_record(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The record of a shard: documents' ids one after another, ``counts`` of each."""
    counts = np.asarray(counts, np.int64)
    first = np.cumsum(counts) - counts
    base = int(ids.max()) + 1 if len(ids) else 1
    symbols, rules, lengths, starts = grammar(ids, first, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = struct.pack("<6Q", base, len(rules), len(symbols), len(counts), len(ids), width)
    own = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], "u1")
    return b"".join([MAGIC, head, rules.tobytes(), lengths.tobytes(), symbols.astype(f"<u{width}").tobytes(), own.tobytes(), null.tobytes(), starts.astype("<u8").tobytes(), first.astype("<u8").tobytes()])


class Record:
    """Reads a shard's record; ``document(k)`` and ``ids(a, b)`` expand only what they need."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a Re-Pair record")
        self.base, rules, symbols, docs, self.n_ids, width = struct.unpack_from("<6Q", raw, 4)
        at = 52
        parts = []
        for kind, n in (("<u4", 2 * rules), ("<u4", rules), (f"<u{width}", symbols), ("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", docs)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        self.rules, self.lengths, self.symbols, own, null, self.first_symbol, self.first_id = parts
        self.rules = self.rules.reshape(-1, 2)
        self.doc_ids = [None if z else d for d, z in zip(own.tolist(), null.tolist())]
        self._ends: np.ndarray | None = None

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.lengths):
            return np.ones(len(symbols), np.int64)
        own = symbols.astype(np.int64) - self.base
        return np.where(own < 0, 1, self.lengths[np.maximum(own, 0)]).astype(np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        out = symbols.astype(np.int64)
        while len(at := np.flatnonzero(out >= self.base)):
            wide = np.ones(len(out), np.int64)
            wide[at] = 2
            ends = np.cumsum(wide)
            new = np.repeat(out, wide)
            pair = self.rules[out[at] - self.base]
            new[ends[at] - 2], new[ends[at] - 1] = pair[:, 0], pair[:, 1]
            out = new
        return out.astype("<u4")

    def document(self, k: int) -> np.ndarray:
        end = self.first_symbol[k + 1] if k + 1 < len(self.first_symbol) else len(self.symbols)
        return self.expand(self.symbols[int(self.first_symbol[k]) : int(end)])

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the shard: the symbols that cover them are found by expansion length."""
        if self._ends is None:
            self._ends = np.cumsum(self._sizes(self.symbols))
        lo, hi = np.searchsorted(self._ends, a, "right"), np.searchsorted(self._ends, b, "left") + 1
        before = int(self._ends[lo - 1]) if lo else 0
        return self.expand(self.symbols[lo:hi])[a - before : b - before]

    def all_ids(self) -> np.ndarray:
        """Every rule is expanded once, then copied wherever it stands."""
        own = self.symbols.astype(np.int64) - self.base
        plain = own < 0
        texts = np.concatenate([self.expand(self.base + np.arange(len(self.rules))), self.symbols[plain].astype("<u4")])
        lengths = self.lengths.astype(np.int64)
        first, sizes = np.empty(len(own), np.int64), self._sizes(self.symbols)
        first[plain] = lengths.sum() + np.arange(plain.sum())
        first[~plain] = (np.cumsum(lengths) - lengths)[own[~plain]]
        step = np.ones(self.n_ids, np.int64)
        step[np.cumsum(sizes) - sizes] = first - np.concatenate([[0], first[:-1] + sizes[:-1] - 1])[: len(first)]
        return texts.take(np.cumsum(step))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes ``docs``, in ascending id order with null first, as records in a table (part, shard, first_doc, n_docs, n_tokens, record).

    Range partitions hold ascending ids, and a partition writes a record whenever it has ``shard_ids`` ids.
    A document longer than that has a shard of its own size. Null text counts as empty: the end id alone. Documents with
    the same id stay next to each other, in order of their text. An empty table gives no record.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        own: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        n = 0

        def record() -> pa.RecordBatch:
            counts = np.concatenate(sizes)
            raw = write_record(own, np.concatenate(held), counts)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(own)], pa.int64()), "n_tokens": pa.array([int(counts.sum())], pa.int64()), "record": pa.array([raw], pa.binary())}
            )

        for batch in batches:
            for piece in slices(batch, batch.column(1), CHUNK_BYTES):
                ids, counts = enc.encode(piece.column(1))
                full = np.insert(ids, np.cumsum(counts), end_id)
                own += piece.column(0).to_pylist()
                held.append(full)
                sizes.append(counts + 1)
                n += len(full)
                if n >= shard_ids:
                    yield record()
                    own, held, sizes, n = [], [], [], 0
                    shard += 1
                    give_back()
        if own:
            yield record()

    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("_text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = narrow.repartitionByRange(parts, F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")
    ordered.mapInArrow(records, "part int, shard int, n_docs long, n_tokens long, record binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the table at ``path``: doc_id, start, n_tokens, ids_crc32, part, shard, decoded from the records.

    ``start`` adds up what the partitions, the shards of the partition and the documents of the shard
    before it hold; partitions and shards are a few rows of numbers each.
    """
    table = spark.read.parquet(path)
    totals = table.select("part", "shard", "n_tokens")
    parts = totals.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # one row for each partition that wrote
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("_n")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.withColumn("_in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0).cast("long"))).join(parts, "part").select("part", "shard", (F.col("_in") + F.col("_before")).alias("_start"))
    shards = written(shards, "shard-starts")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for part, shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                record = Record(raw.as_py())
                ids = record.all_ids()
                ends = [*record.first_id[1:].tolist(), record.n_ids]
                view, crc = memoryview(ids.tobytes()), []
                for a, b in zip(record.first_id.tolist(), ends):
                    crc.append(zlib.crc32(view[4 * a : 4 * b]))
                first = record.first_id.astype(np.int64)
                n = len(crc)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "doc_id": pa.array(record.doc_ids, pa.int64()),
                        "_first": pa.array(first), "n_tokens": pa.array(np.array(ends, np.int64) - first), "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    rows = table.select("part", "shard", "record").mapInArrow(documents, "part int, shard int, doc_id long, _first long, n_tokens long, ids_crc32 long")
    return rows.join(shards, ["part", "shard"]).select("doc_id", (F.col("_start") + F.col("_first")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def op5_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "repair")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(spark, path)
