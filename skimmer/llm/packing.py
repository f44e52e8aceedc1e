"""Best-fit packing (operator 10): patterns of few documents, fitted by non-negative least squares.

Documents become pieces of at most ``capacity`` tokens. The histogram of piece lengths (at most
``capacity`` rows, whatever the corpus) is all that the driver sees: it enumerates patterns of up to three
lengths that fill a sequence, fits how often each is used to the histogram, rounds down, and packs the
rest best-fit, also into what the patterns leave free. The outcome is a plan of slots by exact length;
executors number the pieces of each length, in salted groups, and look their slot up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skimmer.llm.bpe import CHUNK_BYTES, encoder
from skimmer.llm.shared import slices, small_batches, written

CAPACITY = 4096
END_ID = 1
#: Steps of length for which patterns are enumerated.
GRID = 128
#: Rows of one length that are numbered together.
GROUP_ROWS = 200_000


def token_pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32.

    Null text counts as empty and yields the end id alone. A null id is kept as null. Repeated rows are
    separate documents. Other columns are ignored, whatever their names.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in (part for batch in batches for part in slices(batch, batch.column(1), CHUNK_BYTES)):
            ids, counts = enc.encode(part.column(1))
            ends = np.cumsum(counts)
            own = np.empty(len(ids) + len(counts), "<u4")
            at = ends + np.arange(len(counts))
            keep = np.ones(len(own), bool)
            keep[at] = False
            own[keep], own[at] = ids, end_id
            raw, sizes = memoryview(own).cast("B"), counts + 1
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            first = ((at + 1 - sizes)[doc] + start) * 4
            crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(first.tolist(), (length * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        pieces, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """x >= 0 with small ||a x - b||: the active-set method on the normal equations."""
    gram, target = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = target - gram @ x
        slope[active] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-9 * max(1.0, float(np.abs(target).max())):
            break
        active[k] = True
        while True:
            own = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(own, own)], target[own], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[own] = z
                break
            low = z <= 0
            step = np.min(x[own][low] / np.maximum(x[own][low] - z[low], 1e-300))
            x[own] += step * (z - x[own])
            gone = own[(x[own] <= 1e-12)]
            if not len(gone):
                gone = own[low]
            x[gone], active[gone] = 0, False
            if not active.any():
                break
    return x


def patterns(units: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` steps with one to three lengths, longest first."""
    two = [(a, units - a) for a in range(units - 1, (units - 1) // 2, -1) if a >= units - a]
    three = [(a, b, units - a - b) for a in range(units - 2, 0, -1) for b in range(min(a, units - a - 1), 0, -1) if b >= units - a - b]
    return [(units,), *two, *three]


class _Stock:
    """How many pieces of each exact length are left, by grid step."""

    def __init__(self, histogram: dict[int, int], step: int):
        self.left = dict(histogram)
        self.by_step: dict[int, list[int]] = {}
        for length in sorted(histogram):
            self.by_step.setdefault(-(-length // step), []).append(length)

    def longest(self, k: int) -> int | None:
        """The longest length of step k that is left."""
        own = self.by_step.get(k, [])
        while own and not self.left[own[-1]]:
            own.pop()
        return own[-1] if own else None

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of a sequence, number of such sequences) that hold exactly the histogram's pieces.

    A run's lengths sum to at most ``capacity``. An empty histogram gives no runs. The number of runs
    depends on the number of different lengths, not of pieces.
    """
    histogram = {int(k): int(v) for k, v in histogram.items() if v > 0}
    assert all(0 < k <= capacity for k in histogram)
    grid = min(grid, capacity)
    step = -(-capacity // grid)
    stock, runs = _Stock(histogram, step), []
    ways = patterns(-(-capacity // step))
    a = np.zeros((grid + 1, len(ways)))
    for k, way in enumerate(ways):
        for part in way:
            a[part, k] += 1
    b = np.zeros(grid + 1)
    for length, n in histogram.items():
        b[-(-length // step)] += n
    usable = [k for k, way in enumerate(ways) if all(b[p] >= way.count(p) for p in way)]
    if usable:
        times = np.zeros(len(ways))
        times[usable] = nonnegative_least_squares(a[:, usable], b)
        for k in sorted(usable, key=lambda k: -times[k]):
            copies = int(times[k] + 1e-9)
            while copies > 0:
                own: list[int] = []
                for part in ways[k]:
                    length = stock.longest(part)
                    if length is None:
                        break
                    stock.take(length, 1)
                    own.append(length)
                for length in own:
                    stock.take(length, -1)
                if len(own) < len(ways[k]):
                    break
                n = min([copies, *(stock.left[x] // own.count(x) for x in own)])
                if n < 1:
                    # two parts want the last piece of a length: the next one down serves
                    break
                for length in own:
                    stock.take(length, n)
                runs.append((tuple(own), n))
                copies -= n
    return _best_fit(runs, {k: v for k, v in stock.left.items() if v}, capacity)


def _best_fit(runs: list[tuple[tuple[int, ...], int]], left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each piece to the fullest sequence that can take it; equal pieces and sequences go together."""
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(own: tuple[int, ...], n: int) -> None:
        room = capacity - sum(own)
        if room not in free:
            free[room] = []
            insort(rooms, room)
        free[room].append((own, n))

    for own, n in runs:
        put(own, n)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                    n %= each
                if n:
                    put((length,) * n, 1)
                break
            room = rooms[at]
            own, copies = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(at)
            each = room // length  # as many as fit, as long as there are enough for every copy
            if n >= copies:
                k = min(each, n // copies)
                put((*own, *(length,) * k), copies)
                n -= k * copies
            else:
                put((*own, length), n)
                put(own, copies - n)
                n = 0
    return [x for room in sorted(free) for x in free[room]]


def slots(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence, sequences between ranks (1), offset of each slot."""
    out: dict[int, list[list[int]]] = {}
    base = 0
    for own, n in runs:
        at = 0
        for length in own:
            rows = out.setdefault(length, [[], [], [], []])
            rows[0].append((rows[0][-1] + rows[3][-1]) if rows[0] else 0)
            rows[1].append(base)
            rows[2].append(at)
            rows[3].append(n)
            at += length
        base += n
    return {k: tuple(np.array(x, np.int64) for x in v) for k, v in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Every piece gets one place; places of a sequence are gapless from 0. Ties between pieces of one length
    go by doc_id, piece and checksum, so a rerun packs alike. An empty table gives an empty result.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    total = sum(counts.values())
    table = slots(plan_packing(counts, capacity))
    salts = max(1, -(-max(counts.values(), default=0) // GROUP_ROWS)) * 16 if total > GROUP_ROWS else 16
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    # Salts of a length are laid one after another: each group's first rank is what the groups before it hold.
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(first, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            length, rank = df["length"].to_numpy(), df["_rank"].to_numpy()
            sequence, offset = np.empty(len(df), np.int64), np.empty(len(df), np.int64)
            order = np.argsort(length, kind="stable")
            values, starts = np.unique(length[order], return_index=True)
            for value, own in zip(values.tolist(), np.split(order, starts[1:])):
                begin, base, at, _ = table[value]
                k = np.searchsorted(begin, rank[own], "right") - 1
                sequence[own], offset[own] = base[k] + rank[own] - begin[k], at[k]
            yield df.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "_rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs all documents into as few sequences as it can; see ``token_pieces`` and ``pack``."""
    return pack(written(token_pieces(docs, tokenizer, id_column, text_column, capacity, end_id), "pieces"), capacity)


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
