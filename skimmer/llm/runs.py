"""Periodic runs of words (operator 12): block matching with pyahocorasick.

A run of period q that repeats four times or more holds an aligned block of each power of two up to (3q + 1) / 2 words, and that block again
q words later. So for each block length B the aligned blocks are the keys of an automaton over word numbers; an occurrence that
starts d words after an aligned block of the same words, (2B - 1) / 3 <= d <= (4B - 2) / 3, seeds a run of period d, extended word by word in both
directions. Those distances cover every period once. A block of which a word does not recur within the distance can't be a seed
and is no key, and neither is one that lies with its whole reach in a run that is known: what it seeds has that run's period.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.llm.shared import slices, small_batches

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of keys in one automaton, about; a longer block has one of its own.
KEY_WORDS = 1 << 14
CHUNK_BYTES = 1 << 20


def recurrences(words: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each place the distance to the next place of the same word in the same text; none: a distance longer than any text."""
    order = np.lexsort((words, texts))
    same = (words[order][1:] == words[order][:-1]) & (texts[order][1:] == texts[order][:-1])
    out = np.full(len(words), np.iinfo(np.int64).max)
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def _extent(words: np.ndarray, at: int, d: int, step: int) -> int:
    """How many places from ``at`` on, by ``step`` of 1 or -1, hold the same word as the place d later; looks at ever longer stretches."""
    n, size, k = len(words) - d, 64, at
    while 0 <= k < n:
        a, b = (k, min(n, k + size)) if step > 0 else (max(0, k + 1 - size), k + 1)
        other = np.flatnonzero(words[a:b] != words[a + d : b + d])
        if len(other):
            return int(other[0]) + a - at if step > 0 else at - (int(other[-1]) + a)
        k, size = (b, size * 2) if step > 0 else (a - 1, size * 2)
    return abs(k - at)


class _Found:
    """The runs of one text so far, by rising block length."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []
        #: of each period the stretch met last: blocks come in the order of the text
        self.stretch: dict[int, tuple[int, int]] = {}
        #: runs by power of two of their length and the places of that size that they touch: few, for runs of four periods overlap little
        self.near: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.longest = 0

    def add(self, run: tuple[int, int, int]) -> None:
        start, length, _ = run
        k = length.bit_length() - 1
        self.runs.append(run)
        self.longest = max(self.longest, length)
        for place in range(start >> k, (start + length - 1 >> k) + 1):
            self.near.setdefault((k, place), []).append(run)

    def covers(self, a: int, b: int, d: int) -> bool:
        """Whether the stretch of period d met last, or a run of a period that divides d, holds the places from a to b."""
        x, y = self.stretch.get(d, (0, 0))
        if x <= a and b <= y:
            return True
        for k in range((b - a).bit_length() - 1, self.longest.bit_length()):
            for start, length, q in self.near.get((k, a >> k), ()):
                if d % q == 0 and start <= a and b <= start + length:
                    return True
        return False

    def reach(self, n: int, span: int) -> np.ndarray:
        """By place, whether ``span`` words from there on lie in one known run."""
        out = np.zeros(n + 1, np.int64)
        for start, length, _ in self.runs:
            if length >= span:
                out[start] += 1
                out[start + length - span + 1] -= 1
        return np.cumsum(out)[:n] > 0


def smallest_period(words: np.ndarray, d: int) -> bool:
    """Whether no proper divisor of d is a period of ``words``, which has period d and twice its length at least: a smaller period would be one."""
    for q in {k for a in range(1, int(d**0.5) + 1) if d % a == 0 for k in (a, d // a)} - {d}:
        if (words[q:] == words[:-q]).all():
            return False
    return True


def text_runs(words: np.ndarray, recurs: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text, by start and period. ``recurs``: as ``recurrences`` gives it."""
    n, found = len(words), _Found()
    size, plain = 2, None
    while (lowest := -(-(2 * size - 1) // 3)) * LEAST_PERIODS <= n:
        most = (4 * size - 2) // 3
        blocks = n // size
        # no word of a seed block recurs farther away than the longest distance
        able = np.flatnonzero(recurs[: blocks * size].reshape(blocks, size).max(1) <= most) * size if blocks else np.zeros(0, np.int64)
        if len(able) and found.runs:
            able = able[~found.reach(n, size + most)[able]]
        if len(able):
            plain = tuple(words.tolist()) if plain is None else plain
            for part in np.array_split(able, -(-len(able) * size // KEY_WORDS)) if len(able) * size > KEY_WORDS else [able]:
                if len(part):
                    _seeded(words, plain, part.tolist(), size, lowest, most, found)
        size *= 2
    return sorted(found.runs, key=lambda r: (r[0], r[2]))


def _seeded(words: np.ndarray, plain: tuple[int, ...], blocks: list[int], size: int, lowest: int, most: int, found: _Found) -> None:
    """Searches the text from the first block to the reach of the last for the words of each of ``blocks``; each occurrence in reach of its block seeds a run."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    first: dict[tuple[int, ...], int] = {}
    of: dict[int, int] = {}
    for s in blocks:
        key = plain[s : s + size]
        of[s] = name = first.setdefault(key, len(first))
        automaton.add_word(key, name)
    automaton.make_automaton()
    begin = 0
    while begin < len(blocks):
        # blocks whose reaches touch are searched together
        stop = begin + 1
        while stop < len(blocks) and blocks[stop] <= blocks[stop - 1] + most + size:
            stop += 1
        low, high = blocks[begin], min(len(words), blocks[stop - 1] + most + size)
        for end, name in automaton.iter(plain[low:high]):
            p = low + end + 1 - size
            s = (p - lowest) // size * size  # the only aligned place from which p is in reach
            d = p - s
            if d <= most and of.get(s) == name and not found.covers(s, p + size, d):
                _extended(words, s, d, size, found)
        begin = stop


def _extended(words: np.ndarray, s: int, d: int, size: int, found: _Found) -> None:
    """The stretch of period d around the block at s, whose words stand again at s + d; a run, if it is long enough and has no smaller period."""
    right = s + size + _extent(words, s + size, d, 1)
    left = s - _extent(words, s - 1, d, -1)
    found.stretch[d] = (left, right + d)
    length = right - left + d
    if length >= max(LEAST_WORDS, LEAST_PERIODS * d) and smallest_period(words[left : right + d], d):
        found.add((left, length, d))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """By word, whether it stays: no run holds it after that run's first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone)[:n] == 0


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and then period), collapsed (the words that stay, joined by one space).

    Words are stretches of other letters than blank, tab, line feed, vertical tab, form feed and return, and are compared as they stand. A run is a stretch of
    at least 6 words and 4 periods that no neighbour extends, told with its smallest period; runs of different periods may overlap. A word goes if
    a run holds it after the run's first period. Null and empty texts have no words, no runs and an empty collapsed text. A null id is kept as null;
    repeated rows are looked at each; other columns are ignored, whatever their names; an empty table gives an empty one.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, batch.column(1), CHUNK_BYTES)):
            texts = pc.replace_substring_regex(pc.fill_null(part.column(1), "").cast(pa.large_string()), "[\t\n\x0b\x0c\r]", " ")
            lists = pc.split_pattern(texts, " ")
            flat = pc.list_flatten(lists)
            full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))[full]
            coded = pc.dictionary_encode(flat.filter(pa.array(full)))
            names, words = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            recurs = recurrences(words, doc)
            ends = np.cumsum(np.bincount(doc, minlength=len(part)))
            sizes, starts, lengths, periods, texts, at = [], [], [], [], [], 0
            for end in ends.tolist():
                own = words[at:end]
                runs = text_runs(own, recurs[at:end])
                sizes.append(len(runs))
                for start, length, period in runs:
                    starts.append(start), lengths.append(length), periods.append(period)
                stay = own[kept_words(len(own), runs)] if runs else own
                texts.append(" ".join(map(names.__getitem__, stay.tolist())))
                at = end
            items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), items)
            n_words = pa.array(np.diff(ends, prepend=0), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n_words, lists, pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(found, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; in the texts with a crc32 of the id divisible by ten, the words from a place on repeat with a period, both told by that crc32.

    A null id has no crc32 and its text stays; so does a text without words.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.col("words")
    docs = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    docs = docs.withColumn("n", F.size("words").cast("long"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get(words, at(i).cast("int"))), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every whole text of documents, planted ones among them, and what is left when each run keeps its first period."""
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    # exponents are compared as fractions, by cross products
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | (
        (x["length"] * y["period"] == y["length"] * x["period"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"])))
    )
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    return told.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words"
    )
