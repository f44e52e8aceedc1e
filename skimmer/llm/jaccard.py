"""N-gram Jaccard join (operator 6): a MinHash LSH forest with exact verification.

Equal word sequences are one text first. Each text's signature is cut into trees. A tree is a trie of the texts: those
below one node share a prefix of the tree's part of the signature. Texts meet that share a full prefix in some tree, and are
verified by their shingle sets. What the links found so far tell about the links that such prefixes miss decides
whether all prefixes are shortened by one value; then only pairs that had not met before are verified, until the
target recall is reached. The output has a row for each document and never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimmer.llm.components import components
from skimmer.llm.shared import done_with, give_back, slices, small_batches, written

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Trees, and values of a tree. A pair at the threshold shares a full prefix in one of them with probability 0.9995.
TREES, DEPTH = 32, 7
#: What the links found tell is heeded only where a pair at the threshold is met with so much probability.
HEEDED = 0.999
#: Shingles and texts of a block, about; two blocks are compared in one step.
BLOCK, BLOCK_TEXTS = 1 << 19, 1024
#: A side of a join of up to so many rows, counted before, of one number each, is broadcast, so that texts and signatures that it does not name stay where they are.
BROADCAST_ROWS = 2_000_000
#: Bands of similarity, from the threshold to 1, in which links are counted.
BANDS = 20
#: Stands for a null row, which counts as the smallest.
NO_ID = -(1 << 63)


def meeting(similarity: float | np.ndarray, trees: int, depth: int) -> float | np.ndarray:
    """The probability that a pair shares a prefix of ``depth`` values in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def estimated_recall(bands: np.ndarray, threshold: float, trees: int, depth: int) -> float:
    """The share of all links that have been found, by how many were found in each band of similarity from the threshold up.

    A link of similarity s was found with probability p(s), so it stands for 1 / p(s) links; a band counts at its lower end.
    Without links it is 1.
    """
    found = float(np.sum(bands))
    if not found:
        return 1.0
    low = threshold + (1 - threshold) * np.arange(len(bands)) / len(bands)
    return found / float(np.sum(np.asarray(bands) / meeting(low, trees, depth)))


@lru_cache(maxsize=1)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240101)
    return (r.integers(0, 1 << 32, n, np.uint64) | np.uint64(1)).astype(np.uint32), r.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


class Shingler:
    """Word n-gram hashes of texts. Words are runs of non-space characters in lower case, as the text has them."""

    def __init__(self, n: int = WORDS):
        self.n = n

    def _words(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        words = coded.dictionary.to_pylist()
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        hashes = own[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
        first = lists.offsets.to_numpy()
        empty = xxhash.xxh3_64_intdigest("")
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            h = hashes[a:b]
            yield h[:0] if len(h) == 1 and h[0] == empty else h

    def sets(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
        """For each text its sorted different shingle hashes, and the digest of its word sequence.

        A text of fewer than n words has one shingle, all its words; one without words, or a null, has none.
        """
        for h in self._words(texts):
            if not len(h):
                yield np.zeros(0, np.uint64), b""
                continue
            n = min(self.n, len(h))
            value = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                value = (value ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            yield np.unique(value), xxhash.xxh3_128_digest(h.tobytes())


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minimum hashes, of 16 bits each."""
    a, b = _multipliers(n)
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 512):
        out = np.minimum(out, (short[k : k + 512][None, :] * a[:, None] + b[:, None]).min(1))
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")  # a minimum is small: its bits are spread first


def prefix_marks(signatures: list[bytes], trees: int, depth: int, length: int) -> np.ndarray:
    """A number for each signature's prefix of ``length`` values in each tree, equal for equal prefixes."""
    values = np.frombuffer(b"".join(signatures), ">u2").reshape(len(signatures), trees, depth)[:, :, :length].astype(np.uint64)
    out = np.zeros(values.shape[:2], np.uint64)
    for k in range(length):
        out = (out ^ values[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def _met(marks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.zeros((len(left), len(right)), bool)
    for t in range(marks.shape[1]):
        out |= marks[left, t][:, None] == marks[right, t][None, :]
    return out


def compare(shingles: list[np.ndarray], meet: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs ``meet`` (texts ``left`` by texts ``right``, positions), those that are linked, and the similarity of each pair that is."""
    size = np.array([len(s) for s in shingles], np.int64)
    small, large = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
    meet = meet & (small >= threshold * large - 1e-9)
    both = np.zeros(meet.shape, np.float32)
    rows, columns = np.nonzero(meet)
    if len(rows) < 4 * (len(left) + len(right)):
        for i, j in zip(rows.tolist(), columns.tolist()):
            a, b = shingles[left[i]], shingles[right[j]]
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            both[i, j] = (b[np.minimum(at, len(b) - 1)] == a).sum()
    else:
        own = np.unique(np.concatenate([left[rows], right[columns]]))
        row = np.full(len(shingles), len(own))
        row[own] = np.arange(len(own))
        every, of = np.concatenate([shingles[k] for k in own]), np.repeat(np.arange(len(own)), size[own])
        order = np.argsort(every, kind="stable")
        every, of = every[order], of[order]
        column = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]]))
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1025, 1024))
        l, r = row[left], row[right]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                has = np.zeros((len(own) + 1, 1024), np.float32)  # the last row stands for texts that meet none
                has[of[a:b], column[a:b] % 1024] = 1
                both += has[l] @ has[r].T
    union = size[left][:, None] + size[right][None, :] - both
    links = meet & (both >= threshold * union - 1e-4)
    return links, (both / np.maximum(union, 1))[links]


def spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the smallest position that ``links`` connect it with, over any path."""
    low = np.arange(n)
    has_left, has_right = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    if not len(has_left):
        return low
    part = links[np.ix_(has_left, has_right)]
    l, r = left[has_left], right[has_right]
    while True:
        before = low.copy()
        np.minimum.at(low, l, np.where(part, low[r][None, :], n).min(1))
        np.minimum.at(low, r, np.where(part, low[l][:, None], n).min(0))
        low = low[low]
        if (low == before).all():
            return low


def text_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (_row, a long; _text; other columns) with _key, a digest of their words, instead of _text; and for
    each key (key, class_key, class_row, n_links, n_text_links, n_copies).

    Two rows are linked if the Jaccard similarity of their sets of word n-grams is at least ``threshold``.
    A class holds what links connect; class_key is its smallest key, class_row its smallest row. n_links counts the other rows that a row is linked
    with, n_text_links the other word sequences, n_copies the other rows with the same words. Rows without any words (or
    null) have a null key and are linked with none. Repeated rows are copies. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c != "_text"]
    order = [*kept, "_text"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, batch.column(len(kept))):
                keys, marks, sizes = [], [], []
                for shingles, key in shingler.sets(part.column(len(kept))):
                    keys.append(key or None)
                    marks.append(signature(shingles, trees * depth).tobytes() if key else None)
                    sizes.append(len(shingles))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64())], names=[*kept, "_key", "_marks", "_size"])

    new = [T.StructField("_key", T.BinaryType()), T.StructField("_marks", T.BinaryType()), T.StructField("_size", T.LongType())]
    signs = written(docs.select(*order).mapInArrow(signed, T.StructType([*docs.select(*kept).schema.fields, *new])), "signatures")
    # a null row is the smallest
    lowest = F.min(F.coalesce("_row", F.lit(NO_ID))).alias("_row")
    texts = signs.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("_node")).agg(lowest, F.count("*").alias("_weight"), F.first("_marks").alias("_marks"), F.first("_size").alias("_size"))
    texts = written(texts, "texts")

    links: list[DataFrame] = []
    bands = np.zeros(BANDS)
    for length in range(depth, 0, -1):
        if length != depth - 1:  # else the table at hand tells it too
            near = written(_near(texts, max(length - (length == depth), 1), depth, trees), "near")
        met = written(_members(texts, length, depth, trees, block, near), "met")
        if not met.isEmpty():
            found = written(_verified(docs, met, words, length, depth, trees, threshold), "links")
            links.append(found)
            rows = found.select(F.posexplode("bands").alias("band", "n")).groupBy("band").agg(F.sum("n").alias("n")).collect()  # BANDS rows
            for r in rows:
                bands[r["band"]] += r["n"]
        done_with(met)
        met_at_threshold = meeting(threshold, trees, length)
        if met_at_threshold >= recall or met_at_threshold >= HEEDED and estimated_recall(bands, threshold, trees, length) >= recall:
            break
    schema = "node binary, low binary, n_texts long, n_docs long"
    all_links = reduce(DataFrame.union, [x.where("node is not null").select("node", "low", "n_texts", "n_docs") for x in links]) if links else spark.createDataFrame([], schema)
    classes = components(all_links.select(F.col("node").alias("a"), F.col("low").alias("b")))
    counts = all_links.groupBy("node").agg(F.sum("n_texts").alias("_texts"), F.sum("n_docs").alias("_docs"))
    zero = F.lit(0).cast("long")
    found = texts.select("_node", "_row", "_weight").join(classes, F.col("_node") == F.col("node"), "left").drop("node").join(counts, F.col("_node") == F.col("node"), "left").drop("node")
    found = found.withColumn("_class", F.coalesce("root", "_node"))
    first = found.where(F.col("root").isNotNull()).groupBy(F.col("_class").alias("_c")).agg(F.min("_row").alias("_first"))
    copies = F.col("_weight") - 1
    out = found.join(first, F.col("_class") == F.col("_c"), "left").select(
        F.col("_node").alias("key"), F.col("_class").alias("class_key"), F.nullif(F.coalesce("_first", "_row"), F.lit(NO_ID)).alias("class_row"), (F.coalesce("_docs", zero) + copies).alias("n_links"), F.coalesce("_texts", zero).alias("n_text_links"), copies.alias("n_copies")
    )
    return signs.drop("_marks", "_size"), out


def _small(side: DataFrame) -> DataFrame:
    """A written table of one column of numbers, to be broadcast if it has few rows."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def _near(texts: DataFrame, length: int, depth: int, trees: int) -> DataFrame:
    """The trie nodes at ``length`` values that a text shares with another: (_id, _trie, _child, _n, _alike, _apart).

    _id and _trie are numbers of a text and of a trie node; _child stands for the next value. _n texts are below the trie node, _alike below the child; _apart
    says whether it has more than one child. So one shuffle tells of prefixes of ``length`` and of a value more.
    """
    value = lambda at, n: F.expr(f"substring(_marks, {1 + 2 * at} + {2 * depth} * _tree, {2 * n})")
    forest = texts.select(F.xxhash64("_node").alias("_id"), "_marks", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_tree"))
    child = F.shiftright(F.crc32(value(length, min(1, depth - length))), 16).cast("int")  # different for any two values
    forest = forest.select("_id", F.xxhash64("_tree", value(0, length)).alias("_trie"), child.alias("_child"))
    below, beside = Window.partitionBy("_trie"), Window.partitionBy("_trie", "_child")
    counted = forest.repartition("_trie").sortWithinPartitions("_trie", "_child").withColumn("_alike", F.count("*").over(beside))
    counted = counted.withColumn("_n", F.count("*").over(below)).withColumn("_apart", F.min("_child").over(below) < F.max("_child").over(below))
    return counted.where("_alike > 1 or _apart").select("_id", "_trie", "_child", "_n", "_alike", "_apart")


def _members(texts: DataFrame, length: int, depth: int, trees: int, block: int, near: DataFrame | None = None) -> DataFrame:
    """The texts that share a prefix of ``length`` values with another, as ``near`` tells, dealt into blocks: (_node, _row, _weight, _marks, _size, _block, _meets).

    Of the trie nodes that it, or a text that it shares one with, is in, a text lives in the one that holds most; texts of one home with more than
    ``block`` shingles, or very many of them, are dealt into blocks by hash. _meets are the trie nodes of a text in all trees, each a number. When prefixes have been shortened before, only trie
    nodes count that have more than one child: all pairs below a child have met.
    """
    near = _near(texts, max(length - (length == depth), 1), depth, trees) if near is None else near
    if length == depth:
        shares = near.where("_alike > 1").select("_id", F.struct(F.col("_alike").alias("_n"), F.xxhash64("_trie", "_child").alias("_trie")).alias("_at"))
    else:
        shares = near.where("_apart").select("_id", F.struct("_n", "_trie").alias("_at"))
    shares = written(shares, "shares")
    # the trie node that holds most of the texts that a text shares any with: copies of each other agree on one, whatever else they share
    largest = shares.groupBy("_id").agg(F.max("_at").alias("_home"))
    around = shares.join(largest, "_id").groupBy("_at").agg(F.max("_home").alias("_home"))
    own = shares.join(around, "_at").groupBy("_id").agg(F.max("_home").alias("_home"), F.collect_set("_at._trie").alias("_meets"))  # at most `trees` of them
    own = written(own, "own")
    texts = texts.withColumn("_id", F.xxhash64("_node")).join(_small(own.select("_id")), "_id", "left_semi")
    lives = written(own.join(texts, "_id").select("_node", "_row", "_weight", "_marks", "_size", F.col("_home._trie").alias("_home"), "_meets"), "homes")
    room = lives.groupBy("_home").agg(F.ceil(F.greatest(F.sum("_size") / block, F.count("*") / F.lit(BLOCK_TEXTS))).cast("long").alias("_parts"))
    place = F.xxhash64("_home", F.pmod(F.xxhash64("_node"), F.col("_parts"))).alias("_block")
    return lives.join(room, "_home").select("_node", "_row", "_weight", "_marks", "_size", place, "_meets")


def _shingle_sets(docs: DataFrame, met: DataFrame, words: int) -> DataFrame:
    """(_node, _shingles) for the texts ``met``, and perhaps others: one row of each is read again."""
    rows = written(met.select("_row").distinct(), "rows")
    chosen = docs.select(F.coalesce("_row", F.lit(NO_ID)).alias("_row"), "_text").join(_small(rows), "_row", "left_semi").select("_text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, batch.column(0)):
                sets = [(k, s.tobytes()) for s, k in shingler.sets(part.column(0)) if k]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], pa.binary()), pa.array([s for _, s in sets], pa.binary())], names=["_node", "_shingles"])

    # rows may repeat, and may repeat their id with other words
    return chosen.mapInArrow(shingled, "_node binary, _shingles binary").dropDuplicates(["_node"])


def _verified(docs: DataFrame, met: DataFrame, words: int, length: int, depth: int, trees: int, threshold: float) -> DataFrame:
    """(node, low, n_texts, n_docs, bands) of the texts that are linked with a text that they first meet at prefixes of ``length``.

    ``low`` is a text that links connect the node with; the counts are of this step's links. A unit of work is two blocks that
    share a trie node, or one; each pair of texts is in one unit. ``bands`` stands once for each unit, with a null node. Signatures and
    sizes settle first which texts have a pair to verify in which units. Only their sets are made, and move twice: to the text, where repeated ones go, and to its units.
    """
    spark = met.sparkSession
    shared = met.select("_block", F.explode("_meets").alias("_trie")).distinct()
    many = shared.groupBy("_trie").agg(F.count("*").alias("_n")).where("_n > 1").select("_trie")
    crossed = shared.join(many, "_trie")
    other = crossed.withColumnRenamed("_block", "_j")
    pairs = crossed.join(other, "_trie").where("_block < _j").select(F.col("_block").alias("_i"), "_j").distinct()
    alone = met.groupBy(F.col("_block").alias("_i")).agg(F.count("*").alias("_n")).where("_n > 1").select("_i", F.col("_i").alias("_j"))
    units = pairs.union(alone)
    sides = units.select("_i", "_j", F.explode(F.array_distinct(F.array("_i", "_j"))).alias("_block"))
    placed = met.select("_node", "_weight", "_marks", "_size", "_block").join(sides, "_block")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def by_unit(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select("_i", "_j", "_block", "_node", "_weight", "_marks", *columns).repartition(parts, "_i", "_j").sortWithinPartitions("_i", "_j")

    def each_unit(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for part in slices(batch, batch.column(wide)):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if held and held[0][:2] != row[:2]:
                        yield held
                        held = []
                    held.append(row)
        if held:
            yield held
        give_back()

    def to_verify(rows: list[tuple], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts of either block, and which pairs of them first meet here and may be linked by their sizes."""
        i, j = rows[0][0], rows[0][1]
        at = np.array([r[2] for r in rows])
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        own = [r[5] for r in rows]
        meet = _met(prefix_marks(own, trees, depth, length), left, right)
        if length < depth:
            meet &= ~_met(prefix_marks(own, trees, depth, length + 1), left, right)
        if i == j:
            meet = np.triu(meet, 1)
        small, large = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
        return left, right, meet & (small >= threshold * large - 1e-9)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in each_unit(batches, 5):
            rows.sort(key=lambda r: r[3])
            left, right, meet = to_verify(rows, np.array([r[6] for r in rows], np.int64))
            kept = [rows[k][:6] for k in np.union1d(left[meet.any(1)], right[meet.any(0)]).tolist()]
            if kept:
                long, binary = pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), (long, long, long, binary, long, binary))], names=["_i", "_j", "_block", "_node", "_weight", "_marks"])

    places = written(by_unit(placed, "_size").mapInArrow(cut, "_i long, _j long, _block long, _node binary, _weight long, _marks binary"), "places")
    wanted = met.join(places.select("_node").distinct(), "_node", "left_semi")
    ordered = by_unit(_shingle_sets(docs, wanted, words).join(places, "_node"), "_shingles")

    def unit(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: r[3])
        shingles, weights = [np.frombuffer(r[6], np.uint64) for r in rows], np.array([r[4] for r in rows], np.int64)
        left, right, meet = to_verify(rows, np.array([len(x) for x in shingles], np.int64))
        links, likeness = compare(shingles, meet, left, right, threshold)
        n_texts, n_docs = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        np.add.at(n_texts, left, links.sum(1))
        np.add.at(n_texts, right, links.sum(0))
        np.add.at(n_docs, left, links @ weights[right])
        np.add.at(n_docs, right, weights[left] @ links)
        low = spanning(links, left, right, len(rows))
        linked = np.flatnonzero(n_texts).tolist()
        band = np.clip(((likeness - threshold) / (1 - threshold) * BANDS + 1e-6).astype(np.int64), 0, BANDS - 1)
        counts = np.bincount(band, minlength=BANDS).tolist()
        names = [r[3] for r in rows]
        return pa.RecordBatch.from_pydict(
            {
                "node": pa.array([*(names[k] for k in linked), None], pa.binary()), "low": pa.array([*(names[low[k]] for k in linked), None], pa.binary()),
                "n_texts": pa.array([*n_texts[linked].tolist(), 0], pa.int64()), "n_docs": pa.array([*n_docs[linked].tolist(), 0], pa.int64()),
                "bands": pa.array([*([None] * len(linked)), counts], pa.list_(pa.int64())),
            }
        )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in each_unit(batches, 6):
            yield unit(rows)

    return ordered.mapInArrow(verify, "node binary, low binary, n_texts long, n_docs long, bands array<long>")


def jaccard_classes(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (_row, _text and others) with class_key, class_row, n_links, n_text_links and n_copies of ``text_classes``; _text is left out.

    A row without words is a class of its own, without a class_key. Other columns are kept, but for those of these names.
    """
    new = ("class_key", "class_row", "n_links", "n_text_links", "n_copies")
    own = [c for c in docs.columns if c not in new]
    safe = {c: f"_own_{k}" for k, c in enumerate(own) if c not in ("_row", "_text")}  # names that cannot clash
    rows, classes = text_classes(docs.select(*[F.col(f"`{c}`").alias(safe.get(c, c)) for c in own]), **how)
    both = rows.join(classes, F.col("_key") == F.col("key"), "left")
    zero = F.lit(0).cast("long")
    first = F.when(F.col("key").isNull(), F.col("_row")).otherwise(F.col("class_row")).alias("class_row")
    return both.select(*[F.col(safe.get(c, c)).alias(c) for c in own if c != "_text"], "class_key", first, *(F.coalesce(c, zero).alias(c) for c in new[2:]))


def op6_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = jaccard_classes(docs.select(F.col("doc_id").alias("_row"), F.col("text").alias("_text")))
    return found.select(F.col("_row").alias("doc_id"), F.col("class_row").alias("class_id"), "n_links", "n_text_links", "n_copies")
