"""Approximate nearest neighbours (operator 7): NN-descent, with graph search for the queries.

Every vector holds a list of near others. A round sends each vector, with its list's worst score, to the
places where it is listed, compares what meets there, and keeps what improves a list. Rounds are Spark
joins: no vector table is broadcast or collected, and a popular vector is dealt over slices. Rounds and search measure with vectors of single
precision; what the search brings back is measured anew in double precision. Equal vectors are
one point of the graph; what is found is unfolded to the smallest ids of each point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skimmer.llm.shared import done_with, give_back, small_batches, written

#: Neighbours of a list, neighbours that meet at one place and round, rounds, and the share of changed entries that ends them.
LIST, MEET, ROUNDS, STILL = 30, 24, 9, 0.002
#: What a place tells each vector that meets others there: so many of them at most.
TOLD = 8
#: Places of the first lists: hyperplane cells of about this many vectors, so many times.
CELL, CELLS = 96, 3
#: Results of a query, candidates that its search holds, and how many of them are measured in double precision.
TOP, BEAM, MEASURED = 20, 100, 40
SEED = 11
#: Comparisons that are worked out together.
TOGETHER = 1 << 20

_LISTS = "id long, other long, score float"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the vectors that take part: with an id, not null, not empty, finite in every component, not all zero.

    Vectors that are not of the most frequent length (of several, the longest) take no part, for they have no product with the others.
    Of rows that share an id, the smallest vector stands for it.
    """
    v = F.col(vector_column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (length["n"] if length else 0)).groupBy("id").agg(F.min("v").alias("v"))


def packed(vectors: DataFrame) -> DataFrame:
    """(id, p): the vectors as bytes of single precision, all scaled by the largest component, so that no product leaves the range."""
    if "p" in vectors.columns:
        return vectors.select("id", "p")
    largest = vectors.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0] or 1.0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                values = (batch.column(1).flatten().to_numpy(zero_copy_only=False) / largest).astype("<f4").reshape(n, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in values], pa.binary())], names=["id", "p"])

    return written(vectors.select("id", "v").mapInArrow(pack, "id long, p binary"), "packed")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1)


def _best(rows: DataFrame, n: int) -> DataFrame:
    """The n best entries of each list: highest score, ties to the smaller id."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def told(ids: np.ndarray, v: np.ndarray, worst: np.ndarray, last: np.ndarray, fresh: np.ndarray, edges: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Of all that meet at each place, for each its n best others that are better than its list's worst entry, whose id is ``last``.

    Rows of a place stand together, between two ``edges``. A smaller id is better among equal scores. Pairs of two old ones were compared before.
    """
    sizes = np.diff(edges)
    order = np.lexsort((ids, np.repeat(np.arange(len(sizes)), sizes)))
    ids, v, worst, last, fresh = ids[order], v[order], worst[order], last[order], fresh[order]
    a = 0
    while a < len(sizes):
        room = TOGETHER // np.maximum.accumulate(sizes[a : a + 4096].astype(np.int64) ** 2)
        b = a + max(1, int(np.argmax(np.append(room < np.arange(1, len(room) + 1), True))))
        size = sizes[a:b]
        m = int(size.max())
        there = np.arange(m) < size[:, None]
        at = np.where(there, edges[a:b, None] + np.arange(m), edges[a])
        s = np.matmul(v[at], v[at].transpose(0, 2, 1))
        i, f, w = ids[at], fresh[at], worst[at][:, :, None]
        out = ~(there[:, :, None] & there[:, None, :]) | (i[:, :, None] == i[:, None, :]) | ~(f[:, :, None] | f[:, None, :])
        s[out | (s < w) | ((s == w) & (i[:, None, :] >= last[at][:, :, None]))] = -np.inf
        best = np.argsort(-s, axis=2, kind="stable")[:, :, :n]
        score = np.take_along_axis(s, best, 2)
        ok = score > -np.inf
        other = np.take_along_axis(np.broadcast_to(i[:, None, :], s.shape), best, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i.ravel(), ok.sum(2).ravel())), pa.array(other[ok]), pa.array(score[ok].astype(np.float32))], names=["id", "other", "score"])
        a = b


def _by_place(rows: DataFrame, key: list[str], columns: list[str], work: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``work`` on rows with the edges of their places: dealt by key, and cut where the key changes."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.select(*key, *columns).repartition(parts, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                now = pa.Table.from_batches([*held, batch.slice(k, 4000)]).combine_chunks().to_batches()[0]
                at = _changes(now)
                held = [now.slice(int(at[-1]))] if len(at) else [now]
                if len(at):
                    yield from work(now.slice(0, int(at[-1])), np.concatenate([[0], at]))
        if held and held[0].num_rows:
            yield from work(held[0], np.array([0, held[0].num_rows]))
        give_back()

    def _changes(batch: pa.RecordBatch) -> np.ndarray:
        keys = [batch.column(k).to_numpy() for k in range(len(key))]
        return np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1

    return ordered.mapInArrow(run, _LISTS)


def first_lists(vectors: DataFrame, n: int = LIST, cell: int = CELL, cells: int = CELLS, seed: int = SEED) -> DataFrame:
    """Lists to start from: each vector is compared with those that share a cell of seeded hyperplanes; ``vectors`` as ``packed`` gives them.

    Cells that hold more than a few times ``cell`` vectors are dealt by a hash of the id into parts of that size.
    """
    rows, width = vectors.agg(F.count("*"), F.max(F.octet_length("p"))).first()
    if not rows:
        return vectors.sparkSession.createDataFrame([], _LISTS)
    bits = max(0, int(np.log2(max(1, rows / cell))))
    planes = np.random.default_rng(seed).normal(size=(cells, bits, width // 4)).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                for c in range(cells):
                    code = ((v @ planes[c].T) > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(v), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(code.astype(np.int64)), *batch.columns], names=["table", "cell", "id", "p"])

    placed = vectors.mapInArrow(place, "table int, cell long, id long, p binary")
    size = placed.groupBy("table", "cell").agg(F.count("*").alias("_n"))
    placed = placed.join(size, ["table", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "table"), F.ceil(F.col("_n") / (3 * cell))).cast("long"))

    def meet(batch: pa.RecordBatch, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        m = batch.num_rows
        return told(batch.column(3).to_numpy(), _matrix(batch.column(4)), np.full(m, -np.inf, np.float32), np.zeros(m, np.int64), np.ones(m, bool), edges, n)

    found = _by_place(placed, ["table", "cell", "part"], ["id", "p"], meet)
    return _best(found.groupBy("id", "other").agg(F.max("score").alias("score")), n)


def neighbour_graph(vectors: DataFrame, n: int = LIST, meet: int = MEET, rounds: int = ROUNDS, still: float = STILL, seed: int = SEED) -> DataFrame:
    """(id, other, score) for the ``n`` nearest others of each vector (id, v) that NN-descent finds in at most ``rounds`` rounds.

    A vector alone has no list. Equal vectors are neighbours like others. Vectors must be of one length.
    """
    small_batches(vectors.sparkSession)
    vectors = packed(vectors)
    total = vectors.count()
    lists = written(first_lists(vectors, n, seed=seed).withColumn("fresh", F.lit(True)), "lists")
    for k in range(rounds):
        # Whom a place brings together: those on its list and those that list it, at most `meet` of either kind, the
        # fresh ones first. A place that is listed by very many is dealt into slices before any choice.
        pick = F.xxhash64(F.lit(seed + k), "id", "other")
        listed = lists.select(F.col("id").alias("place"), F.col("other").alias("id"), "fresh", pick.alias("h"), F.lit(0).alias("kind"))
        listing = lists.select(F.col("other").alias("place"), "id", "fresh", pick.alias("h"), F.lit(1).alias("kind"))
        # reverse entries: the choice is made in slices first, so that no single sort holds a popular place
        sliced = Window.partitionBy("place", "slice").orderBy(F.desc("fresh"), "h")
        listing = listing.withColumn("slice", F.pmod("h", F.lit(16))).withColumn("_rank", F.row_number().over(sliced)).where(F.col("_rank") <= meet).drop("slice", "_rank")
        order = Window.partitionBy("place", "kind").orderBy(F.desc("fresh"), "h")
        here = Window.partitionBy("place")
        who = listed.union(listing).repartition("place").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= meet)
        # where all are old, all pairs were compared before
        who = who.groupBy("place", "id").agg(F.max("fresh").alias("fresh")).withColumn("_any", F.max("fresh").over(here)).where("_any").drop("_any")
        worst = lists.groupBy("id").agg(F.when(F.count("*") >= n, F.min(F.struct("score", F.negative("other").alias("less")))).alias("w"))
        state = vectors.join(worst, "id", "left").select("id", "p", F.coalesce("w.score", F.lit(float("-inf")).cast("float")).alias("worst"), F.coalesce(F.negative("w.less"), F.lit(0)).alias("last"))

        def compare(batch: pa.RecordBatch, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, ids, p, low, last, fresh = batch.columns
            return told(ids.to_numpy(), _matrix(p), low.to_numpy(), last.to_numpy(), fresh.to_numpy(zero_copy_only=False), edges, TOLD)

        found = _by_place(who.join(state, "id"), ["place"], ["id", "p", "worst", "last", "fresh"], compare)
        both = lists.select("id", "other", "score", F.lit(False).alias("fresh")).union(found.select("id", "other", "score", F.lit(True).alias("fresh")))
        before, lists = lists, written(_best(both.repartition("id").groupBy("id", "other").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh")), n), "lists")
        done_with(before)
        if lists.where("fresh").count() <= still * n * max(1, total):
            break
    return lists.select("id", "other", "score")


def search(vectors: DataFrame, graph: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM, measured: int = MEASURED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest others of each query, a part of ``vectors`` (id, v), that greedy search of ``graph`` finds.

    A query starts at its own list. A hop looks at the lists of those of its ``beam`` best that it has not looked at yet and keeps the
    best of what it sees; the search ends when no query has any left. The ``measured`` best of a query are then scored in double precision.
    If a query sees fewer than ``top`` others that way although there are as many, it is compared with all vectors: queries come in
    blocks against the table.
    """
    short_p = packed(vectors)
    q = queries.select(F.col("id").alias("query")).distinct()
    qp = written(short_p.join(q, short_p["id"] == q["query"]).select("query", F.col("p").alias("qp")), "queries")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", _matrix(batch.column(2)), _matrix(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.astype(np.float32))], names=["query", "id", "score"])

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(short_p, "id").join(qp, "query").select("query", "id", "p", "qp").mapInArrow(products, "query long, id long, score float").withColumn("done", F.lit(False))

    own = graph.select(F.col("id").alias("query"), F.col("other").alias("id")).join(q, "query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    state = written(scored(own), "beam")
    links = graph.select("id", "other")
    while not (open_ := state.where(~F.col("done"))).isEmpty():
        seen = state.select("query", "id", F.lit(True).alias("known"))
        new = open_.join(links, "id").select("query", F.col("other").alias("id"), F.lit(False).alias("known")).where(F.col("query") != F.col("id"))
        new = new.union(seen).groupBy("query", "id").agg(F.max("known").alias("known")).where(~F.col("known")).select("query", "id")
        both = state.withColumn("done", F.lit(True)).union(scored(new))
        before, state = state, written(both.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= beam).drop("_rank"), "beam")
        done_with(before)
    few = state.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(measured, top)).select("query", "id")
    both = few.join(vectors.select("id", "v"), "id").join(vectors.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query")
    exact = both.select("query", "id", _dot("qv", "v").alias("score"))
    count = state.groupBy("query").agg(F.count("*").alias("n"))
    wanted = min(top, vectors.count() - 1)
    short = written(q.join(count, "query", "left").where(F.coalesce("n", F.lit(0)) < wanted).select("query"), "short")
    if not short.isEmpty():
        asked = short.join(vectors.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query")
        exact = exact.union(_against_all(vectors.select("id", "v"), asked, top)).groupBy("query", "id").agg(F.max("score").alias("score"))
    ranked = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _against_all(vectors: DataFrame, queries: DataFrame, top: int, block: int = 256) -> DataFrame:
    """(query, id, score) of the ``top`` nearest of each query among all vectors: blocks of queries against slices of the table, joined by block number."""
    n = queries.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query long, id long, score double")
    blocks = -(-n // block)
    slices = 16
    q = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct("query", "qv")).alias("qs"))  # about `block` in each
    q = q.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    v = vectors.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def nearest(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        qs = left["qs"].iloc[0]
        ids, qid = right["id"].to_numpy(), np.array([x["query"] for x in qs])
        s = np.stack([x["qv"] for x in qs]) @ np.stack(right["v"].to_numpy()).T
        s[qid[:, None] == ids[None, :]] = -np.inf
        at = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :top]
        score = np.take_along_axis(s, at, 1)
        ok = score > -np.inf
        return pd.DataFrame({"query": np.repeat(qid, ok.sum(1)), "id": ids[at][ok], "score": score[ok]})

    return q.groupBy("block", "slice").cogroup(v.groupBy("block", "slice")).applyInPandas(nearest, "query long, id long, score double")


def points(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """(id, v, ids): each different vector once, with the smallest ids that have it, one more than ``top``; id is the first of them."""
    order = Window.partitionBy("v").orderBy("id")  # cut before it is dealt, so that a group of any size is few rows
    few = vectors.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= top + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest others of each query, a part of ``vectors`` (id, v); ties to the smaller id.

    The graph and its search see each different vector once. A point that is among the ``top`` nearest stands for all ids that
    have its vector, and a query's own point for its copies. Queries with one vector share one search.
    """
    groups = written(points(vectors, top), "points")
    single = groups.select("id", "v")
    short = packed(single)
    single = single.join(short, "id")
    graph = written(neighbour_graph(short), "graph")
    asked = written(queries.join(groups, "v").select(queries["id"].alias("query_id"), groups["id"].alias("point")).distinct(), "asked")
    wanted = groups.join(asked.select(F.col("point").alias("id")).distinct(), "id", "left_semi").select("id")
    found = search(single, graph, wanted, top).select(F.col("query_id").alias("point"), F.col("vec_id").alias("id"))
    both = found.union(wanted.select("id", "id"))
    both = both.join(groups, "id").join(groups.select(F.col("id").alias("point"), F.col("v").alias("qv")), "point")
    # the measure in full: products summed in order of the components
    each = both.select("point", _dot("qv", "v").alias("score"), F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("point").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top + 1).groupBy("point").agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))
    # an id that is asked stands in one point; its own id is one of the entries, or one of them is too many
    mine = asked.join(each, "point").select("query_id", F.slice(F.array_sort(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), _nearer), 1, top).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("k", "x")).select("query_id", (F.col("k") + 1).alias("rank"), "x.vec_id", "x.score")


def _nearer(a: Column, b: Column) -> Column:
    return F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "vectors")
    return nearest(vectors, vectors.where("id % 20 = 0"))
