"""Connected components of an edge table, for classes of linked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.llm.shared import done_with, written

#: A node with more links than this has them dealt out; with very many links in all, the bound rises so that such nodes are at most HUBS.
HUB_LINKS, HUBS = 512, 50_000


def _links(pairs: DataFrame) -> DataFrame:
    """(a, b) with a > b, each once."""
    return pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _beside_lowest(rows: DataFrame, lowest: DataFrame, bound: int) -> DataFrame:
    """``rows`` (a, b) with _low of their a. The rows of an a that has more than ``bound`` are dealt over several tasks."""
    hubs = lowest.where(F.col("_n") > bound).select("a", F.ceil(F.col("_n") / bound).cast("int").alias("_parts"))  # at most HUBS rows
    dealt = rows.join(F.broadcast(hubs), "a", "left").withColumn("_part", F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1))).cast("int"))
    part = F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / bound).cast("int") - 1)).alias("_part")
    return dealt.join(lowest.select("a", "_low", part), ["a", "_part"]).select("a", "b", "_low")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that it is linked with, over any path.

    Rounds of large-star and small-star steps, until nothing is left to move: in each, nodes point at the smallest node they know of, so
    that paths halve. Every round's table is written to the shared folder. A node with very many links is
    pre-aggregated as a minimum, and its links are dealt over tasks; no list of neighbours is built. An empty table gives an empty result.
    """
    now = written(_links(edges), "edges")
    while True:
        bound = max(HUB_LINKS, -(-2 * now.count() // HUBS))
        # large star: of each node's links, those to larger nodes move to the smallest node near it
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_low"), F.count("*").alias("_n"))
        large = written(_beside_lowest(both.where("b > a"), lowest, bound).select(F.col("b").alias("a"), F.col("_low").alias("b")).distinct(), "large-star")
        # small star: links to smaller nodes, and the node itself, move to the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("_low"), F.count("*").alias("_n"))
        moved = _beside_lowest(large, lowest, bound).select(F.col("b").alias("a"), F.col("_low").alias("b"))
        new = written(moved.union(lowest.select("a", F.col("_low").alias("b"))).where("a <> b").distinct(), "edges")
        done_with(now, large)
        now = new
        # done once every node has one link, to a node that has none downward
        tops = now.select(F.col("b").alias("a")).distinct()
        if now.groupBy("a").count().where("count > 1").isEmpty() and now.join(tops, "a", "left_semi").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
