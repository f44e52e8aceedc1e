"""Mixing sources to target weights (operator 8): subset-sum budget fitting by exact length.

A source's target is met with whole documents: every document is taken ``target // total`` times, and the
rest of the target by one more copy of some. How many of each exact size get that copy is a bounded
knapsack over the source's size histogram; which ones is settled by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimmer.llm.shared import done_with, written

#: Budgets up to this many words are filled by dynamic programming; what is larger is first dealt in proportion.
DP_WORDS = 1 << 16
#: Documents of one source and size that are ranked together.
GROUP_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def fill_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many of each size to take, at most ``counts``, for a sum as near below ``budget`` as it gets.

    First every size gives the same share of its documents, rounded down, so the mix keeps the source's
    make-up; then the largest sizes that fit shrink the remainder to ``dp_words``; then a bounded knapsack
    over the reachable sums finds the counts that use it best. Sizes of 0 are never taken.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return np.where(sizes > 0, counts, 0)
    if budget <= 0 or not total:
        return np.zeros(len(sizes), np.int64)
    take = np.array([c * budget // total if s else 0 for s, c in zip(sizes.tolist(), counts.tolist())], np.int64)
    rest = budget - int((take * sizes).sum())
    for k in np.argsort(-sizes, kind="stable"):
        if rest <= dp_words:
            break
        n = min(int(counts[k] - take[k]), max(0, rest - dp_words // 2) // max(1, int(sizes[k]))) if sizes[k] else 0
        take[k] += n
        rest -= n * int(sizes[k])
    width = min(rest, dp_words)
    reach = np.zeros(width + 1, bool)
    reach[0] = True
    by = np.full(width + 1, -1, np.int32)  # the item that first made a sum reachable
    items: list[tuple[int, int]] = []
    for k in np.argsort(sizes, kind="stable"):
        left, n = int(counts[k] - take[k]), 1
        while sizes[k] and left > 0 and not reach[width]:
            m = min(n, left)
            w = m * int(sizes[k])
            if w > width:
                break
            new = np.flatnonzero(reach[: width + 1 - w] & ~reach[w:]) + w
            reach[new] = True
            by[new] = len(items)
            items.append((int(k), m))
            left, n = left - m, 2 * n
        if reach[width]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k, m = items[by[at]]
        take[k] += m
        at -= m * int(sizes[k])
    return take


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): ``share`` of all sizes dealt by weight.

    Sources get the weights in turn, by code point with null last. A target stops at ``most`` times its
    source's size, and what is cut off goes to the others by weight, until no target is above. If all sources stop, the
    targets add up to less. No row of the sources is collected: each round asks for two sums.
    """
    spark = totals.sparkSession
    # sources in order: range partitions, and in each a rank; what the partitions before hold is a few numbers
    source = F.col("source").asc_nulls_first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    null_last = F.col("source").isNull()
    dealt = written(totals.repartitionByRange(parts, null_last, source).withColumn("_part", F.spark_partition_id()), "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    first = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(null_last, source)) - 1
    table = dealt.withColumn("_rank", rank).join(first, "_part").withColumn("_rank", F.col("_rank") + F.col("_first"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = written(table.select("source", "source_size", weight.alias("_weight")), "weights")
    done_with(dealt)
    goal = share * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = 0.0
    while True:  # the level only rises, and each round stops at least one more source
        stopped = F.col("_weight") * F.lit(level) >= F.col("source_size") * most
        held, open_ = table.agg(F.coalesce(F.sum(F.when(stopped, F.col("source_size") * most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~stopped, F.col("_weight"))), F.lit(0.0))).first()
        if not open_:
            break
        new = max(0.0, goal - held) / open_
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least(F.col("_weight") * F.lit(level), F.col("source_size") * F.lit(float(most))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` (with _id, _source and _size) plus _source_size, _target and _copies, the number of times that the mix takes the row.

    A null source is a source of its own, a null size counts as 0. Repeated rows are separate documents;
    among rows that agree in id, source and size any may be taken. An empty table stays empty. The columns that
    ``docs`` brings besides are kept.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("_hash", F.xxhash64(F.lit(seed), "_id"))
    sizes = written(docs.groupBy("_source", "_size").agg(F.count("*").alias("_n")), "sizes")
    totals = sizes.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size")).select(F.col("_source").alias("source"), "source_size")
    targets = written(source_targets(totals, weights, share, most), "targets")
    t = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    joined = sizes.join(t.hint("merge"), same(sizes, t, "_source"), "left").drop(t["_source"])

    def quotas(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("_size", ignore_index=True)
        total, target = int(df["_source_size"].iloc[0]), float(df["_target"].iloc[0])
        full = int(target // total) if total else 0
        df["_full"] = full
        df["_more"] = fill_budget(df["_size"].to_numpy(), df["_n"].to_numpy(), int(round(target - full * total)))
        return df

    schema = T.StructType(
        [T.StructField("_source", T.StringType())] + [T.StructField(k, kind) for k, kind in (("_size", T.LongType()), ("_n", T.LongType()), ("_source_size", T.LongType()), ("_target", T.DoubleType()), ("_full", T.LongType()), ("_more", T.LongType()))]
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by_source = joined.select("_source", "_size", "_n", "_source_size", "_target").repartition(parts, "_source")  # not merged again: each source's knapsack is work
    quota = written(by_source.groupBy("_source").applyInPandas(quotas, schema), "quotas")
    # Documents of a source and size rank by hash. Where there are many, slices of the hash's range are ranked apart,
    # and a slice's first rank is what the slices before it hold.
    slices = F.greatest(F.lit(1), F.ceil(F.col("_n") / group_rows)).cast("long")
    crowded = quota.where(F.col("_n") > group_rows).select("_source", "_size", slices.alias("_slices"))
    plain = crowded.isEmpty()
    if plain:
        keyed = docs.withColumn("_slice", F.lit(0).cast("long"))
        slots = quota.withColumn("_slice", F.lit(0).cast("long")).withColumn("_first", F.lit(0).cast("long"))
    else:
        slice_of = F.pmod(F.shiftrightunsigned(F.col("_hash"), 20), F.coalesce(F.col("_slices"), F.lit(1).cast("long")))
        c = crowded.select(F.col("_source").alias("_c_source"), F.col("_size").alias("_c_size"), "_slices")
        c = F.broadcast(c) if c.count() <= 100_000 else c
        keyed = docs.join(c, F.col("_source").eqNullSafe(F.col("_c_source")) & (F.col("_size") == F.col("_c_size")), "left").withColumn("_slice", slice_of).drop("_slices", "_c_source", "_c_size")
        counted = keyed.groupBy("_source", "_size", "_slice").agg(F.count("*").alias("_c"))
        before = Window.partitionBy("_source", "_size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_first", F.coalesce(F.sum("_c").over(before), F.lit(0).cast("long"))).drop("_c")
        q = quota.withColumnsRenamed({"_source": "_q_source", "_size": "_q_size"}).hint("merge")
        slots = counted.join(q, F.col("_source").eqNullSafe(F.col("_q_source")) & (F.col("_size") == F.col("_q_size"))).drop("_q_source", "_q_size")
    keyed = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_source", "_size", "_slice").orderBy("_hash", "_id")) - 1)
    slots = slots.withColumnsRenamed({"_source": "_s_source", "_size": "_s_size", "_slice": "_s_slice"})
    here = F.col("_source").eqNullSafe(F.col("_s_source")) & (F.col("_size") == F.col("_s_size")) & (F.col("_slice") == F.col("_s_slice"))
    # the histogram grows with the sources: it is sorted beside the documents, never broadcast
    out = keyed.join(slots.hint("merge"), here, "left").drop("_s_source", "_s_size", "_s_slice")
    copies = F.col("_full") + F.when(F.col("_rank") + F.col("_first") < F.col("_more"), 1).otherwise(0)
    return out.withColumn("_copies", copies).drop("_hash", "_n", "_full", "_more", "_slice", "_first", "_rank")


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def op8_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = written(docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count().alias("_size")), "sized")
    return mix(sized).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))
