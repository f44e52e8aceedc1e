"""Ranking: similarity to preference centroids, the score-and-diversity split, and daily batches.

Whatever is ranked over all rows is first cut to the ``CUT`` best by score, which Spark does as a top-k, so that
no window without partitions sees more rows than that. Draws are seeded hash orders: reruns agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimmer.sources.tables import UNREAD

ALPHA, CUT, CHUNK = 1.5, 1000, 20


def split_size(n: int, ratio: float) -> int:
    """How many of n places go to the best scores: the ceiling of n * (1 - ratio) in 32-bit arithmetic."""
    return int(np.ceil(np.float32(n) * (np.float32(1) - np.float32(ratio))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroid_sets(centroids: DataFrame) -> DataFrame:
    """One row (positive, negative): all centroids of either type. Centroids are ten of a type at most."""
    pick = lambda kind: F.collect_list(F.when(F.col("type") == kind, F.col("centroid")))
    return centroids.agg(pick("positive").alias("positive"), pick("negative").alias("negative"))


def similarity_score(vector: Column, positive: Column, negative: Column, alpha: float = ALPHA, digits: int | None = None) -> Column:
    """Largest product with a positive centroid minus ``alpha`` times the largest with a negative one.

    Without negatives their part is 0; without positives the whole score is 0. ``digits`` rounds each product first.
    """
    each = (lambda c: F.round(dot(vector, c), digits)) if digits is not None else (lambda c: dot(vector, c))
    plus, minus = F.array_max(F.transform(positive, each)), F.coalesce(F.array_max(F.transform(negative, each)), F.lit(0.0))
    return F.coalesce(plus - F.lit(alpha) * minus, F.lit(0.0))


def score_all(rows: DataFrame, centroids: DataFrame, vector: str = "vector", alpha: float = ALPHA) -> DataFrame:
    """``rows`` that have a vector, with their new score. The centroids travel as one row."""
    sets = F.broadcast(centroid_sets(centroids))  # one row of at most twenty centroids
    return rows.where(F.col(vector).isNotNull()).join(sets).withColumn("score", similarity_score(F.col(vector), F.col("positive"), F.col("negative"), alpha)).drop("positive", "negative")


def best(rows: DataFrame, cut: int = CUT) -> DataFrame:
    return rows.orderBy(F.desc("score"), "id").limit(cut)


def _drawn(rows: DataFrame, first: Column, more: Column, seed: int) -> DataFrame:
    """Of a bounded table: the ``first`` best, and ``more`` drawn from the rest, in order; recommendation_type and position from 0."""
    by_score = Window.orderBy(F.desc("score"), "id")
    ranked = rows.withColumn("_rank", F.row_number().over(by_score)).withColumn("_score_part", F.col("_rank") <= first)
    lot = F.row_number().over(Window.partitionBy("_score_part").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "id")), "id"))
    picked = ranked.withColumn("_lot", lot).where(F.col("_score_part") | (F.col("_lot") <= more))
    kind = F.when(F.col("_score_part"), "score").otherwise("diversity")
    position = F.row_number().over(Window.orderBy(F.desc("_score_part"), F.desc("score"), "id")) - 1
    return picked.withColumn("recommendation_type", kind).withColumn("position", position).drop("_rank", "_score_part", "_lot")


def recommend(rows: DataFrame, n: int = 20, ratio: float = 0.3, seed: int = 42, cut: int = CUT) -> DataFrame:
    """``n`` rows: the best by score, and some drawn from the rest of the ``cut`` best; scores must be above 0, asked after the cut."""
    first = split_size(n, ratio)
    return _drawn(best(rows, cut).where(F.col("score") > 0), F.lit(first), F.lit(n - first), seed)


def daily_batch(rows: DataFrame, date: str, n: int = 20, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """The day's recommendations among unread rows, with recommend_date and batch_order from 0."""
    batch = recommend(rows.where(F.col("status") == UNREAD), n, ratio, seed)
    return batch.withColumn("recommend_date", F.lit(date).cast("date")).withColumnRenamed("position", "batch_order")


def tag_batch(stored: DataFrame, date: str, n: int = 20, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """``stored`` with the day's tags written: old tags of the date go, and a row that is tagged anew leaves its older batch."""
    new = daily_batch(stored.drop("recommend_date", "batch_order"), date, n, ratio, seed).select(F.col("id").alias("_id"), F.col("batch_order").alias("_order"))
    day = F.lit(date).cast("date")
    both = stored.join(F.broadcast(new), F.col("id") == F.col("_id"), "left")  # n rows
    again = F.col("_id").isNotNull()
    cleared = F.col("recommend_date").eqNullSafe(day)
    date_ = F.when(again, day).when(~cleared, F.col("recommend_date"))
    order = F.when(again, F.col("_order")).when(~cleared, F.col("batch_order"))
    return both.withColumns({"recommend_date": date_, "batch_order": order}).drop("_id", "_order")


def recommend_with_offset(rows: DataFrame, limit: int, offset: int = 0, share: float = 0.3, seed: int = 42, cut: int = CUT) -> DataFrame:
    """The list after ``offset`` rows; if no more than ``limit`` are left all go by score, else a drawn part of int(limit * share) is mixed in. A null score counts as 0."""
    left = best(rows.withColumn("score", F.coalesce("score", F.lit(0.0))), cut).offset(offset)
    drawn = int(limit * share)
    total = F.count("*").over(Window.partitionBy())
    counted = left.withColumn("_total", total)
    all_fit = F.col("_total") <= limit
    return _drawn(counted, F.when(all_fit, F.col("_total")).otherwise(limit - drawn), F.when(all_fit, 0).otherwise(drawn), seed).drop("_total")


def without_shown(rows: DataFrame, shown: str) -> DataFrame:
    """Unread rows that the comma list ``shown`` does not name; an empty list names none."""
    ids = [x for x in shown.split(",") if x]
    unread = rows.where(F.col("status") == UNREAD)
    return unread.where(~F.col("id").isin(ids)) if ids else unread


def divider(ranked: DataFrame) -> DataFrame:
    """(divider): position of the first drawn row, null if there is none or it comes first."""
    first = F.min(F.when(F.col("recommendation_type") == "diversity", F.col("position")))
    return ranked.agg(F.when(first > 0, first).alias("divider"))


def score_batches(rows: DataFrame, size: int = CHUNK, cut: int = CUT) -> DataFrame:
    """The best unread rows with their batch number, ``size`` rows in each."""
    top = best(rows.where(F.col("status") == UNREAD), cut)
    return top.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1) / size).cast("int"))
