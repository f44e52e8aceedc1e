"""Preference clusters: weighted k-means over the vectors of rated articles, all restarts in the same passes over the rows.

Each restart draws its first centers by weight times squared distance (k-means++, exact: the row with the least exponential draw of that rate), one center of every
restart in a pass; then each pass moves the centers of all restarts that still move. A task adds up its rows, so what is shuffled are the sums of clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.sources.tables import CLICKED, DISLIKED, LIKED

WEIGHTS = {CLICKED: 1.0, LIKED: 2.0}
MOST, LEAST, SEED, RESTARTS = 10, 5, 42, 10
#: Passes of all restarts at most, and how far a center that has come to rest may still move.
PASSES, REST = 100, 1e-6
#: Components of vectors that a task reads in a pass; few vectors are few tasks, as there are many passes.
TASK = 1 << 20
CENTROIDS = "type string, cluster_id int, centroid array<float>"


def rated_vectors(rows: DataFrame, kind: str, vector: str = "vector") -> DataFrame:
    """(v, w) of the rows that the type learns from: liked and clicked ones by weight, or disliked ones."""
    have = rows.where(F.col(vector).isNotNull())
    if kind == "negative":
        return have.where(F.col("status") == DISLIKED).select(F.col(vector).alias("v"), F.lit(1.0).alias("w"))
    weight = F.when(F.col("status") == LIKED, WEIGHTS[LIKED]).otherwise(WEIGHTS[CLICKED])
    return have.where(F.col("status").isin(CLICKED, LIKED)).select(F.col(vector).alias("v"), weight.alias("w"))


def weighted_vectors(rows: DataFrame, kind: str, vector: str = "vector") -> DataFrame:
    """(v, w, n, h): each different vector once, with the weight and number of its rows and a hash. Vectors with a component that is null or no finite number take no part."""
    rated = rated_vectors(rows, kind, vector).select(F.col("v").cast("array<double>").alias("v"), "w")
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rated.where((F.size("v") > 0) & finite).groupBy("v").agg(F.sum("w").alias("w"), F.count("*").alias("n")).withColumn("h", F.xxhash64("v"))


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers between 0 and 1 by rows' hashes and a salt."""
    x = h.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centers; what lies within rounding of a center has none."""
    own = (x * x).sum(1)[:, None]
    found = own - 2 * np.einsum("nd,kd->nk", x, centers) + (centers * centers).sum(1)[None]  # row by row: a product of matrices rounds by a batch's size
    return np.where(found > 1e-12 * (own + 1), found, 0.0)


def _drawn(data: DataFrame, centers: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """The next center of every restart. What comes to the driver is one row for each."""

    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            x, w, h = np.array(part["v"].tolist()), part["w"].to_numpy(), part["h"].to_numpy()
            for run, own in enumerate(centers):
                rate = w * _squares(x, own).min(1) if len(own) else w
                with np.errstate(divide="ignore"):
                    key = -np.log(_uniform(h, (seed + run) * 1009 + len(own))) / rate
                k = int(key.argmin())
                if np.isfinite(key[k]):
                    yield pd.DataFrame({"run": [run], "key": [key[k]], "v": [x[k]]})

    best = data.mapInPandas(draws, "run int, key double, v array<double>").groupBy("run").agg(F.min(F.struct("key", "v"))["v"].alias("v"))
    found = {r["run"]: np.array([r["v"]]) for r in best.collect()}
    return [np.concatenate([own, found[run]]) if run in found and len(own) else found.get(run, own) for run, own in enumerate(centers)]


def _binary(data: DataFrame) -> tuple[int, int]:
    """Binary places that sums of weighted components, and of weighted squared distances, have in 62 bits. Whole sums are the same in any order of the rows."""
    most, weight, size = data.agg(F.max(F.array_max(F.transform("v", F.abs))), F.sum("w"), F.max(F.size("v"))).first()
    places = lambda bound: 61 - math.frexp(bound)[1]
    return places((most or 1.0) * (weight or 1.0)), places(4 * (size or 1) * (most or 1.0) ** 2 * (weight or 1.0))


def moved(data: DataFrame, centers: dict[int, np.ndarray], binary: tuple[int, int] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """run: (weighted means of the rows nearest to each center, weights, cost). A center without rows stays. What comes to the driver are the sums of clusters."""
    places, cost_places = binary or _binary(data)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {run: np.zeros((len(own), own.shape[1] + 2), np.int64) for run, own in centers.items()}
        for part in batches:
            if not len(part):
                continue
            x, w = np.array(part["v"].tolist()), part["w"].to_numpy()
            whole = w.astype(np.int64)
            moments = np.column_stack([np.rint(np.ldexp(x, places)).astype(np.int64) * whole[:, None], whole, np.zeros(len(x), np.int64)])
            for run, own in centers.items():
                far = _squares(x, own)
                nearest = far.argmin(1)
                moments[:, -1] = np.rint(np.ldexp(far[np.arange(len(x)), nearest], cost_places)).astype(np.int64) * whole
                order = np.argsort(nearest, kind="stable")
                found, begins = np.unique(nearest[order], return_index=True)
                total[run][found] += np.add.reduceat(moments[order], begins)
        rows = [(run, k, row) for run, own in total.items() for k, row in enumerate(own) if row[-2] > 0]
        yield pd.DataFrame(rows, columns=["run", "k", "s"])

    parts = data.mapInPandas(sums, "run int, k int, s array<long>").select("run", "k", F.posexplode("s").alias("i", "x"))
    total = {run: np.zeros((len(own), own.shape[1] + 2)) for run, own in centers.items()}
    for r in parts.groupBy("run", "k", "i").agg(F.sum("x").alias("x")).collect():
        at = r["i"] - total[r["run"]].shape[1]  # -2: the weight, -1: the cost
        total[r["run"]][r["k"], r["i"]] = r["x"] if at == -2 else math.ldexp(r["x"], -(cost_places if at == -1 else places))
    out = {}
    for run, own in centers.items():
        weight = total[run][:, -2]
        means = np.where(weight[:, None] > 0, total[run][:, :-2] / np.where(weight > 0, weight, 1)[:, None], own)
        out[run] = means, weight, float(total[run][:, -1].sum())
    return out


def fit_centroids(rows: DataFrame, kind: str, most: int = MOST, least: int = LEAST, seed: int = SEED, restarts: int = RESTARTS, vector: str = "vector") -> DataFrame | None:
    """(type, cluster_id, centroid) of the cheapest of ``restarts`` runs, or None if fewer than ``least`` vectors are there: the stored ones then stay.

    Repeated vectors count as often as they are there; of vectors of several lengths those of the most frequent (of equally frequent, the shortest) are clustered.
    A run ends when no center moves by more than ``REST``; after ``PASSES`` passes only the cheapest goes on, until it rests. Ties go to the first run.
    Sums are of whole numbers, so that the result does not depend on how the rows are dealt over tasks.
    """
    data = weighted_vectors(rows, kind, vector).persist()
    try:
        sizes = data.groupBy(F.size("v").alias("d")).agg(F.sum("n").alias("n"), F.count("*").alias("different")).orderBy(F.desc("n"), "d").first()
        if sizes is None or sizes["n"] < least:
            return None
        own = data.where(F.size("v") == sizes["d"]).coalesce(math.ceil(sizes["different"] * sizes["d"] / TASK))
        centers = [np.empty((0, sizes["d"]))] * restarts
        for _ in range(min(most, sizes["different"])):
            centers = _drawn(own, centers, seed)
        ends: dict[int, tuple[float, np.ndarray]] = {}
        going, binary, passes = dict(enumerate(centers)), _binary(own), 0
        while going:
            for run, (means, _, cost) in moved(own, going, binary).items():
                fell = run not in ends or cost < ends[run][0]
                ends[run] = cost, means
                if np.abs(means - going[run]).max() <= REST or not fell:
                    del going[run]
                else:
                    going[run] = means
            passes += 1
            if passes >= PASSES:  # the others have shown what they are worth; the cheapest goes on until it is at rest
                first = min(ends, key=lambda run: (ends[run][0], run))
                going = {run: own_ for run, own_ in going.items() if run == first}
        best = ends[min(ends, key=lambda run: (ends[run][0], run))][1]
    finally:
        data.unpersist()
    return rows.sparkSession.createDataFrame([(kind, k, c.tolist()) for k, c in enumerate(best)], CENTROIDS)  # at most `most` rows


def replace_centroids(stored: DataFrame, kind: str, new: DataFrame | None) -> DataFrame:
    """``stored`` with the centroids of one type replaced; unchanged if there are no new ones."""
    return stored if new is None else stored.where(F.col("type") != kind).unionByName(new)


def weighted_means(rows: DataFrame, vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """(type, label, centroid): means of the rated vectors by label, in place of clusters. Weights add up by vector before any is unfolded."""
    kind = F.when(F.col("status") == DISLIKED, "negative").otherwise("positive")
    weight = F.when(F.col("status") == LIKED, 2.0).otherwise(1.0)
    rated = rows.where(F.col("status").isin(CLICKED, LIKED, DISLIKED)).groupBy(key, kind.alias("type")).agg(F.sum(weight).alias("w"))
    parts = rated.join(vectors, key).select("type", "label", "w", F.posexplode("embedding").alias("k", "x"))
    means = parts.groupBy("type", "label", "k").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("c"))
    return means.groupBy("type", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda p: p["c"]).alias("centroid"))
