"""Partitioning clusterers whose fit is a small set of centres.

K-means uses ``pyspark.ml.clustering.KMeans`` (k-means|| or random init;
best training cost over ``n_init`` seeds). Assignment afterwards is a column
expression over the k centres (argmin of squared distance), so labelling the
rows needs neither the ML vector UDF nor a join, and cluster ids are
renumbered deterministically by centre order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def sq_distance(cols: Sequence[str], centre: Sequence[float]) -> Column:
    expr = None
    for c, v in zip(cols, centre):
        t = (_q(c) - F.lit(float(v))) * (_q(c) - F.lit(float(v)))
        expr = t if expr is None else expr + t
    return expr


def nearest_centre(cols: Sequence[str], centres: np.ndarray) -> tuple[Column, Column]:
    """(index of the nearest centre, its squared distance); ties to the lower
    index. ``least`` over k distances, then the first index hitting it."""
    dists = [sq_distance(cols, c) for c in centres]
    best = F.least(*dists) if len(dists) > 1 else dists[0]
    idx = F.lit(len(centres) - 1)
    for i in range(len(centres) - 2, -1, -1):
        idx = F.when(dists[i] == best, F.lit(i)).otherwise(idx)
    return idx.cast("int"), best


@dataclass
class CentresModel:
    features: list[str]
    centres: np.ndarray  # (k, d), renumbered
    cost: float | None = None

    def assign(self, df: DataFrame, out: str = "cluster", dist: str | None = None) -> DataFrame:
        idx, d2 = nearest_centre(self.features, self.centres)
        df = df.withColumn(out, idx)
        return df.withColumn(dist, d2) if dist else df

    def inertia(self, df: DataFrame) -> float:
        _, d2 = nearest_centre(self.features, self.centres)
        return float(df.agg(F.sum(d2)).first()[0] or 0.0)


def renumber(centres: np.ndarray) -> np.ndarray:
    """Order centres lexicographically by coordinates: stable ids across seeds."""
    order = sorted(range(len(centres)), key=lambda i: tuple(np.round(centres[i], 12)))
    return centres[order]


def spark_tolerance(tol: float, mean_variance: float) -> float:
    """The reference's tolerance is relative: converged when the squared
    centre shift is <= tol * (mean feature variance). Spark's is an absolute
    shift distance, so the same rule is sqrt(tol * mean variance)."""
    return float(np.sqrt(max(tol * mean_variance, 1e-24)))


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 3, init: str = "k-means++", max_iter: int = 300,
           tol: float = 1e-4, n_init: int = 1, seed: int = 42, mean_variance: float | None = None) -> CentresModel:
    """K-means on Spark ML; the best of ``n_init`` seeds by training cost.

    ``tol`` has the reference's (relative) meaning; ``mean_variance`` saves an
    aggregate when the caller knows it. k is clamped to [2, n - 1] only by the
    caller (it needs a count)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    if mean_variance is None:
        r = df.agg(*[F.var_pop(_q(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
        mean_variance = float(np.mean([r[f"v{i}"] or 0.0 for i in range(len(cols))]))
    abs_tol = spark_tolerance(tol, mean_variance)
    data = VectorAssembler(inputCols=list(cols), outputCol="__features", handleInvalid="skip") \
        .transform(df.select(*cols)).select("__features")
    data = data.persist()
    try:
        best = None
        mode = "random" if init == "random" else "k-means||"
        for i in range(max(1, n_init)):
            km = KMeans(k=k, maxIter=max_iter, tol=abs_tol, seed=seed + i, initMode=mode, featuresCol="__features")
            model = km.fit(data)
            cost = model.summary.trainingCost
            if best is None or cost < best[0]:
                best = (cost, np.array([c.tolist() for c in model.clusterCenters()]))
    finally:
        data.unpersist()
    return CentresModel(list(cols), renumber(best[1]), best[0])


def centres_from_labels(df: DataFrame, cols: Sequence[str], label: str) -> tuple[list, np.ndarray]:
    """Per-label mean vectors (bounded by the number of labels)."""
    rows = df.groupBy(label).agg(*[F.avg(_q(c)).alias(c) for c in cols]).orderBy(label).collect()
    return [r[label] for r in rows], np.array([[r[c] for c in cols] for r in rows], dtype=float)


def elbow(scores: DataFrame, k_col: str = "k", inertia_col: str = "inertia") -> DataFrame:
    """The k after the largest second difference of inertia (K3); with fewer
    than three points, the first k. One small window over the score table."""
    from pyspark.sql import Window

    w = Window.orderBy(k_col)  # the score table has one row per candidate k
    d = scores.select(k_col, (F.lag(inertia_col).over(w) - 2 * F.col(inertia_col)
                              + F.lead(inertia_col).over(w)).alias("second_diff"))
    key = F.when(F.col("second_diff").isNotNull(), F.struct("second_diff", (-F.col(k_col)).alias("neg_k")))
    agg = d.agg(F.count(F.lit(1)).alias("n"), F.min(k_col).alias("first_k"),
                F.max_by(k_col, key).alias("elbow_k"))
    return agg.select(F.when(F.col("n") < 3, F.col("first_k")).otherwise(F.col("elbow_k")).alias("best_k"))
