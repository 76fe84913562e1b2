"""Clustering quality metrics from per-cluster aggregates.

Every metric here is exact and linear in the rows: per-cluster count, sum
vector and sum of squared norms are one grouped aggregate (k rows return to
the driver); per-row terms use them as literals. No pair of rows is ever
formed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from constella.operators import celltree

#: clusters that a silhouette expression holds as literals
LITERAL_CLUSTERS = 32


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def cluster_stats(df: DataFrame, cols: Sequence[str], label: str = "cluster", noise: int | None = -1):
    """labels, counts (k,), sums (k, d), sum of squared norms (k,)."""
    src = df if noise is None else df.where(_q(label) != noise)
    norm2 = sum([_q(c) * _q(c) for c in cols[1:]], _q(cols[0]) * _q(cols[0]))
    rows = (src.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(_q(c)).alias(f"s{i}")
                                                                     for i, c in enumerate(cols)],
                                   F.sum(norm2).alias("q")).orderBy(label).collect())
    labels = [r[label] for r in rows]
    n = np.array([r["n"] for r in rows], dtype=float)
    s = np.array([[r[f"s{i}"] for i in range(len(cols))] for r in rows], dtype=float).reshape(len(rows), len(cols))
    q = np.array([r["q"] for r in rows], dtype=float)
    return labels, n, s, q


def cluster_sizes(df: DataFrame, label: str = "cluster", noise: int = -1) -> DataFrame:
    """Sizes summary (K10): clusters, min/max/mean/population-std size, noise."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    real = F.col(label) != noise
    return sizes.agg(
        F.count_if(real).alias("n_clusters"),
        F.min(F.when(real, F.col("size"))).alias("min_size"),
        F.max(F.when(real, F.col("size"))).alias("max_size"),
        F.avg(F.when(real, F.col("size"))).alias("mean_size"),
        F.stddev_pop(F.when(real, F.col("size"))).alias("std_size"),
        F.coalesce(F.sum(F.when(~real, F.col("size"))), F.lit(0)).cast("bigint").alias("noise_count"),
        (F.coalesce(F.sum(F.when(~real, F.col("size"))), F.lit(0)) / F.sum("size")).alias("noise_ratio"))


def silhouette_sq(df: DataFrame, cols: Sequence[str], label: str = "cluster", noise: int = -1,
                  per_row: bool = False):
    """Exact silhouette under squared Euclidean distance on non-noise rows.

    For cluster C: sum_{y in C} |x - y|^2 = n_C |x|^2 - 2 x.S_C + Q_C, so a(x)
    (own cluster, self excluded) and b(x) (nearest other cluster) come from k
    literal triples. Spark's ``ClusteringEvaluator`` uses the same measure.
    More than ``LITERAL_CLUSTERS`` clusters make no expression: their triples
    go to the tasks as arrays (``_silhouettes``)."""
    labels, n, s, q = cluster_stats(df, cols, label, noise)
    src = df.where(_q(label) != noise)
    if len(labels) < 2:
        return src.select(_q(label), F.lit(0.0).alias("silhouette")) if per_row else \
            df.sparkSession.createDataFrame([(None,)], "silhouette double")
    if len(labels) > LITERAL_CLUSTERS:
        rows = _silhouettes(src, list(cols), label, labels, n, s, q)
        return rows if per_row else rows.agg(F.avg("silhouette").alias("silhouette"))
    x2 = sum([_q(c) * _q(c) for c in cols[1:]], _q(cols[0]) * _q(cols[0]))
    totals = []
    for i in range(len(labels)):
        dot = sum([_q(c) * F.lit(float(s[i, j])) for j, c in enumerate(cols)][1:],
                  _q(cols[0]) * F.lit(float(s[i, 0])))
        totals.append(F.lit(float(n[i])) * x2 - 2 * dot + F.lit(float(q[i])))
    own_n = F.lit(None).cast("double")
    a = F.lit(None).cast("double")
    for i, lab in enumerate(labels):
        own_n = F.when(_q(label) == lab, F.lit(float(n[i]))).otherwise(own_n)
        a = F.when(_q(label) == lab, totals[i] / F.lit(max(float(n[i]) - 1, 1.0))).otherwise(a)
    others = [F.when(_q(label) != lab, totals[i] / F.lit(float(n[i]))) for i, lab in enumerate(labels)]
    b = F.least(*others)
    sil = F.when(own_n <= 1, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    rows = src.select(_q(label), sil.alias("silhouette"))
    return rows if per_row else rows.agg(F.avg("silhouette").alias("silhouette"))


def _silhouettes(src: DataFrame, cols: list[str], label: str, labels: list, n, s, q) -> DataFrame:
    """Silhouettes against many clusters. total_C(x) / n_C is |x - mean_C|^2
    plus the variance of C, so the nearest other cluster is the nearest of the
    points (mean, root of the variance) to (x, 0): found by boxes, then counted
    from its sums."""
    mean = s / n[:, None]
    spread = np.sqrt(np.maximum(q / n - (mean * mean).sum(1), 0.0))
    held = src.sparkSession.sparkContext.broadcast((np.array(labels), n, s, q, np.column_stack([mean, spread])))
    kind = src.schema[label].dataType

    def score(frames):
        names, n, s, q, spots = held.value
        numbers = np.arange(len(names))
        for frame in frames:
            x = frame[cols].to_numpy(float)
            own = np.searchsorted(names, frame[label].to_numpy())
            found, _ = celltree.nearest(np.column_stack([x, np.zeros(len(x))]), own, spots, numbers, 1)
            norm = (x * x).sum(1)

            def total(c):
                return n[c] * norm - 2 * (x * s[c]).sum(1) + q[c]

            other = found[:, 0]
            a, b = total(own) / np.maximum(n[own] - 1, 1.0), total(other) / n[other]
            top = np.maximum(a, b)
            value = np.where(n[own] <= 1, 0.0, (b - a) / np.where(top == 0, 1.0, top))
            empty = (n[own] > 1) & ((top == 0) | np.isnan(value))
            yield pd.DataFrame({label: frame[label], "silhouette": pd.Series(value).where(~empty, None).to_numpy()})

    return src.select(_q(label), *[_q(c).cast("double").alias(c) for c in cols]).mapInPandas(
        score, T.StructType([T.StructField(label, kind), T.StructField("silhouette", T.DoubleType())]))


def calinski_harabasz(df: DataFrame, cols: Sequence[str], label: str = "cluster", noise: int = -1) -> DataFrame:
    """Between / within dispersion ratio (K12) from per-cluster aggregates."""
    labels, n, s, q = cluster_stats(df, cols, label, noise)
    k, N = len(labels), float(n.sum())
    spark = df.sparkSession
    if k < 2 or N <= k:
        return spark.createDataFrame([(None,)], "calinski_harabasz double")
    mu = s.sum(axis=0) / N
    mus = s / n[:, None]
    between = float((n * ((mus - mu) ** 2).sum(axis=1)).sum())
    within = float((q - (s * s).sum(axis=1) / n).sum())
    ch = (between / (k - 1)) / (within / (N - k)) if within > 0 else None
    return spark.createDataFrame([(ch,)], "calinski_harabasz double")


def davies_bouldin(df: DataFrame, cols: Sequence[str], label: str = "cluster", noise: int = -1) -> DataFrame:
    """mean over clusters of max_j (s_i + s_j) / d(c_i, c_j) (K13). s_i is the
    mean Euclidean distance to the centroid: one aggregate with the k
    centroids as literals."""
    labels, n, s, _ = cluster_stats(df, cols, label, noise)
    spark = df.sparkSession
    if len(labels) < 2:
        return spark.createDataFrame([(None,)], "davies_bouldin double")
    mus = s / n[:, None]
    src = df.where(_q(label) != noise)
    dist = F.lit(None).cast("double")
    for i, lab in enumerate(labels):
        d2 = sum([(_q(c) - F.lit(float(mus[i, j]))) ** 2 for j, c in enumerate(cols)][1:],
                 (_q(cols[0]) - F.lit(float(mus[i, 0]))) ** 2)
        dist = F.when(_q(label) == lab, F.sqrt(d2)).otherwise(dist)
    rows = src.groupBy(label).agg(F.avg(dist).alias("s")).collect()
    spread = {r[label]: r["s"] for r in rows}
    sc = np.array([spread[lab] for lab in labels])
    worst = []
    for i in range(len(labels)):
        ratios = [(sc[i] + sc[j]) / np.linalg.norm(mus[i] - mus[j]) for j in range(len(labels)) if j != i
                  and np.linalg.norm(mus[i] - mus[j]) > 0]
        worst.append(max(ratios) if ratios else 0.0)
    return spark.createDataFrame([(float(np.mean(worst)),)], "davies_bouldin double")
