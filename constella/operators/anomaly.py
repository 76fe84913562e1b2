"""Anomaly detection: output (row_id, score, is_anomaly), high score = anomalous.

Isolation forest on Spark:
  * sampling: tree t takes the ``psi`` rows with the smallest hash
    u_t(row) = xxhash64(seed, t, row_id). Rows are only emitted for trees where
    u_t < p (p ~ 3 psi / n), so about 3 psi rows per tree are shuffled instead
    of n x trees; the psi smallest of those are the psi smallest overall.
  * fit: one ``applyInPandas`` group per tree (psi rows, bounded) grows the
    tree with numpy and returns its node table (< 2 psi rows).
  * score: node tables (trees x 2 psi rows) are broadcast; an Arrow-batched
    pandas UDF walks the trees in blocks of rows.
  * threshold: the exact (1 - contamination) quantile of the score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from constella.functions.moments import chi2_quantile, moments, sum_over
from constella.functions.quantiles import exact_quantiles

EULER_GAMMA = 0.5772156649015329


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def average_path(n: float) -> float:
    """c(n): mean path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


def _grow(X: np.ndarray, rng: np.random.Generator, limit: int):
    """Node arrays for one isolation tree (iterative, breadth first)."""
    feat, thr, left, right, size = [], [], [], [], []
    stack = [(np.arange(len(X)), 0, None, None)]
    # node ids are assigned in creation order; children filled afterwards
    nodes = []
    while stack:
        idx, depth, parent, side = stack.pop()
        nid = len(nodes)
        nodes.append(None)
        feat.append(-1)
        thr.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(len(idx))
        if parent is not None:
            (left if side == 0 else right)[parent] = nid
        if depth >= limit or len(idx) <= 1:
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if len(candidates) == 0:
            continue
        f = int(rng.choice(candidates))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[nid], thr[nid] = f, t
        go_left = sub[:, f] < t
        stack.append((idx[~go_left], depth + 1, nid, 1))
        stack.append((idx[go_left], depth + 1, nid, 0))
    return feat, thr, left, right, size


NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType())])


@dataclass
class Forest:
    features: list[str]
    feature: np.ndarray    # (trees, nodes) int, -1 = leaf
    threshold: np.ndarray  # (trees, nodes)
    left: np.ndarray
    right: np.ndarray
    leaf_adjust: np.ndarray  # (trees, nodes): c(size) at leaves
    psi: int
    depth_limit: int

    def arrays(self) -> dict:
        return {"feature": self.feature, "threshold": self.threshold, "left": self.left, "right": self.right,
                "leaf_adjust": self.leaf_adjust, "depth_limit": self.depth_limit}

    def path_lengths(self, X: np.ndarray) -> np.ndarray:
        return path_lengths(self.arrays(), X)

    def score_column(self, spark) -> Column:
        """Anomaly score 2^(-E[h(x)] / c(psi)) as an Arrow-batched pandas UDF;
        the node arrays travel once per executor as a broadcast."""
        bc = spark.sparkContext.broadcast(_walk_tables(self.arrays()))
        norm = average_path(self.psi)

        @F.pandas_udf("double")
        def iforest_score(*cols: pd.Series) -> pd.Series:
            X = np.column_stack([c.to_numpy(dtype=float, na_value=0.0) for c in cols])
            if norm <= 0:
                return pd.Series(np.full(len(X), 0.5))
            return pd.Series(np.power(2.0, -_walk(bc.value, X) / norm))

        return iforest_score(*[_q(c).cast("double") for c in self.features])


BLOCK = 4096  # rows that walk the trees together: their arrays stay in the processor's cache


def _walk_tables(forest: dict) -> tuple:
    """Per tree and place (a node has places 2 node and 2 node + 1): tested
    column, threshold, the right and the left child's first place, depth plus
    leaf adjustment; and the number of steps. A leaf is its own child, so a walk
    needs no test for having arrived."""
    feature, left, right = forest["feature"], forest["left"], forest["right"]
    trees, width = feature.shape
    own = np.broadcast_to(np.arange(width), (trees, width))
    inner = feature >= 0
    kids = np.stack([np.where(inner, right, own), np.where(inner, left, own)], axis=2).reshape(trees, 2 * width)
    depth = np.zeros((trees, width))
    for level in range(forest["depth_limit"]):
        tree, node = np.nonzero(inner & (depth == level))
        for side in (left, right):
            depth[tree, side[tree, node]] = level + 1
    return (np.repeat(np.where(inner, feature, 0), 2, axis=1), np.repeat(forest["threshold"], 2, axis=1), 2 * kids,
            np.repeat(depth + forest["leaf_adjust"], 2, axis=1), forest["depth_limit"])


def path_lengths(forest: dict, X: np.ndarray) -> np.ndarray:
    """Mean isolation depth of each row over all trees."""
    return _walk(_walk_tables(forest), X)


def _walk(tables: tuple, X: np.ndarray) -> np.ndarray:
    """A block of rows walks tree by tree, one step a level (depth <= log2
    psi)."""
    feature, threshold, kids, value, steps = tables
    n, trees = len(X), len(feature)
    out = np.empty(n)
    for a in range(0, n, BLOCK):
        block = np.ascontiguousarray(X[a:a + BLOCK])
        m = len(block)
        start = np.arange(m) * X.shape[1]
        found = np.empty((m, trees))
        for t in range(trees):
            at = np.zeros(m, dtype=np.int64)
            for _ in range(steps):
                go_left = block.take(start + feature[t].take(at)) < threshold[t].take(at)
                at = kids[t].take(at + go_left)
            found[:, t] = value[t].take(at)
        out[a:a + m] = found.mean(axis=1)
    return out


def fit_isolation_forest(df: DataFrame, cols: Sequence[str], n_trees: int = 100, max_samples: int = 256,
                         seed: int = 42, id_col: str = "row_id") -> Forest:
    cols = list(cols)
    n = df.count()
    psi = int(min(max_samples, n))
    if psi < 2:
        raise ValueError("isolation forest needs at least two rows")
    limit = int(math.ceil(math.log2(psi)))
    p = min(1.0, 3.0 * psi / n + 32.0 / n)
    src = df.select(_q(id_col).alias("__id"), *[_q(c).cast("double").alias(c) for c in cols])
    def u(t):
        return (F.abs(F.xxhash64(F.lit(seed), t, F.col("__id"))) % F.lit(1 << 53)).cast("double") \
            / F.lit(float(1 << 53))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["__u", "__id"])
        X = pdf[cols].to_numpy(dtype=float, na_value=0.0)
        rng = np.random.default_rng([seed, t])
        feat, thr, left, right, size = _grow(X, rng, limit)
        k = len(feat)
        return pd.DataFrame({"tree": np.full(k, t, dtype=np.int32), "node": np.arange(k, dtype=np.int32),
                             "feature": np.array(feat, dtype=np.int32), "threshold": np.array(thr, dtype=float),
                             "left": np.array(left, dtype=np.int32), "right": np.array(right, dtype=np.int32),
                             "size": np.array(size, dtype=np.int32)})

    # Large inputs (n >= 8 x trees x psi): one hash per row picks its tree
    # (floor(u * trees)) and its rank key inside that tree (frac(u * trees)),
    # so every tree samples psi rows uniformly from its own random share of
    # the data and only ~3 psi rows per tree are kept. Small inputs: every
    # tree samples independently from all rows (a hash per row and tree).
    disjoint = n >= 8 * n_trees * psi
    if disjoint:
        p = min(1.0, 3.0 * psi * n_trees / n)
    for _attempt in range(8):
        if disjoint:
            v = u(F.lit(-1)) * F.lit(float(n_trees))
            cand = src.select("*", F.floor(v).cast("int").alias("tree"), (v - F.floor(v)).alias("__u")) \
                .where(F.col("__u") < F.lit(p))
        else:
            picked = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: u(t) < F.lit(p))
            cand = src.select("*", F.explode(picked).alias("tree")).withColumn("__u", u(F.col("tree")))
        # literal rank limit: a partial top-psi per tree runs before the shuffle
        w = Window.partitionBy("tree").orderBy("__u", "__id")
        sample = cand.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= psi)
        nodes_pdf = sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
        roots = nodes_pdf[nodes_pdf["node"] == 0]
        # every tree must have drawn its psi rows (else the threshold was too
        # tight for this data: retry with a wider one; p = 1 takes every row)
        if p >= 1.0 or (len(roots) == n_trees and int(roots["size"].min()) >= psi):
            break
        p = min(1.0, p * 2)
    width = int(nodes_pdf["node"].max()) + 1
    shape = (n_trees, width)
    feature = np.full(shape, -1, dtype=np.int64)
    threshold = np.zeros(shape)
    left = np.zeros(shape, dtype=np.int64)
    right = np.zeros(shape, dtype=np.int64)
    adjust = np.zeros(shape)
    tr, nd = nodes_pdf["tree"].to_numpy(), nodes_pdf["node"].to_numpy()
    feature[tr, nd] = nodes_pdf["feature"].to_numpy()
    threshold[tr, nd] = nodes_pdf["threshold"].to_numpy()
    left[tr, nd] = np.maximum(nodes_pdf["left"].to_numpy(), 0)
    right[tr, nd] = np.maximum(nodes_pdf["right"].to_numpy(), 0)
    adjust[tr, nd] = [average_path(s) for s in nodes_pdf["size"].to_numpy()]
    return Forest(cols, feature, threshold, left, right, adjust, psi, limit)


def threshold_flags(scored: DataFrame, contamination: float, score: str = "score") -> tuple[DataFrame, float]:
    """is_anomaly = score above its exact (1 - contamination) quantile."""
    q = exact_quantiles(scored, [score], [1.0 - contamination])[(score, 1.0 - contamination)]
    thr = q if q is not None else float("inf")
    return scored.withColumn("is_anomaly", F.coalesce(_q(score) > F.lit(thr), F.lit(False))), thr


def isolation_forest(df: DataFrame, cols: Sequence[str], contamination: float = 0.1, n_trees: int = 100,
                     max_samples: int = 256, seed: int = 42, id_col: str = "row_id"):
    forest = fit_isolation_forest(df, cols, n_trees, max_samples, seed, id_col)
    scored = df.withColumn("score", forest.score_column(df.sparkSession))
    scored = scored.persist()
    flagged, thr = threshold_flags(scored, contamination)
    return flagged, thr


def estimate_contamination(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.3) -> DataFrame:
    """Share of rows outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] on any feature,
    clamped to [low, high] (A2)."""
    from constella.operators.clean import iqr_bounds

    b = iqr_bounds(df, cols)
    out = F.lit(False)
    for c in cols:
        lo, hi = b[c]
        if lo is not None:
            out = out | F.coalesce((_q(c) < F.lit(lo)) | (_q(c) > F.lit(hi)), F.lit(False))
    share = df.agg(F.avg(out.cast("double")).alias("outlier_share"))
    return share.select("outlier_share",
                        F.least(F.greatest(F.col("outlier_share"), F.lit(low)), F.lit(high)).alias("contamination"))


def score_summary(scored: DataFrame, score: str = "score", flag: str = "is_anomaly",
                  threshold: float | None = None) -> DataFrame:
    """count, ratio, mean score per side, min, max, threshold."""
    return scored.agg(
        F.count_if(_q(flag)).alias("n_anomalies"),
        (F.count_if(_q(flag)) / F.count(F.lit(1))).alias("anomaly_ratio"),
        F.avg(F.when(_q(flag), _q(score))).alias("mean_score_anomalous"),
        F.avg(F.when(~_q(flag), _q(score))).alias("mean_score_normal"),
        F.min(_q(score)).alias("min_score"), F.max(_q(score)).alias("max_score"),
        F.lit(threshold).cast("double").alias("threshold"))


# ------------------------------------------------------------------ A5
def _moments(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and population (maximum-likelihood) covariance in one pass."""
    d = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(_q(cols[i]), _q(cols[j])).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    r = df.agg(*aggs).first()
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(d)])
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
    return mean, cov, r["n"]


def mahalanobis_expr(cols: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared Mahalanobis distance as a column expression (d x d literals)."""
    inv = np.linalg.pinv(cov)
    diffs = [_q(c) - F.lit(float(m)) for c, m in zip(cols, mean)]
    expr = None
    for i in range(len(cols)):
        for j in range(len(cols)):
            t = diffs[i] * diffs[j] * F.lit(float(inv[i, j]))
            expr = t if expr is None else expr + t
    return expr


#: starts of the robust fit; rows of the sample they are tried on
MCD_STARTS, MCD_SAMPLE, MCD_KEPT = 100, 2_000, 10
_EDGES = 64


def _fit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(0)
    off = x - mean
    return mean, off.T @ off / len(x)


def _squared(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    off = x - mean
    return np.einsum("ij,jk,ik->i", off, np.linalg.pinv(cov), off)


def _log_det(cov: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(cov)
    return float(value) if sign > 0 else -np.inf


def _sampled_starts(x: np.ndarray, frac: float, seed: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Fits and cut-offs of the best starts: subsets of d + 1 rows, two
    concentration steps each, the ``MCD_KEPT`` least determinants stay."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    h = max(min(n, int(np.ceil(frac * n))), min(n, d + 1))
    fits = []
    for _ in range(MCD_STARTS):
        rows = rng.choice(n, min(n, d + 1), replace=False)
        mean, cov = _fit_rows(x[rows])
        while len(rows) < n and _log_det(cov) == -np.inf:  # rows in one plane: more of them
            rows = np.append(rows, rng.integers(n))
            mean, cov = _fit_rows(x[rows])
            if len(rows) > 10 * (d + 1):
                break
        for _ in range(2):
            near = np.argsort(_squared(x, mean, cov), kind="stable")[:h]
            mean, cov = _fit_rows(x[near])
        fits.append((_log_det(cov), len(fits), mean, cov))
    fits.sort(key=lambda f: f[:2])
    return [(m, c, float(np.sort(_squared(x, m, c))[h - 1])) for _, _, m, c in fits[:MCD_KEPT]]


def _concentrate(src: DataFrame, cols: Sequence[str], fits: list, h: int) -> list:
    """One concentration step of all fits in one pass: distances fall into bins
    around each fit's last cut-off; every bin holds its rows' count, sum and
    products, so the moments of the h nearest rows come from whole bins and a
    share of the one that the h-th row is in. Gives (log determinant, mean,
    covariance, cut-off) of the next fits."""
    d = len(cols)
    width = 1 + d + d * d
    edges = [cut * np.concatenate([np.geomspace(0.1, 0.9, 8), np.linspace(0.92, 1.08, _EDGES - 17), np.geomspace(1.1, 30, 9)])
             for _, _, cut in fits]
    inverses = [np.linalg.pinv(c) for _, c, _ in fits]

    def measure(x):
        out = np.zeros((len(fits), _EDGES + 1, width))
        for f, (mean, _, _) in enumerate(fits):
            off = x - mean
            bins = np.searchsorted(edges[f], np.einsum("ij,jk,ik->i", off, inverses[f], off), "left")
            for b in np.unique(bins):
                part = off[bins == b]
                out[f, b] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        return out.ravel()

    total = sum_over(src, cols, measure).reshape(len(fits), _EDGES + 1, width)
    out = []
    for f, (mean, _, cut) in enumerate(fits):
        upto = np.cumsum(total[f, :, 0])
        at = int(np.searchsorted(upto, h, "left"))
        before = upto[at - 1] if at else 0.0
        share = (h - before) / max(total[f, at, 0], 1.0)
        sums = total[f, :at].sum(0) + share * total[f, at]
        drift = sums[1:1 + d] / h
        cov = sums[1 + d:].reshape(d, d) / h - np.outer(drift, drift)
        low = edges[f][at - 1] if at else 0.0
        high = edges[f][min(at, _EDGES - 1)]
        out.append((_log_det(cov), mean + drift, cov, max(low + share * max(high - low, 0.0), 1e-300)))
    return out


def elliptic_envelope(df: DataFrame, cols: Sequence[str], contamination: float = 0.1,
                      support_fraction: float | None = None, max_steps: int = 8, seed: int = 42,
                      id_col: str = "row_id") -> tuple[DataFrame, dict]:
    """Robust covariance by the fast minimum covariance determinant. Many starts
    are tried on a bounded sample (``MCD_SAMPLE`` rows, by hash of the id); the
    best go on together over all rows, one pass a concentration step, until
    the least determinant no longer falls. The raw fit is made consistent by
    the median distance, rows within the 97.5 % chi-square bound are fitted
    again, and that fit scores the rows (squared Mahalanobis distance; flagged
    above the (1 - contamination) quantile). At most ``max_steps`` + 2 passes
    fit the model. Rows with a null are left out; no row gives no score."""
    cols = list(cols)
    src = df.select(_q(id_col), *[_q(c).cast("double").alias(c) for c in cols]).dropna().persist()
    n, d = src.count(), len(cols)
    frac = support_fraction if support_fraction is not None else min((n + d + 1) / (2.0 * max(n, 1)), 1.0)
    if n < 100 and support_fraction is None:
        frac = 0.8
    if not n:
        return src.select(_q(id_col), F.lit(0.0).alias("score"), F.lit(False).alias("is_anomaly")), {
            "location": [0.0] * d, "covariance": np.zeros((d, d)).tolist(), "determinant": None, "threshold": None, "passes": 0}
    h = max(min(n, int(np.ceil(frac * n))), min(n, d + 1))
    chosen = src if n <= MCD_SAMPLE else src.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(MCD_SAMPLE)
    fits = _sampled_starts(chosen.orderBy(id_col).select(*cols).toPandas().to_numpy(float), h / n, seed)
    best, passes = None, 0
    while passes < max_steps:
        passes += 1
        steps = _concentrate(src, cols, fits, h)
        top = min(steps, key=lambda s: s[0])
        better = best is None or top[0] < best[0] - 1e-9 * max(1.0, abs(best[0]))
        if better:
            best = top
        else:
            break
        # after two passes only the leaders go on
        steps.sort(key=lambda s: s[0])
        fits = [(m, c, cut) for _, m, c, cut in (steps if passes < 2 else steps[:2])]
    _, mean, cov, _ = best
    median = exact_quantiles(src.withColumn("__d2", mahalanobis_expr(cols, mean, cov)), ["__d2"], [0.5])[("__d2", 0.5)]
    factor = median / chi2_quantile(0.5, d) if median and median > 0 else 1.0
    inside = mahalanobis_expr(cols, mean, cov * factor) < F.lit(chi2_quantile(0.975, d))
    m, mean2, squares = moments(src.where(inside), cols)
    if m > d:
        mean, cov = mean2, squares / m
    scored = src.select(_q(id_col), mahalanobis_expr(cols, mean, cov).alias("score"))
    flagged, thr = threshold_flags(scored, contamination)
    return flagged, {"location": mean.tolist(), "covariance": cov.tolist(), "determinant": float(np.linalg.det(cov)),
                     "threshold": thr, "passes": passes + 2}


# ------------------------------------------------------------------ A6
def ensemble(scores: dict[str, DataFrame], weights: dict[str, float] | None = None, vote_share: float = 0.5,
             score_quantile: float = 0.9, id_col: str = "row_id") -> DataFrame:
    """Combine detectors (each: id, score with high = anomalous, is_anomaly):
    min-max normalised weighted score sum; anomalous when at least
    ``vote_share`` of the detectors flag the row OR the combined score reaches
    its ``score_quantile``. One union, one grouped sum per row; the per-
    detector min/max are a d-row aggregate."""
    names = list(scores)
    w = weights or {n: 1.0 for n in names}
    tot = sum(w[n] for n in names)
    parts = [scores[n].select(_q(id_col), F.lit(n).alias("detector"), F.col("score").cast("double").alias("score"),
                              F.col("is_anomaly").cast("int").alias("vote")) for n in names]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    rng = {r["detector"]: (r["lo"], r["hi"]) for r in
           u.groupBy("detector").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()}
    norm = F.lit(None).cast("double")
    for n in names:
        lo, hi = rng.get(n, (0.0, 0.0))
        lo = lo if lo is not None else 0.0
        hi = hi if hi is not None else 0.0
        norm = F.when(F.col("detector") == n, (F.col("score") - F.lit(lo)) / F.lit(hi - lo + 1e-8)
                      * F.lit(w[n] / tot)).otherwise(norm)
    per_row = u.withColumn("weighted", norm).groupBy(id_col).agg(
        F.sum("weighted").alias("ensemble_score"), F.sum("vote").alias("votes"))
    thr = exact_quantiles(per_row, ["ensemble_score"], [score_quantile])[("ensemble_score", score_quantile)]
    k = len(names)
    return per_row.select(
        id_col, "ensemble_score", F.col("votes").cast("int").alias("votes"),
        ((F.col("votes") >= F.lit(k * vote_share)) | (F.col("ensemble_score") >= F.lit(thr))).alias("is_anomaly"),
        (F.col("votes") / F.lit(float(k))).alias("agreement"))
