"""Gaussian mixtures (K8) and their criteria (K9).

EM runs here for every covariance. The E-step is a column expression (log
densities of k components, log-sum-exp). Diagonal and spherical covariances
take their M-step from one aggregate of k x (1 + 2d) sums. Full covariances are
held as Cholesky factors: each task evaluates them on blocks of rows and adds up
responsibilities, weighted sums and weighted outer products, one pass an
iteration; parameters on the driver are bounded by k x d x d.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from constella.functions.moments import moments, sum_over

LOG_2PI = math.log(2 * math.pi)


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


@dataclass
class Mixture:
    features: list[str]
    weights: np.ndarray    # (k,)
    means: np.ndarray      # (k, d)
    variances: np.ndarray  # (k, d) diagonal variances (spherical: equal per row)
    covariance: str
    log_likelihood: float | None = None
    n_iter: int = 0
    covariances: np.ndarray | None = None  # (k, d, d) of a full mixture

    def whitening(self) -> tuple[np.ndarray, np.ndarray]:
        """Inverse Cholesky factors and the constants of the log densities."""
        factors = np.linalg.cholesky(self.covariances)
        inverse = np.linalg.inv(factors)
        half = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
        with np.errstate(divide="ignore"):
            return inverse, np.log(self.weights) - 0.5 * len(self.features) * LOG_2PI - half

    def log_densities(self) -> list[Column]:
        out = []
        if self.covariances is not None:
            inverse, constant = self.whitening()
            for j in range(len(self.weights)):
                off = [_q(c) - F.lit(float(m)) for c, m in zip(self.features, self.means[j])]
                axes = []
                for i in range(len(off)):
                    terms = [off[a] * F.lit(float(inverse[j, i, a])) for a in range(i + 1)]
                    axis = sum(terms[1:], terms[0])
                    axes.append(axis * axis)
                out.append(F.lit(float(constant[j])) - 0.5 * sum(axes[1:], axes[0]))
            return out
        for j in range(len(self.weights)):
            terms = [((_q(c) - F.lit(float(self.means[j, i]))) ** 2) / F.lit(float(self.variances[j, i]))
                     for i, c in enumerate(self.features)]
            quad = sum(terms[1:], terms[0])
            const = math.log(self.weights[j]) - 0.5 * (len(self.features) * LOG_2PI
                                                       + float(np.sum(np.log(self.variances[j]))))
            out.append(F.lit(const) - 0.5 * quad)
        return out

    def e_step(self, df: DataFrame) -> DataFrame:
        """Row log-likelihood, responsibilities p0..p{k-1}, arg-max cluster."""
        lds = self.log_densities()
        mx = F.greatest(*lds) if len(lds) > 1 else lds[0]
        lse = mx + F.log(sum([F.exp(ld - mx) for ld in lds[1:]], F.exp(lds[0] - mx)))
        out = df.withColumn("__ll", lse)
        for j, ld in enumerate(lds):
            out = out.withColumn(f"p{j}", F.exp(ld - F.col("__ll")))
        probs = [F.col(f"p{j}") for j in range(len(lds))]
        best = F.greatest(*probs) if len(probs) > 1 else probs[0]
        idx = F.lit(len(lds) - 1)
        for j in range(len(lds) - 2, -1, -1):
            idx = F.when(probs[j] == best, F.lit(j)).otherwise(idx)
        return out.withColumn("cluster", idx.cast("int")).withColumn("max_prob", best).withColumnRenamed(
            "__ll", "log_likelihood")


def _m_step(df: DataFrame, mix: Mixture, reg: float = 1e-6) -> tuple[Mixture, float]:
    cols = mix.features
    k, d = mix.means.shape
    e = mix.e_step(df)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("log_likelihood").alias("ll")]
    for j in range(k):
        aggs.append(F.sum(f"p{j}").alias(f"r{j}"))
        for i, c in enumerate(cols):
            aggs.append(F.sum(F.col(f"p{j}") * _q(c)).alias(f"s{j}_{i}"))
            aggs.append(F.sum(F.col(f"p{j}") * _q(c) * _q(c)).alias(f"q{j}_{i}"))
    r = e.agg(*aggs).first()
    n = r["n"]
    w = np.array([r[f"r{j}"] for j in range(k)]) + 1e-12
    means = np.array([[r[f"s{j}_{i}"] / w[j] for i in range(d)] for j in range(k)])
    var = np.array([[r[f"q{j}_{i}"] / w[j] - means[j, i] ** 2 for i in range(d)] for j in range(k)])
    var = np.maximum(var, 0) + reg
    if mix.covariance == "spherical":
        var = np.repeat(var.mean(axis=1, keepdims=True), d, axis=1)
    return Mixture(cols, w / n, means, var, mix.covariance), float(r["ll"])


def _initial(df: DataFrame, cols: Sequence[str], k: int, seed: int) -> Mixture:
    """Start from k-means centres, unit-share weights, pooled variances."""
    from constella.operators.cluster import kmeans

    km = kmeans(df, cols, k=k, seed=seed)
    v = df.agg(*[F.var_pop(_q(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    var = np.array([[max(v[f"v{i}"] or 1.0, 1e-6) for i in range(len(cols))]] * k)
    return Mixture(list(cols), np.full(k, 1.0 / k), km.centres.copy(), var, "diag")


def gaussian_mixture(df: DataFrame, cols: Sequence[str], k: int = 3, covariance: str = "auto",
                     max_iter: int = 100, tol: float = 1e-3, seed: int = 42) -> Mixture:
    """EM for diag / spherical; ``auto`` picks spherical under 100 rows, diag
    under 500, else full. The log-likelihood never decreases."""
    cols = list(cols)
    data = df.select(*cols).dropna().persist()
    n = data.count()
    if covariance == "auto":
        covariance = "spherical" if n < 100 else ("diag" if n < 500 else "full")
    if covariance == "full":
        return _full(data, cols, k, max_iter, tol, seed)
    mix = _initial(data, cols, k, seed)
    mix.covariance = covariance
    prev = None
    it = 0
    for it in range(1, max_iter + 1):
        mix, ll = _m_step(data, mix)
        if prev is not None and abs(ll - prev) / max(n, 1) < tol:
            break
        prev = ll
    mix.log_likelihood = float(mix.e_step(data).agg(F.sum("log_likelihood")).first()[0])
    mix.n_iter = it
    return mix


def _full(data: DataFrame, cols, k, max_iter, tol, seed, reg: float = 1e-6) -> Mixture:
    """EM with full covariances from k-means centres and the pooled covariance.
    The log-likelihood, criteria and E-step all belong to the mixture that is
    returned."""
    n, _, squares = moments(data, cols)
    mix = _initial(data, cols, k, seed)
    d = len(cols)
    ridge = reg * np.eye(d)
    mix.covariance = "full"
    mix.covariances = np.repeat((squares / max(n, 1) + ridge)[None], k, axis=0)
    before, steps = None, 0
    while True:
        means, weights = mix.means, mix.weights
        inverse, constant = mix.whitening()

        def sums(x):
            logs = np.stack([constant[j] - 0.5 * (((x - means[j]) @ inverse[j].T) ** 2).sum(1) for j in range(k)], 1)
            top = logs.max(1, keepdims=True) if len(x) else np.zeros((0, 1))
            total = np.log(np.exp(logs - top).sum(1)) + top[:, 0]
            share = np.exp(logs - total[:, None])
            parts = [np.array([total.sum()]), share.sum(0)]
            for j in range(k):
                off = x - means[j]
                weighted = off * share[:, j, None]
                parts += [weighted.sum(0), (weighted.T @ off).ravel()]
            return np.concatenate(parts)

        total = sum_over(data, cols, sums)
        mix.log_likelihood, mix.n_iter = float(total[0]), steps
        done = before is not None and abs(mix.log_likelihood - before) / max(n, 1) < tol
        if done or steps >= max_iter:
            break
        before, steps = mix.log_likelihood, steps + 1
        size = np.maximum(total[1:1 + k], 1e-12)
        block = total[1 + k:].reshape(k, d + d * d)
        drift = block[:, :d] / size[:, None]
        spread = block[:, d:].reshape(k, d, d) / size[:, None, None] - drift[:, :, None] * drift[:, None, :]
        mix = Mixture(list(cols), size / size.sum(), means + drift, np.zeros((k, d)), "full", covariances=spread + ridge)
    mix.variances = np.diagonal(mix.covariances, axis1=1, axis2=2).copy()
    return mix


def criteria(df: DataFrame, mix: Mixture) -> DataFrame:
    """K9: log-likelihood, AIC, BIC and the mean / min of each row's largest
    membership probability."""
    k, d = mix.means.shape
    per_comp = d if mix.covariance in ("diag", "full") else 1
    if mix.covariance == "full":
        per_comp = d * (d + 1) // 2
    p = (k - 1) + k * d + k * per_comp
    e = mix.e_step(df.select(*mix.features).dropna())
    a = e.agg(F.count(F.lit(1)).alias("n"), F.sum("log_likelihood").alias("ll"), F.avg("max_prob").alias("mp"),
              F.min("max_prob").alias("mn"))
    return a.select(F.col("ll").alias("log_likelihood"),
                    (F.lit(2.0 * p) - 2 * F.col("ll")).alias("aic"),
                    (F.lit(float(p)) * F.log(F.col("n")) - 2 * F.col("ll")).alias("bic"),
                    F.col("mp").alias("mean_max_prob"), F.col("mn").alias("min_max_prob"))


def from_labels(df: DataFrame, cols: Sequence[str], label: str, covariance: str = "diag") -> Mixture:
    """A mixture whose components are the label groups (weights = shares,
    means, population variances or covariances): a deterministic parameter set."""
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = (df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(_q(cols[i]), _q(cols[j])).alias(f"c{i}_{j}") for i, j in pairs]).orderBy(label).collect())
    n = sum(r["n"] for r in rows)
    spread = np.zeros((len(rows), d, d))
    for g, r in enumerate(rows):
        for i, j in pairs:
            spread[g, i, j] = spread[g, j, i] = r[f"c{i}_{j}"]
    return Mixture(list(cols), np.array([r["n"] / n for r in rows]),
                   np.array([[r[f"m{i}"] for i in range(d)] for r in rows]),
                   np.diagonal(spread, axis1=1, axis2=2).copy(), covariance,
                   covariances=spread if covariance == "full" else None)
