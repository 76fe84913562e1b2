"""Dimensionality reduction to (row_id, x, y, z).

Centred PCA: one aggregate gives the mean vector and the d x d sample
covariance (d(d+1)/2 ``covar_samp`` columns, so the driver only ever sees
d^2 numbers); ``numpy.linalg.eigh`` runs on that small matrix; the projection
is a plain column expression (no UDF, no join). ``pyspark.ml.feature.PCA``
is not used because it does not centre the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from constella.functions.moments import moments

AXES = ("x", "y", "z")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


@dataclass
class PCAModel:
    features: list[str]
    mean: np.ndarray          # (d,)
    components: np.ndarray    # (k, d) rows are principal axes
    variances: np.ndarray     # (k,) explained variance (n - 1 denominator)
    total_variance: float
    n: int
    whiten: bool = False

    @property
    def explained_variance_ratio(self) -> np.ndarray:
        return self.variances / self.total_variance if self.total_variance > 0 else np.zeros_like(self.variances)

    @property
    def singular_values(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.variances, 0) * max(self.n - 1, 0))

    def feature_importance(self) -> dict[str, float]:
        """Mean absolute loading of each feature over the kept components."""
        imp = np.abs(self.components).mean(axis=0)
        return {f: float(v) for f, v in zip(self.features, imp)}

    def coordinate(self, k: int) -> Column:
        expr = F.lit(0.0)
        if len(self.features) > WIDE_COLUMNS:  # one array expression, not hundreds of terms
            def numbers(values):
                return F.array(*[F.lit(float(v)) for v in values])

            off = F.zip_with(F.array(*[_q(f) for f in self.features]), numbers(self.mean), lambda x, m: x - m)
            expr = F.aggregate(F.zip_with(off, numbers(self.components[k]), lambda x, w: x * w), expr, lambda a, x: a + x)
        for j, f in enumerate(self.features if len(self.features) <= WIDE_COLUMNS else []):
            w = float(self.components[k, j])
            if w != 0.0:
                expr = expr + (_q(f) - F.lit(float(self.mean[j]))) * F.lit(w)
        if self.whiten and self.variances[k] > 0:
            expr = expr / F.lit(float(np.sqrt(self.variances[k])))
        return expr

    def transform(self, df: DataFrame, keep: Sequence[str] = ("row_id",), pad_to: int = 3) -> DataFrame:
        """Coordinates as columns x, y, z (zero-padded when k < 3, D3)."""
        k = self.components.shape[0]
        coords = [self.coordinate(i).alias(AXES[i] if i < 3 else f"pc{i + 1}") for i in range(k)]
        coords += [F.lit(0.0).alias(AXES[i]) for i in range(k, pad_to)]
        return df.select(*[_q(c) for c in keep if c in df.columns], *coords)


#: beyond this many columns the products are summed in blocks, not as columns
WIDE_COLUMNS = 16


def covariance(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, sample covariance and row count in one distributed pass
    (rows with a null feature are left out, as a model fit requires)."""
    cols = list(cols)
    d = len(cols)
    clean = df.dropna(subset=cols)
    if d > WIDE_COLUMNS:
        n, mean, squares = moments(clean, cols)
        return mean, squares / max(n - 1, 1), n
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)]
    for i in range(d):
        for j in range(i, d):
            aggs.append(F.covar_samp(_q(cols[i]), _q(cols[j])).alias(f"c{i}_{j}"))
    r = clean.agg(*aggs).first()
    n = r["n"]
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(d)], dtype=float)
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v = r[f"c{i}_{j}"]
            cov[i, j] = cov[j, i] = 0.0 if v is None or np.isnan(v) else v
    return mean, cov, n


def fix_signs(components: np.ndarray) -> np.ndarray:
    """Deterministic orientation: the largest |loading| of each axis is positive."""
    out = components.copy()
    for k in range(out.shape[0]):
        j = int(np.argmax(np.abs(out[k])))
        if out[k, j] < 0:
            out[k] = -out[k]
    return out


def fit_pca(df: DataFrame, cols: Sequence[str], n_components: int = 3, whiten: bool = False) -> PCAModel:
    mean, cov, n = covariance(df, cols)
    d = len(cols)
    k = max(1, min(n_components, d, max(n, 1)))
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    comps = fix_signs(vecs[:, :k].T)
    return PCAModel(list(cols), mean, comps, np.maximum(vals[:k], 0.0), float(np.trace(cov)), n, whiten)


def pca(df: DataFrame, cols: Sequence[str], n_components: int = 3, whiten: bool = False,
        keep: Sequence[str] = ("row_id",)) -> tuple[DataFrame, PCAModel]:
    model = fit_pca(df, cols, n_components, whiten)
    return model.transform(df, keep), model


def embedding_variance(coords: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """Population variance per axis and in total."""
    v = coords.agg(*[F.var_pop(_q(a)).alias(f"var_{a}") for a in axes])
    return v.select("*", sum([F.col(f"var_{a}") for a in axes[1:]], F.col(f"var_{axes[0]}")).alias("var_total"))
