"""Non-linear embeddings and kernel detectors that need a basis larger than
the input dimension: kernel PCA (D6) by the Nystroem method, landmark MDS
(D7), and a one-class SVM (A3) on random Fourier features.

Shape of every fit: a bounded set of landmarks / basis functions (m rows,
picked by md5 order) goes to the driver; the m x m (or D x D) statistics of
all rows are summed by Spark (per-partition numpy Gram sums, then one
grouped sum over matrix cells); the per-row projection is an Arrow-batched
pandas UDF with the small matrices broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from constella.operators.clean import sample_key


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def landmarks(df: DataFrame, cols: Sequence[str], m: int, seed: int = 42, id_col: str = "row_id") -> np.ndarray:
    rows = df.orderBy(sample_key(seed, id_col), _q(id_col)).limit(m).select(*cols).collect()
    return np.array([[r[c] for c in cols] for r in rows], dtype=float)


def _rbf(X: np.ndarray, L: np.ndarray, gamma: float) -> np.ndarray:
    d2 = (X * X).sum(1)[:, None] - 2 * X @ L.T + (L * L).sum(1)[None, :]
    return np.exp(-gamma * np.maximum(d2, 0))


def gram_sums(df: DataFrame, cols: Sequence[str], featurize) -> tuple[np.ndarray, np.ndarray, int]:
    """sum z z^T, sum z and n over all rows, z = featurize(X) per batch:
    numpy per partition, then a grouped sum over (i, j) cells (partial
    aggregation map-side), so the driver receives m^2 + m numbers."""
    cols = list(cols)
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
                           T.StructField("v", T.DoubleType())])

    def part(it):
        S, s, n = None, None, 0
        for pdf in it:
            X = pdf[cols].to_numpy(dtype=float)
            Z = featurize(X)
            S = Z.T @ Z if S is None else S + Z.T @ Z
            s = Z.sum(0) if s is None else s + Z.sum(0)
            n += len(X)
        if S is None:
            return
        m = S.shape[0]
        ii, jj = np.triu_indices(m)
        yield pd.DataFrame({"i": ii.astype(np.int32), "j": jj.astype(np.int32), "v": S[ii, jj]})
        yield pd.DataFrame({"i": np.full(m, -1, dtype=np.int32), "j": np.arange(m, dtype=np.int32), "v": s})
        yield pd.DataFrame({"i": [-2], "j": [0], "v": [float(n)]})

    rows = (df.select(*cols).dropna().mapInPandas(part, schema).groupBy("i", "j").agg(F.sum("v").alias("v"))
            .collect())
    cells = {(r["i"], r["j"]): r["v"] for r in rows}
    n = int(cells.get((-2, 0), 0))
    m = 1 + max([j for (i, j) in cells if i == -1], default=-1)
    S = np.zeros((m, m))
    s = np.zeros(m)
    for (i, j), v in cells.items():
        if i >= 0:
            S[i, j] = S[j, i] = v
        elif i == -1:
            s[j] = v
    return S, s, n


def _fix(V: np.ndarray) -> np.ndarray:
    for k in range(V.shape[1]):
        j = int(np.argmax(np.abs(V[:, k])))
        if V[j, k] < 0:
            V[:, k] = -V[:, k]
    return V


def _project_udf(spark, cols, fn, payload: dict, k: int):
    bc = spark.sparkContext.broadcast(payload)
    schema = ", ".join(f"{a} double" for a in ("x", "y", "z")[:k])

    @F.pandas_udf(schema)
    def project(*series: pd.Series) -> pd.DataFrame:
        X = np.column_stack([s.to_numpy(dtype=float, na_value=0.0) for s in series])
        Y = fn(bc.value, X)
        return pd.DataFrame({a: Y[:, i] for i, a in enumerate(("x", "y", "z")[:k])})

    return project(*[_q(c).cast("double") for c in cols])


def _nystroem_features(p: dict, X: np.ndarray) -> np.ndarray:
    return _rbf(X, p["L"], p["gamma"]) @ p["W"]


def _kpca_project(p: dict, X: np.ndarray) -> np.ndarray:
    return (_nystroem_features(p, X) - p["mu"]) @ p["V"]


def kernel_pca(df: DataFrame, cols: Sequence[str], n_components: int = 3, gamma: float | None = None,
               m: int = 100, seed: int = 42, id_col: str = "row_id") -> tuple[DataFrame, dict]:
    """RBF kernel PCA (gamma = 1 / d by default) via m Nystroem landmarks.
    Equals exact kernel PCA when the landmarks are all rows."""
    cols = list(cols)
    gamma = gamma if gamma is not None else 1.0 / len(cols)
    L = landmarks(df, cols, m, seed, id_col)
    Kmm = _rbf(L, L, gamma)
    ev, U = np.linalg.eigh(Kmm)
    keep = ev > 1e-10 * ev.max()
    W = U[:, keep] / np.sqrt(ev[keep])
    p = {"L": L, "gamma": gamma, "W": W}
    S, s, n = gram_sums(df, cols, lambda X: _nystroem_features(p, X))
    mu = s / n
    C = S / n - np.outer(mu, mu)
    lam, V = np.linalg.eigh(C)
    order = np.argsort(lam)[::-1][:n_components]
    V = _fix(V[:, order])
    p.update({"mu": mu, "V": V})
    k = min(n_components, 3)
    coords = df.select(_q(id_col), _project_udf(df.sparkSession, cols, _kpca_project, p, k).alias("e")) \
        .select(id_col, *[F.col(f"e.{a}") for a in ("x", "y", "z")[:k]])
    for a in ("x", "y", "z")[k:]:
        coords = coords.withColumn(a, F.lit(0.0))
    ratio = lam[order] / max(lam[lam > 0].sum(), 1e-300)
    return coords, {"eigenvalue_ratio": ratio.tolist(), "landmarks": len(L)}


def _mds_project(p: dict, X: np.ndarray) -> np.ndarray:
    d2 = (X * X).sum(1)[:, None] - 2 * X @ p["L"].T + (p["L"] * p["L"]).sum(1)[None, :]
    return -0.5 * (d2 - p["mean_d2"]) @ p["P"].T


def landmark_mds(df: DataFrame, cols: Sequence[str], n_components: int = 3, m: int = 200, seed: int = 42,
                 id_col: str = "row_id") -> tuple[DataFrame, dict]:
    """Classical MDS on m landmarks (driver, m x m), every row placed by
    distance-based triangulation (de Silva & Tenenbaum). Exact classical MDS
    when the input is itself a 3-D configuration."""
    cols = list(cols)
    L = landmarks(df, cols, m, seed, id_col)
    D2 = ((L[:, None, :] - L[None, :, :]) ** 2).sum(-1)
    mm = len(L)
    J = np.eye(mm) - np.ones((mm, mm)) / mm
    B = -0.5 * J @ D2 @ J
    ev, V = np.linalg.eigh(B)
    order = np.argsort(ev)[::-1][:n_components]
    ev, V = np.maximum(ev[order], 1e-12), _fix(V[:, order])
    P = (V / np.sqrt(ev)).T  # pseudo-inverse of the landmark coordinates
    p = {"L": L, "mean_d2": D2.mean(0), "P": P}
    k = min(n_components, 3)
    coords = df.select(_q(id_col), _project_udf(df.sparkSession, cols, _mds_project, p, k).alias("e")) \
        .select(id_col, *[F.col(f"e.{a}") for a in ("x", "y", "z")[:k]])
    for a in ("x", "y", "z")[k:]:
        coords = coords.withColumn(a, F.lit(0.0))
    land = L @ np.eye(len(cols))  # landmark stress on the driver (bounded by m^2)
    emb = V * np.sqrt(ev)
    dl = np.sqrt(((land[:, None] - land[None]) ** 2).sum(-1))
    de = np.sqrt(((emb[:, None] - emb[None]) ** 2).sum(-1))
    stress = float(np.sqrt(((dl - de) ** 2).sum() / max((dl ** 2).sum(), 1e-300)))
    return coords, {"landmark_stress": stress, "landmarks": mm}


# ------------------------------------------------------------------ A3
def _rff(p: dict, X: np.ndarray) -> np.ndarray:
    Xs = (X - p["mean"]) / p["std"]
    return np.sqrt(2.0 / p["W"].shape[1]) * np.cos(Xs @ p["W"] + p["b"])


def _ocsvm_score(p: dict, X: np.ndarray) -> np.ndarray:
    Z = _rff(p, X)
    return (p["rho"] - Z @ p["w"])[:, None]


def one_class_svm(df: DataFrame, cols: Sequence[str], nu: float = 0.1, n_features: int = 200, iters: int = 60,
                  lr: float = 0.5, seed: int = 42, id_col: str = "row_id") -> tuple[DataFrame, dict]:
    """A3: standardise, map to random Fourier features of the RBF kernel
    (gamma = 'scale' = 1 / (d var) after standardising = 1 / d), and solve the
    primal one-class objective 1/2 |w|^2 + 1/(nu n) sum max(0, rho - w.z) - rho
    by full-batch subgradient steps; each step's gradient is one
    mapInPandas + grouped sum (D + 2 numbers). Score = rho - w.z (high =
    anomalous); flagged above the (1 - nu) quantile."""
    from constella.operators.anomaly import threshold_flags

    cols = list(cols)
    st = df.agg(*[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(_q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    mean = np.array([st[f"m{i}"] for i in range(len(cols))])
    std = np.array([st[f"s{i}"] or 1.0 for i in range(len(cols))])
    std[std == 0] = 1.0
    rng = np.random.default_rng(seed)
    gamma = 1.0 / len(cols)
    W = rng.normal(0, np.sqrt(2 * gamma), (len(cols), n_features))
    b = rng.uniform(0, 2 * np.pi, n_features)
    p = {"mean": mean, "std": std, "W": W, "b": b}
    data = df.select(*cols).dropna().persist()
    schema = T.StructType([T.StructField("j", T.IntegerType()), T.StructField("v", T.DoubleType())])
    w = np.zeros(n_features)
    rho = 0.0
    n = data.count()
    for t in range(iters):
        cur = dict(p, w=w, rho=rho)
        bc = data.sparkSession.sparkContext.broadcast(cur)

        def grad(it, bc=bc):
            q = bc.value
            g = np.zeros(q["W"].shape[1])
            viol = 0.0
            for pdf in it:
                Z = _rff(q, pdf[cols].to_numpy(dtype=float))
                mask = (Z @ q["w"]) < q["rho"]
                g += Z[mask].sum(0)
                viol += float(mask.sum())
            yield pd.DataFrame({"j": np.arange(len(g) + 1, dtype=np.int32), "v": np.append(g, viol)})

        rows = data.mapInPandas(grad, schema).groupBy("j").agg(F.sum("v").alias("v")).collect()
        vec = np.zeros(n_features + 1)
        for r in rows:
            vec[r["j"]] = r["v"]
        gz, viol = vec[:n_features], vec[n_features]
        step = lr / np.sqrt(t + 1)
        w = w - step * (w - gz / (nu * n))
        rho = rho - step * (viol / (nu * n) - 1.0)
    p.update({"w": w, "rho": rho})
    bc = df.sparkSession.sparkContext.broadcast(p)

    @F.pandas_udf("double")
    def ocsvm_score(*series: pd.Series) -> pd.Series:
        X = np.column_stack([s.to_numpy(dtype=float, na_value=0.0) for s in series])
        return pd.Series(_ocsvm_score(bc.value, X)[:, 0])

    scored = df.select(_q(id_col), ocsvm_score(*[_q(c).cast("double") for c in cols]).alias("score")).persist()
    flagged, thr = threshold_flags(scored, nu)
    return flagged, {"rho": float(rho), "threshold": thr}
