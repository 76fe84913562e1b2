"""Neighbour-graph layouts to 3-D: t-SNE (D4) and UMAP (D5), re-aimed as
Spark jobs (quality, not bit-exactness with the reference libraries).

Graph: the exact kNN join; each row's k distances form a bounded array,
so the per-row bandwidth search (perplexity for t-SNE, log2 k for UMAP) is an
Arrow-batched pandas UDF; symmetrisation is a union + groupBy over edges.

Layout iterations (batch gradient): attraction = the cached edge table joined
with the current coordinates and a grouped sum per row (t-SNE: edges lie by
their far end and are sent once to the near end); repulsion = the
current cloud summarised on a coarse grid (count and centroid per cell, at
most cells^3 rows, broadcast) and applied per row by a pandas UDF. Every
few iterations the coordinates are checkpointed, so lineage stays short and
a lost executor only replays a few steps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from constella.operators.neighbors import knn_join
from constella.operators.reduce import pca
from constella.session import stage

AX = ("x", "y", "z")
ROWS = 512  # rows that a task holds against all cells (or neighbours) at once


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _bandwidths(D: np.ndarray, mode: str, target: float) -> np.ndarray:
    """Binary search of every row (its neighbour distances) at once; a row that
    has met its target leaves the search."""
    out = np.zeros(D.shape)
    if not D.size:
        return out
    d2 = D ** 2
    E = d2 - d2.min(1, keepdims=True) if mode == "tsne" else np.maximum(D - D.min(1, keepdims=True), 0)
    rows = np.arange(len(D))
    lo, hi, beta = np.zeros(len(D)), np.full(len(D), np.inf), np.ones(len(D))
    for _ in range(64):
        p = np.exp(-E[rows] * beta[:, None])
        if mode == "tsne":
            p = p / p.sum(1, keepdims=True)
            err = -(p * np.log2(np.maximum(p, 1e-300))).sum(1) - target
        else:
            err = p.sum(1) - target
        out[rows] = p
        flat = err > 0   # too flat: sharpen
        lo, hi = np.where(flat, beta, lo), np.where(flat, hi, beta)
        beta = np.where(flat & np.isinf(hi), beta * 2, (beta + np.where(flat, hi, lo)) / 2)
        on = np.abs(err) >= 1e-5
        rows, lo, hi, beta = rows[on], lo[on], hi[on], beta[on]
        if not len(rows):
            break
    return out


def _bandwidth_udf(mode: str, target: float):
    """Per-row binary search over the row's neighbour distances."""

    @F.pandas_udf("array<double>")
    def fit(dists: pd.Series) -> pd.Series:
        sizes = np.array([len(d) for d in dists], dtype=int)
        out = np.empty(len(dists), dtype=object)
        for m in np.unique(sizes):
            for at in np.array_split(np.flatnonzero(sizes == m), -(-int((sizes == m).sum()) // ROWS)):
                found = _bandwidths(np.array([dists.iloc[i] for i in at], dtype=float), mode, target)
                for i, p in zip(at, found):
                    out[i] = p
        return pd.Series(out)

    return fit


def affinity_graph(points: DataFrame, cols: Sequence[str], k: int, mode: str, target: float,
                   id_col: str = "row_id") -> DataFrame:
    """Symmetric edge weights (i, j, w). t-SNE: p_ij = (p_j|i + p_i|j) / 2n;
    UMAP: w = a + b - a b over the two directions."""
    nb = knn_join(points, cols, k, id_col)
    rows = nb.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "distance")))
                                  .alias("nb"))  # k entries per row: bounded
    rows = rows.select(id_col, F.col("nb.neighbor_id").alias("ids"), F.col("nb.distance").alias("ds"))
    rows = rows.withColumn("ps", _bandwidth_udf(mode, target)(F.col("ds")))
    directed = rows.select(F.col(id_col).alias("i"), F.explode(F.arrays_zip("ids", "ps")).alias("e")).select(
        "i", F.col("e.ids").alias("j"), F.col("e.ps").alias("p"))
    both = directed.unionByName(directed.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    if mode == "tsne":
        n = points.count()
        return both.groupBy("i", "j").agg((F.sum("p") / F.lit(2.0 * n)).alias("w"))
    g = both.groupBy("i", "j").agg(F.collect_list("p").alias("ps"))  # at most 2 entries
    a, b = F.element_at("ps", 1), F.coalesce(F.try_element_at("ps", F.lit(2)), F.lit(0.0))
    return g.select("i", "j", (a + b - a * b).alias("w"))


def _grid_summary(coords: DataFrame, cells: int):
    """(rows [count, centroid x y z, cell i j k], lower corner, cell size,
    cells): at most cells^3 rows reach the driver."""
    b = coords.agg(*[F.min(a).alias(f"a{a}") for a in AX], *[F.max(a).alias(f"b{a}") for a in AX]).first()
    lo = np.array([b[f"a{a}"] for a in AX], dtype=float)
    size = np.array([max(b[f"b{a}"] - b[f"a{a}"], 1e-12) / cells for a in AX])
    key = [F.least(F.greatest(F.floor((F.col(a) - F.lit(float(lo[i]))) / F.lit(float(size[i]))), F.lit(0)),
                   F.lit(cells - 1)).alias(f"c{a}") for i, a in enumerate(AX)]
    rows = coords.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in AX]).collect()
    S = np.array([[r["n"], r["x"], r["y"], r["z"], r["cx"], r["cy"], r["cz"]] for r in rows], dtype=float)
    return S, lo, size, cells


def _repulsion_udf(spark, summary, mode: str, z_norm: float, a: float, b: float):
    """Far-field repulsion from the cell summaries; the row's own cell is
    left out (its near field comes exactly from the kNN edges)."""
    bc = spark.sparkContext.broadcast(summary)

    @F.pandas_udf("x double, y double, z double, zsum double")
    def rep(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        Y = np.column_stack([x.to_numpy(), y.to_numpy(), z.to_numpy()])
        force, zs = _repulsion(bc.value, Y, mode, z_norm, a, b)
        return pd.DataFrame({"x": force[:, 0], "y": force[:, 1], "z": force[:, 2], "zsum": zs})

    return rep


def _repulsion(summary, Y: np.ndarray, mode: str, z_norm: float, a: float, b: float):
    """(forces, share of Z) of rows from the cells, ``ROWS`` rows at a time:
    cells x ``ROWS`` numbers are held, whatever the batch."""
    S, lo, size, cells = summary
    side = np.array([cells * cells, cells, 1.0])
    own = np.clip(np.floor((Y - lo) / size), 0, cells - 1) @ side
    code = S[:, 4:7] @ side
    held = np.zeros(cells ** 3)
    known = ~np.isnan(code)
    held[code[known].astype(int)] = S[known, 0]
    inside = own[~np.isnan(own)].astype(int)
    total = S[:, 0].sum() * len(Y) - held[inside].sum()  # what the batch's rows meet, own cells left out
    force, zs = np.empty((len(Y), 3)), np.zeros(len(Y))
    for at in range(0, len(Y), ROWS):
        rows = slice(at, at + ROWS)
        diff = [Y[None, rows, i] - S[:, 1 + i, None] for i in range(3)]
        d2 = diff[0] * diff[0] + diff[1] * diff[1] + diff[2] * diff[2]
        cnt = np.where(own[None, rows] == code[:, None], 0.0, S[:, 0, None])
        if mode == "tsne":
            w = 1.0 / (1.0 + d2)
            coef = cnt * w * w
            for i in range(3):
                force[rows, i] = 4.0 * (coef * diff[i]).sum(0) / max(z_norm, 1e-12)
            zs[rows] = (cnt * w).sum(0)
        else:
            coef = cnt * (2.0 * b / ((0.001 + d2) * (1.0 + a * d2 ** b)))
            for i in range(3):
                force[rows, i] = np.clip(coef * diff[i], -4, 4).sum(0) / max(total, 1.0)
    return force, zs


def _attraction(edges: DataFrame, coords: DataFrame, mode: str, a: float, b: float) -> DataFrame:
    """Sums over each row's edges. t-SNE's ``edges`` lie by j: they meet y_j
    where they are, travel once to i, meet y_i there and are summed there. UMAP's
    repulsion is scaled by the rows of its batch, so its joins, which decide the
    batches, stay plain."""
    ci = coords.select(F.col("row_id").alias("i"), *[F.col(c).alias(f"i{c}") for c in AX])
    cj = coords.select(F.col("row_id").alias("j"), *[F.col(c).alias(f"j{c}") for c in AX])
    if mode == "tsne":
        e = edges.join(cj.hint("shuffle_hash"), "j").drop("j").join(ci.hint("shuffle_hash"), "i")
    else:
        e = edges.join(ci, "i").join(cj, "j")
    diff = [F.col(f"i{c}") - F.col(f"j{c}") for c in AX]
    d2 = sum([t * t for t in diff[1:]], diff[0] * diff[0])
    if mode == "tsne":
        wq = F.lit(1.0) / (F.lit(1.0) + d2)
        coef = F.lit(4.0) * F.col("w") * wq
        # near-field repulsion along the kNN edges: sum w^2 (y_i - y_j), and
        # the edges' share of the normaliser Z
        return e.groupBy(F.col("i").alias("row_id")).agg(
            *[F.sum(coef * dv).alias(f"g{c}") for c, dv in zip(AX, diff)],
            *[F.sum(wq * wq * dv).alias(f"n{c}") for c, dv in zip(AX, diff)],
            F.sum(wq).alias("z_near"))
    coef = F.lit(2.0 * a * b) * F.pow(d2, b - 1) / (F.lit(1.0) + F.lit(a) * F.pow(d2, b)) * F.col("w")
    coef = F.when(d2 > 0, coef).otherwise(F.lit(0.0))
    return e.groupBy(F.col("i").alias("row_id")).agg(
        *[F.sum(F.least(F.greatest(coef * dv, F.lit(-4.0)), F.lit(4.0))).alias(f"g{c}") for c, dv in zip(AX, diff)],
        *[F.lit(0.0).alias(f"n{c}") for c in AX], F.lit(0.0).alias("z_near"))


def _layout(points: DataFrame, edges: DataFrame, init: DataFrame, mode: str, iters: int, lr: float,
            cells: int = 8, a: float = 1.0, b: float = 1.0, exaggeration: float = 12.0) -> DataFrame:
    spark = points.sparkSession
    coords = stage(init.select("row_id", *AX), 0)
    if mode == "tsne":  # a fixed number of partitions: the cached edges keep their place by j
        edges = edges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "j")
    edges = edges.persist()
    z_norm = 1.0
    if mode == "tsne":  # the normaliser Z of the starting layout (far + near field)
        rep0 = _repulsion_udf(spark, _grid_summary(coords, cells), mode, 1.0, a, b)
        far = coords.select(rep0("x", "y", "z").alias("r")).agg(F.sum("r.zsum")).first()[0] or 0.0
        near = _attraction(edges, coords, mode, a, b).agg(F.sum("z_near")).first()[0] or 0.0
        z_norm = float(far + near) or 1.0
    for it in range(iters):
        summary = _grid_summary(coords, cells)
        rep = _repulsion_udf(spark, summary, mode, z_norm, a, b)
        ex = exaggeration if (mode == "tsne" and it < iters // 4) else 1.0
        att = _attraction(edges, coords, mode, a, b)
        r = coords.select("row_id", *AX, rep("x", "y", "z").alias("r"))
        j = r.join(att, "row_id", "left")
        step = lr if mode == "tsne" else lr * (1.0 - it / max(iters, 1))
        near_scale = 4.0 / max(z_norm, 1e-12)
        new = j.select("row_id", *[(F.col(c) + F.lit(step) * (
            (F.lit(-ex) * F.coalesce(F.col(f"g{c}"), F.lit(0.0))) + F.col(f"r.{c}")
            + F.lit(near_scale) * F.coalesce(F.col(f"n{c}"), F.lit(0.0)))).alias(c) for c in AX],
            (F.col("r.zsum") + F.coalesce(F.col("z_near"), F.lit(0.0))).alias("zsum"))
        new = stage(new, it, 2)  # a checkpoint every second step keeps plans short
        if mode == "tsne":
            z_norm = float(new.agg(F.sum("zsum")).first()[0] or 1.0)
        coords = new.select("row_id", *AX)
    return coords


def tsne(points: DataFrame, cols: Sequence[str], perplexity: float = 30.0, iters: int = 100,
         learning_rate: float | None = None, id_col: str = "row_id") -> DataFrame:
    """Perplexity clamped to [5, (n - 1) / 3]; k = 3 x perplexity
    neighbours; PCA initialisation scaled to std 1e-4 x 1e4 (the usual 1e-4 of
    the first axis); early exaggeration 12 for the first quarter."""
    pts = points.select(F.col(id_col).alias("row_id"), *[_q(c) for c in cols]).persist()
    n = pts.count()
    perp = max(5.0, min(perplexity, (n - 1) / 3.0))
    k = int(min(n - 1, math.ceil(3 * perp)))
    edges = affinity_graph(pts, cols, k, "tsne", math.log2(perp))
    init, model = pca(pts, cols, 3)
    s = float(np.sqrt(model.variances[0])) if len(model.variances) else 1.0
    init = init.select("row_id", *[(F.col(c) / F.lit(s if s > 0 else 1.0) * F.lit(1e-4 * 1e4)).alias(c) for c in AX])
    lr = learning_rate or max(n / 12.0 / 4.0, 50.0)
    # plain batch steps (no momentum / gains): the attraction on a row is
    # about 4 x exaggeration / n times its distances, so keep one step below
    # half of that distance or small inputs oscillate
    lr = min(lr, n / (4.0 * 12.0) * 0.5)
    return _layout(pts, edges, init, "tsne", iters, lr)


def umap_ab(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """The (a, b) of 1 / (1 + a d^(2b)) fitted to the min_dist curve
    (least squares on the driver, a few hundred points)."""
    x = np.linspace(0, spread * 3, 300)
    yv = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    best = (1.0, 1.0, np.inf)
    for b in np.linspace(0.3, 2.0, 171):
        xb = np.power(np.maximum(x, 1e-12), 2 * b)
        for a in np.exp(np.linspace(np.log(0.05), np.log(20), 200)):
            err = ((1.0 / (1.0 + a * xb) - yv) ** 2).sum()
            if err < best[2]:
                best = (a, b, err)
    return float(best[0]), float(best[1])


def umap(points: DataFrame, cols: Sequence[str], n_neighbors: int = 15, min_dist: float = 0.1, iters: int = 100,
         learning_rate: float = 1.0, id_col: str = "row_id") -> DataFrame:
    """Neighbours clamped to [2, n - 1]; fuzzy graph (rho, sigma per
    row), union a + b - ab; PCA initialisation scaled to [-10, 10];
    attraction on edges, grid-summary repulsion (in place of negative
    sampling); the learning rate decays linearly."""
    pts = points.select(F.col(id_col).alias("row_id"), *[_q(c) for c in cols]).persist()
    n = pts.count()
    k = int(max(2, min(n_neighbors, n - 1)))
    edges = affinity_graph(pts, cols, k, "umap", math.log2(k))
    a, b = umap_ab(min_dist)
    init, _ = pca(pts, cols, 3)
    m = init.agg(*[F.max(F.abs(c)).alias(c) for c in AX]).first()
    init = init.select("row_id", *[(F.col(c) / F.lit(max(m[c] or 1.0, 1e-12)) * 10.0).alias(c) for c in AX])
    return _layout(pts, edges, init, "umap", iters, learning_rate, a=a, b=b)


def neighbour_preservation(points: DataFrame, cols: Sequence[str], coords: DataFrame, k: int = 10) -> float:
    """Share of each row's k input-space neighbours that are also among its k
    layout neighbours (both exact kNN joins), averaged."""
    a = knn_join(points, cols, k).select("row_id", "neighbor_id")
    b = knn_join(coords, list(AX), k).select("row_id", "neighbor_id")
    hit = a.join(b, ["row_id", "neighbor_id"]).count()
    return hit / max(a.count(), 1)
