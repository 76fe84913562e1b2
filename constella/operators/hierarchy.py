"""Hierarchical clustering pieces (K6, K7).

* Single linkage cut at a distance: the clusters are exactly the connected
  components of the graph "distance <= threshold", found on the grid cells of
  DBSCAN (every row core) without a table of pairs.
* Ward / complete / average / single: the whole hierarchy is built (spanning
  tree for single, rounds of mutual nearest neighbours for ward), then cut to a
  number of clusters or at a height.
* HDBSCAN's exact building blocks: core distances and mutual-reachability
  weights on the kNN graph.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from constella.functions.ordering import global_row_number
from constella.operators import celltree
from constella.operators.neighbors import _finite, connected_components, dbscan, knn_join
from constella.session import settle


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def single_linkage_threshold(points: DataFrame, cols: Sequence[str], threshold: float,
                             id_col: str = "row_id") -> DataFrame:
    """(row_id, cluster): single-linkage clusters cut at ``threshold``,
    numbered 0.. by their smallest row id."""
    # rows sharing a coordinate are always together; over distinct coordinates
    # (numbered by their smallest row id) the components of "distance <=
    # threshold" are the clusters of DBSCAN in which every row is core: no
    # pairs inside a cell, one link between two cells
    pts = points.select(_q(id_col), *[_q(c) for c in cols]).dropna()
    coords = pts.groupBy(*[_q(c) for c in cols]).agg(F.min(_q(id_col)).alias("id"))
    spots = settle(global_row_number(coords, ["id", *cols], "__spot"))
    found = dbscan(spots, cols, threshold, 1, "__spot").where("cluster >= 0").select("__spot", "cluster")
    lab = spots.join(found, "__spot").select(*cols, "cluster")
    return pts.join(lab, list(cols)).select(id_col, "cluster")


#: clusters whose distances one task holds as a matrix
TASK_CLUSTERS = 4_000


def dendrogram(points: np.ndarray, size: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """All merges (a, b, height) of weighted points, by the chain of nearest
    neighbours: a pair that is nearest to each other merges, which gives the
    greedy hierarchy for linkages that never come nearer by merging. ``a`` and
    ``b`` are members of the two sides."""
    n = len(points)
    d2 = np.zeros((n, n))
    for i in range(points.shape[1]):
        d2 += (points[:, i, None] - points[None, :, i]) ** 2
    far = d2 * (2.0 * size[:, None] * size[None, :] / (size[:, None] + size[None, :])) if linkage == "ward" else np.sqrt(d2)
    np.fill_diagonal(far, np.inf)
    size = size.astype(float).copy()
    live = np.ones(n, bool)
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(live)))
        while True:
            a = chain[-1]
            row = far[a]
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        height = far[a, b]
        del chain[-2:]
        na, nb = size[a], size[b]
        if linkage == "ward":
            total = na + nb + size
            new = ((na + size) * far[a] + (nb + size) * far[b] - size * height) / total
        elif linkage == "complete":
            new = np.maximum(far[a], far[b])
        elif linkage == "average":
            new = (na * far[a] + nb * far[b]) / (na + nb)
        else:
            new = np.minimum(far[a], far[b])
        merges.append((a, b, float(np.sqrt(max(height, 0.0)) if linkage == "ward" else height)))
        live[b] = False
        new[~live] = np.inf
        new[a] = np.inf
        far[a, :], far[:, a] = new, new
        far[b, :], far[:, b] = np.inf, np.inf
        size[a] = na + nb
    return merges


def _ward_pairs(clusters: DataFrame, cols: list[str], cell_rows: int) -> DataFrame:
    """a, b, height of all pairs of clusters (id, size, centre) that are each
    other's nearest by Ward's distance (ties by ids), over a cell tree: first in
    the own cell, then in those near enough for the least size."""
    spark = clusters.sparkSession
    placed, tree = celltree.build(clusters, cols, cell_rows)
    placed = settle(placed)
    least = float(placed.agg(F.min("size")).first()[0])
    coords = ", ".join(f"`{c}` double" for c in cols)
    answer = "id long, height double, a long, b long"

    def nearest(ask, data):
        """Best (height, a, b) of every asking cluster among data."""
        q, p = ask[cols].to_numpy(float), data[cols].to_numpy(float)
        qi, pi = ask["id"].to_numpy(), data["id"].to_numpy()
        qs, ps = ask["size"].to_numpy(float), data["size"].to_numpy(float)
        height, other = np.full(len(q), np.inf), np.full(len(q), -1, np.int64)
        for k in range(0, len(q), 256):
            x = slice(k, k + 256)
            w = celltree.distances(q[x], p) * np.sqrt(2.0 * qs[x, None] * ps[None, :] / (qs[x, None] + ps[None, :]))
            w[qi[x, None] == pi[None, :]] = np.inf
            low, high = np.minimum(qi[x, None], pi[None, :]), np.maximum(qi[x, None], pi[None, :])
            best = w.min(1) if p.size else np.full(len(qi[x]), np.inf)
            tie = w == best[:, None]
            low = np.where(tie, low, np.iinfo(np.int64).max)
            first = low.min(1) if p.size else np.zeros(len(best), np.int64)
            high = np.where(tie & (low == first[:, None]), high, np.iinfo(np.int64).max)
            height[x] = best
            if p.size:
                other[x] = pi[np.argmin(high, 1)]
        return pd.DataFrame({"id": qi, "height": height, "a": np.minimum(qi, other), "b": np.maximum(qi, other)})

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.merge(nearest(frame, frame), on="id")[["id", "size", "cell", *cols, "height", "a", "b"]]

    one = settle(placed.select("id", "size", "cell", *cols).groupBy("cell").applyInPandas(
        own, f"id long, size double, cell int, {coords}, height double, a long, b long"))
    held = spark.sparkContext.broadcast(tree)

    def send(frames):
        t = held.value
        for frame in frames:
            for k in range(0, len(frame), 2000):
                f = frame.iloc[k:k + 2000]
                s = f["size"].to_numpy(float)
                reach = t.gaps(f[cols].to_numpy(float)) * np.sqrt(2.0 * s * least / (s + least))[:, None] <= f["height"].to_numpy(float)[:, None]
                reach &= t.rows[None, :] > 0
                reach[np.arange(len(f)), f["cell"].to_numpy()] = False
                r, c = np.nonzero(reach)
                out = f.iloc[r][["id", "size", *cols]].copy()
                out["cell"] = c.astype(np.int32)
                yield out

    visits = one.mapInPandas(send, f"id long, size double, {coords}, cell int").withColumn("asks", F.lit(True))
    both = visits.unionByName(placed.select("id", F.col("size").cast("double").alias("size"), *cols, "cell").withColumn("asks", F.lit(False)))

    def other_cells(frame: pd.DataFrame) -> pd.DataFrame:
        return nearest(frame[frame["asks"]], frame[~frame["asks"]])

    two = both.groupBy("cell").applyInPandas(other_cells, answer)
    best = one.select("id", "height", "a", "b").unionByName(two).groupBy("id").agg(F.min(F.struct("height", "a", "b")).alias("e"))
    # a pair that both its members name
    return best.groupBy("e.a", "e.b", "e.height").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b", "height")


def merge_tree(vertices: DataFrame, cols: Sequence[str], linkage: str, task_clusters: int = TASK_CLUSTERS,
               cell_rows: int = 2_000) -> DataFrame:
    """All merges (a, b, height) of the hierarchy over distinct points (id,
    size, coordinates).

    * single: the edges of the exact spanning tree.
    * ward: rounds that merge every pair of mutual nearest neighbours at once
      (a cluster is its size and centre), until one task can hold the rest.
    * complete, average: a distance is a property of all pairs of members, so
      one task holds the matrix; more than ``task_clusters`` distinct points
      are refused rather than summarised."""
    from constella.operators import density

    cols = list(cols)
    if linkage == "single":
        return density.spanning_tree(vertices.withColumn("core", F.lit(0.0)), cols).select(
            "a", "b", F.col("weight").alias("height"))
    clusters = settle(vertices.select("id", F.col("size").cast("double").alias("size"), *[_q(c) for c in cols]))
    merges = []
    while clusters.count() > task_clusters:
        if linkage != "ward":
            raise ValueError(f"{linkage} linkage holds a matrix of at most {task_clusters} distinct points; use ward or single")
        pairs = settle(_ward_pairs(clusters, cols, cell_rows))
        merges.append(pairs)
        sides = pairs.select(F.col("a").alias("id"), "a").unionByName(pairs.select(F.col("b").alias("id"), "a"))
        clusters = settle(clusters.join(sides, "id", "left").groupBy(F.coalesce("a", "id").alias("id")).agg(
            F.sum("size").alias("size"), *[(F.sum(_q(c) * F.col("size")) / F.sum("size")).alias(c) for c in cols]))

    def rest(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        ids = frame["id"].to_numpy()
        found = dendrogram(frame[cols].to_numpy(float), frame["size"].to_numpy(float), linkage)
        return pd.DataFrame([(ids[a], ids[b], h) for a, b, h in found], columns=["a", "b", "height"])

    out = settle(clusters.groupBy(F.lit(0).alias("all")).applyInPandas(
        lambda key, frame: rest(frame), "a long, b long, height double"))
    for m in merges:
        out = out.unionByName(m)
    return out


def agglomerative(points: DataFrame, cols: Sequence[str], k: int | None = 3, linkage: str = "ward",
                  distance_threshold: float | None = None, id_col: str = "row_id",
                  task_clusters: int = TASK_CLUSTERS) -> DataFrame:
    """(row_id, cluster) for ward, complete, average or single linkage, cut to
    ``k`` clusters or, with ``distance_threshold``, before the first merge at
    that height or above. Clusters are numbered from 0 by their smallest row id.

    Equal coordinates merge at height 0 and are never parted, so fewer distinct
    points than ``k`` give that many clusters. Rows with a null, NaN or infinite
    coordinate are left out; an empty table gives no row."""
    if linkage not in ("ward", "complete", "average", "single"):
        raise ValueError(f"unknown linkage {linkage!r}")
    cols = list(cols)
    pts = settle(_finite(points, cols, id_col))
    spots = settle(pts.groupBy(*[_q(c) for c in cols]).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("size")))
    merges = merge_tree(spots, cols, linkage, task_clusters)
    if distance_threshold is not None:
        kept = merges.where(F.col("height") < F.lit(float(distance_threshold)))
    else:
        cut = merges.orderBy(F.desc("height"), "a", "b").limit(max(int(k) - 1, 0)).select("a", "b")
        kept = merges.join(cut, ["a", "b"], "left_anti")
    comp = settle(connected_components(spots.select("id"), kept.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select("id", "component"))
    number = global_row_number(comp.select("component").distinct(), ["component"], "__rn").select(
        "component", (F.col("__rn") - 1).cast("int").alias("cluster"))
    lab = spots.join(comp, "id").join(number, "component").select(*[_q(c) for c in cols], "cluster")
    return pts.join(lab, cols).select(id_col, "cluster")


def core_distances(points: DataFrame, cols: Sequence[str], min_samples: int = 5,
                   id_col: str = "row_id") -> DataFrame:
    """Distance to the min_samples-th nearest point counting the point itself
    (HDBSCAN's convention), i.e. the (min_samples - 1)-th other point."""
    if min_samples <= 1:
        return points.select(_q(id_col), F.lit(0.0).alias("core_distance"))
    nb = knn_join(points, cols, min_samples - 1, id_col)
    return nb.groupBy(id_col).agg(F.max("distance").alias("core_distance"))


def mutual_reachability(points: DataFrame, cols: Sequence[str], k: int = 5, min_samples: int = 5,
                        id_col: str = "row_id") -> DataFrame:
    """Mutual-reachability weights max(core_a, core_b, d(a, b)) on the kNN
    edges (the graph HDBSCAN's spanning tree is built from)."""
    nb = knn_join(points, cols, k, id_col)
    core = core_distances(points, cols, min_samples, id_col)
    ca = core.select(F.col(id_col).alias("a"), F.col("core_distance").alias("ca"))
    cb = core.select(F.col(id_col).alias("b"), F.col("core_distance").alias("cb"))
    e = nb.select(F.col(id_col).alias("a"), F.col("neighbor_id").alias("b"), "distance")
    return e.join(ca, "a").join(cb, "b").select(
        "a", "b", F.greatest("ca", "cb", "distance").alias("mutual_reachability"))
