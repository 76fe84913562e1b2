"""Neighbours on many columns: random-projection trees with exact re-ranking.

Boxes of a cell tree stop being selective above about eight columns, so the exact
join visits most cells there. Here every tree cuts the rows by random directions
at the medians of a bounded sample; rows of one leaf are compared exactly, and
the k nearest over all trees are kept. The answer is approximate: ``recall``
measures it against brute force on stated queries over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from constella.operators import celltree
from constella.operators.neighbors import _finite, _q
from constella.session import settle

SAMPLE = 20_000


def _grow(points: np.ndarray, leaf_share: float, rng, leaves: list):
    """Nested cuts (direction, value, left, right) down to ``leaf_share`` of
    the sample; a leaf is its number."""
    if len(points) <= max(leaf_share, 1.0):
        leaves.append(0)
        return len(leaves) - 1
    a, b = points[rng.choice(len(points), 2, replace=len(points) < 2)]
    way = a - b
    if not np.any(way):
        way = rng.normal(size=points.shape[1])
    along = points @ way
    value = float(np.median(along))
    left = along <= value
    if left.all() or not left.any():  # equal rows: nothing to cut
        leaves.append(0)
        return len(leaves) - 1
    return (way, value, _grow(points[left], leaf_share, rng, leaves), _grow(points[~left], leaf_share, rng, leaves))


def _place(tree, points: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int32)
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, tuple):
            left = points[rows] @ node[0] <= node[1]
            todo += [(node[2], rows[left]), (node[3], rows[~left])]
        else:
            out[rows] = node
    return out


def knn_forest(points: DataFrame, cols: Sequence[str], k: int, trees: int = 12, leaf_rows: int = 400,
               id_col: str = "row_id", seed: int = 5) -> DataFrame:
    """Approximate k nearest neighbours of every row (itself excluded): id_col,
    neighbor_id, rank, distance; distances are exact. A coordinate with many
    copies keeps k + 1 of them on the data side, as in ``knn_join``. Rows with
    null, NaN or infinite coordinates take no part."""
    cols = list(cols)
    pts = settle(_finite(points, cols, id_col))
    n = pts.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = (pts if share >= 1 else pts.sample(False, share, seed)).select(*[_q(c) for c in cols]).limit(2 * SAMPLE).toPandas().to_numpy(float)
    forest = []
    for t in range(trees if len(sample) else 0):
        forest.append(_grow(sample, leaf_rows * len(sample) / n, np.random.default_rng([seed, t]), []))
    held = pts.sparkSession.sparkContext.broadcast(forest)  # trees x n / leaf_rows cuts of the sample at most
    vector = ", ".join(f"`{c}` double" for c in cols)
    # copies beyond k + 1 ask, but are not asked for
    key = F.xxhash64(*[_q(c) for c in cols])
    copies = pts.groupBy(key.alias("spot")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > k + 1)
    heavy = pts.withColumn("spot", key).join(copies.select("spot"), "spot").select("spot", id_col)
    extra = heavy.withColumn("r", F.row_number().over(Window.partitionBy("spot").orderBy(id_col))).where(F.col("r") > k + 1).select(
        id_col, F.lit(False).alias("data"))
    rows = pts.join(extra, id_col, "left").withColumn("data", F.coalesce("data", F.lit(True)))

    def leaves(frames):
        for frame in frames:
            x = frame[cols].to_numpy(float)
            for t, tree in enumerate(held.value):
                yield frame.assign(tree=np.int32(t), leaf=_place(tree, x))

    spread = rows.select(F.col(id_col).alias("id"), *[_q(c) for c in cols], "data").mapInPandas(
        leaves, f"id long, {vector}, data boolean, tree int, leaf int")

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        data = frame[frame["data"].to_numpy(bool)]
        found, far = celltree.nearest(frame[cols].to_numpy(float), frame["id"].to_numpy(), data[cols].to_numpy(float),
                                      data["id"].to_numpy(), k)
        at, rank = np.nonzero(found >= 0)
        return pd.DataFrame({"id": frame["id"].to_numpy()[at], "n": found[at, rank], "d": far[at, rank]})

    pairs = spread.groupBy("tree", "leaf").applyInPandas(near, "id long, n long, d double")
    best = pairs.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "n"))), 1, k).alias("p"))
    return settle(best.select(F.col("id").alias(id_col), F.posexplode("p").alias("r", "p")).select(
        id_col, F.col("p.n").alias("neighbor_id"), (F.col("r") + 1).cast("int").alias("rank"), F.col("p.d").alias("distance")))


def recall(points: DataFrame, cols: Sequence[str], found: DataFrame, k: int, every: int = 50, id_col: str = "row_id") -> DataFrame:
    """One row: queries, recall. The queries are the rows whose id is divisible
    by ``every``, against all rows, in blocks; a neighbour counts as found when
    its distance is within the k-th exact one."""
    cols = list(cols)
    pts = settle(_finite(points, cols, id_col).select(F.col(id_col).alias("id"), *[_q(c) for c in cols]))
    asked = pts.where(F.col("id") % every == 0)
    # blocks of queries meet blocks of rows
    parts = max(1, points.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-asked.count() // 2_000))
    q = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("asks", F.lit(True))
    p = pts.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(False))

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        ask, data = frame[frame["asks"]], frame[~frame["asks"]]
        ids, far = celltree.nearest(ask[cols].to_numpy(float), ask["id"].to_numpy(), data[cols].to_numpy(float), data["id"].to_numpy(), k)
        at, rank = np.nonzero(ids >= 0)
        return pd.DataFrame({"id": ask["id"].to_numpy()[at], "d": far[at, rank]})

    close = settle(q.unionByName(p).groupBy("block", "part").applyInPandas(near, "id long, d double"))
    exact = close.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("ds"))
    got = found.join(exact.select(F.col("id").alias(id_col), F.element_at("ds", -1).alias("worst"), F.size("ds").alias("w")), id_col)
    hits = got.groupBy(id_col).agg((F.count_if(F.col("distance") <= F.col("worst") * (1 + 1e-12)) / F.max("w")).alias("r"))
    return hits.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.least("r", F.lit(1.0))).alias("recall"))
