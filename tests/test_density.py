"""Cell tree, exact neighbours, spanning tree and hierarchical density
clustering against plain numpy versions."""

import numpy as np
import pytest

from constella.operators import celltree
from constella.operators import density as H
from constella.operators import neighbors as N

XYZ = ["x", "y", "z"]


def frame(spark, points, cols=None):
    cols = cols or XYZ[:points.shape[1]]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(points)],
                                 "row_id long, " + ", ".join(f"{c} double" for c in cols))


def plain_distances(points):
    return np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))


def plain_neighbours(points, k):
    d = plain_distances(points)
    return {i: [j for _, j in sorted((d[i, j], j) for j in range(len(points)) if j != i)[:k]] for i in range(len(points))}


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r["row_id"], []).append((r["rank"], r["neighbor_id"]))
    return {i: [j for _, j in sorted(v)] for i, v in out.items()}


@pytest.fixture(scope="module")
def cloud():
    """Two blobs, a thin bridge, one coordinate with many copies, a far point."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.05, (150, 3)), rng.normal(5, 1, (100, 3)), np.zeros((45, 3)),
                        [[5.0, 5.0, 5.0], [5.0, 5.0, 5.0], [1e7, 0.0, 0.0]]])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("cell_rows", [20_000, 40, 9])
def test_neighbours_over_any_number_of_cells(spark, cloud, cell_rows):
    got = found(N.knn_join(frame(spark, cloud), XYZ, 4, cell_rows=cell_rows).collect())
    assert got == plain_neighbours(cloud, 4)


def test_a_far_point_does_not_change_the_work(spark, cloud):
    """Distances that the two passes compute, with and without a far point."""
    near = np.unique(cloud[np.abs(cloud).max(1) < 1e6], axis=0)
    far = np.concatenate([near, [[1e12, -1e12, 3.0]]])
    counts = []
    for points in (near, far):
        placed, tree = celltree.build(frame(spark, points), XYZ, cell_rows=30)
        assert int(tree.rows.sum()) == len(points) and tree.rows.max() <= 120
        counts.append(sum(r ** 2 for r in tree.rows.tolist()))
    assert counts[1] < 1.1 * counts[0]


def test_neighbours_of_few_null_and_infinite_rows(spark):
    rows = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, None, 0.0), (4, float("nan"), 1.0), (5, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double")
    assert found(N.knn_join(df, ["x", "y"], 3).collect()) == {1: [2], 2: [1]}
    assert N.knn_join(df.limit(0), ["x", "y"], 3).count() == 0


def plain_tree(points, core):
    """Weights of the spanning tree of mutual reachability, ascending."""
    w = np.maximum(np.maximum(plain_distances(points), core[:, None]), core[None, :])
    edges = sorted((w[i, j], i, j) for i in range(len(points)) for j in range(i))
    up, out = list(range(len(points))), []

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for weight, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            up[a] = b
            out.append((weight, i, j))
    return out


def plain_hdbscan(points, least, min_samples, epsilon=0.0):
    """Top-down: cut the heaviest edge, keep parts of ``least`` rows."""
    d = np.sort(plain_distances(points), 1)
    core = d[:, min_samples - 1]
    tree = plain_tree(points, core)
    clusters = []  # [parent, birth, stability, rows, children, death]

    def parts(rows, edges):
        near = {r: [] for r in rows}
        for w, i, j in edges:
            near[i].append(j)
            near[j].append(i)
        out, seen = [], set()
        for r in rows:
            if r not in seen:
                stack, part = [r], set()
                while stack:
                    x = stack.pop()
                    if x not in part:
                        part.add(x)
                        stack += near[x]
                seen |= part
                out.append(part)
        return out

    leave = {}

    def grow(rows, edges, parent, birth):
        me = len(clusters)
        clusters.append([parent, birth, 0.0, set(rows), [], 0.0])
        if parent is not None:
            clusters[parent][4].append(me)
        while True:
            if not edges:
                break
            w, edges = edges[-1], edges[:-1]
            lam = 1 / w[0]
            a, b = sorted(parts(rows, edges), key=len)[-1], None
            sides = parts(rows, edges)
            big = [s for s in sides if len(s) >= least]
            for s in sides:
                if len(s) < least or len(big) == 2:
                    clusters[me][2] += len(s) * (lam - birth)
                    clusters[me][5] = lam
                if len(s) < least:
                    for r in s:
                        leave[r] = (me, lam)
            if len(big) == 2:
                for s in big:
                    grow(s, [e for e in edges if e[1] in s], me, lam)
                return
            if not big:
                return
            rows = big[0]
            edges = [e for e in edges if e[1] in rows]

    grow(set(range(len(points))), tree, None, 0.0)
    chosen, score = {}, {}
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(score[k] for k in clusters[c][4])
        chosen[c] = c > 0 and clusters[c][2] >= below
        score[c] = max(clusters[c][2], below)

    def top(c, flags):
        best = -1
        while c is not None:
            if flags[c]:
                best = c
            c = clusters[c][0]
        return best

    flags = {c: chosen[c] and top(c, chosen) == c for c in chosen}
    if epsilon:
        raised = dict.fromkeys(flags, False)
        for c in [c for c in flags if flags[c]]:
            if 1 / clusters[c][1] < epsilon:
                while clusters[c][0] != 0:
                    c = clusters[c][0]
                    if 1 / clusters[c][1] > epsilon:
                        break
            raised[c] = True
        flags = raised
    labels, prob = [], []
    for r in range(len(points)):
        c, lam = leave[r]
        t = top(c, flags)
        labels.append(t)
        prob.append(0.0 if t < 0 else min(lam, clusters[t][5]) / clusters[t][5])
    order = {c: k for k, c in enumerate(sorted({c for c in labels if c >= 0}, key=lambda c: labels.index(c)))}
    size = {order[c]: labels.count(c) for c in order}
    densest = max(x for _, x in leave.values())
    return ([order.get(c, -1) for c in labels], prob, core, tree,
            {order[c]: clusters[c][2] / (size[order[c]] * densest) for c in order})


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(8)
    return np.concatenate([rng.normal((0, 0), 0.3, (60, 2)), rng.normal((4, 0), 0.2, (50, 2)), rng.normal((4, 1.6), 0.2, (40, 2)),
                           rng.normal((-6, 5), 1.0, (40, 2)), rng.uniform(-9, 9, (30, 2))])


@pytest.mark.parametrize("cell_rows", [5000, 40])
def test_spanning_tree_is_minimal(spark, blobs, cell_rows):
    core = np.sort(plain_distances(blobs), 1)[:, 4]
    v = frame(spark, np.column_stack([blobs, core]), ["x", "y", "core"]).withColumnRenamed("row_id", "id")
    got = H.spanning_tree(v, ["x", "y"], cell_rows).collect()
    want = plain_tree(blobs, core)
    assert np.allclose(sorted(e["weight"] for e in got), [e[0] for e in want], rtol=1e-12)
    assert len({i for e in got for i in (e["a"], e["b"])}) == len(blobs)


@pytest.mark.parametrize("cell_rows, band_edges, epsilon", [(5000, 200_000, 0.0), (60, 25, 0.0), (5000, 200_000, 0.6)])
def test_hdbscan_equals_plain_version(spark, blobs, cell_rows, band_edges, epsilon):
    labels, prob, _, _, persistence = plain_hdbscan(blobs, 8, 5, epsilon)
    out = H.hdbscan(frame(spark, blobs), ["x", "y"], 8, 5, epsilon, cell_rows=cell_rows, band_edges=band_edges)
    got = {r["row_id"]: r for r in out.labels.collect()}
    assert [got[i]["cluster"] for i in range(len(blobs))] == labels
    assert [got[i]["probability"] for i in range(len(blobs))] == pytest.approx(prob, rel=1e-9)
    table = {r["cluster"]: r for r in out.clusters.collect()}
    assert {c: r["persistence"] for c, r in table.items()} == pytest.approx(persistence, rel=1e-9)
    assert {c: r["size"] for c, r in table.items()} == {c: labels.count(c) for c in persistence}


def test_hdbscan_copies_nulls_and_few_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((90, 2)), rng.normal(9, 0.1, (30, 2))])  # a coordinate with most rows
    df = frame(spark, x).union(spark.createDataFrame([(900, None, 1.0), (901, float("nan"), 1.0)], "row_id long, x double, y double"))
    got = {r["row_id"]: r["cluster"] for r in H.hdbscan(df, ["x", "y"], 10).labels.collect()}
    assert [got[i] for i in range(120)] == [0] * 90 + [1] * 30 and got[900] == got[901] == -1
    few = H.hdbscan(df.limit(4), ["x", "y"], 10)
    assert {r["cluster"] for r in few.labels.collect()} == {-1} and few.clusters.count() == 0
    assert H.hdbscan(df.limit(0), ["x", "y"], 10).labels.count() == 0


def plain_dbscan(points, eps, least):
    near = plain_distances(points) <= eps
    core = near.sum(1) >= least
    label, k = [-1] * len(points), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack = [i]
            while stack:
                x = stack.pop()
                if label[x] < 0:
                    label[x] = k
                    stack += [y for y in np.flatnonzero(near[x] & core) if label[y] < 0]
            k += 1
    out = list(label)
    for i in np.flatnonzero(~core):
        out[i] = min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)
    return out, core.tolist()


@pytest.mark.parametrize("cell_rows, eps, least", [(20_000, 0.3, 5), (30, 0.3, 5), (20_000, 0.0, 4), (60, 2.0, 40), (30, 0.15, 1)])
def test_dbscan_over_any_number_of_cells(spark, cloud, cell_rows, eps, least):
    df = frame(spark, cloud).union(spark.createDataFrame([(900, None, 0.0, 0.0)], "row_id long, x double, y double, z double"))
    got = {r["row_id"]: r for r in N.dbscan(df, XYZ, eps, least, cell_rows=cell_rows).collect()}
    labels, core = plain_dbscan(cloud, eps, least)
    assert [got[i]["cluster"] for i in range(len(cloud))] == labels
    assert [got[i]["is_core"] for i in range(len(cloud))] == core
    assert got[900]["cluster"] == -1


def test_dbscan_of_a_dense_block(spark):
    """200,000 rows with thousands of neighbours each."""
    from pyspark.sql import functions as F

    df = spark.range(200_000).select(F.col("id").alias("row_id"), *[(F.rand(i) + F.when(F.col("id") % 10 == 0, 5.0).otherwise(0.0)).alias(c)
                                                                    for i, c in enumerate(XYZ)]).repartition(8)
    sizes = {r["cluster"]: r["n"] for r in N.dbscan(df, XYZ, 0.2, 5).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 20_000, 1: 180_000}


def test_automatic_dbscan_of_copies(spark):
    """The eps base is 0 where most rows are copies."""
    df = frame(spark, np.concatenate([np.zeros((40, 2)), np.ones((40, 2))]))
    best, table = N.dbscan_auto(df, ["x", "y"], min_samples_grid=(3,), factors=(1.0,))
    assert table.first()["eps"] == 0.0 and best[0] == pytest.approx(1.0)
