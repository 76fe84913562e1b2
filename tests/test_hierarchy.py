"""Agglomerative clustering against a greedy numpy version; quantiles with
infinite values."""

import numpy as np
import pytest

from constella.functions.quantiles import exact_quantiles
from constella.operators import hierarchy as H
from test_density import frame, plain_distances

LINKAGES = ["ward", "complete", "average", "single"]


def plain_merges(points, linkage):
    """Heights and the partitions of the greedy hierarchy, from all pairs."""
    groups = [[i] for i in range(len(points))]
    d = plain_distances(points)
    heights, states = [], [[list(g) for g in groups]]

    def far(a, b):
        if linkage == "ward":
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(points[a].mean(0) - points[b].mean(0))
        block = d[np.ix_(a, b)]
        return {"complete": block.max, "average": block.mean, "single": block.min}[linkage]()

    while len(groups) > 1:
        h, i, j = min((far(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        groups[j] = groups[j] + groups.pop(i)
        heights.append(h)
        states.append([list(g) for g in groups])
    return heights, states


def numbered(groups, n):
    out = [None] * n
    for k, g in enumerate(sorted(groups, key=min)):
        for i in g:
            out[i] = k
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    return np.concatenate([rng.normal(0, 0.4, (25, 2)), rng.normal((3, 1), 0.6, (25, 2)), rng.uniform(-4, 6, (20, 2))])


@pytest.mark.parametrize("linkage", LINKAGES)
def test_linkages_equal_the_greedy_version(spark, points, linkage):
    heights, states = plain_merges(points, linkage)
    df = frame(spark, points)
    for k, threshold in ((4, None), (None, heights[-6])):
        got = {r["row_id"]: r["cluster"] for r in H.agglomerative(df, ["x", "y"], k, linkage, threshold).collect()}
        want = states[-4] if k else states[-1 - 6]
        assert [got[i] for i in range(len(points))] == numbered(want, len(points))


def test_ward_in_rounds_equals_one_task(spark, points):
    spots = frame(spark, points).selectExpr("row_id AS id", "x", "y", "1L AS size")
    merged = H.merge_tree(spots, ["x", "y"], "ward", task_clusters=20, cell_rows=15).collect()
    assert np.allclose(sorted(m["height"] for m in merged), plain_merges(points, "ward")[0], rtol=1e-9)
    with pytest.raises(ValueError, match="matrix"):
        H.merge_tree(spots, ["x", "y"], "average", task_clusters=20)


def test_single_linkage_finds_a_gap_after_the_tenth_of_4000(spark):
    rng = np.random.default_rng(0)
    x = np.sort(rng.uniform(0, 1, 4000))
    x[10:] += 5.0
    got = [r["cluster"] for r in H.agglomerative(frame(spark, x[:, None]), ["x"], 2, "single").orderBy("row_id").collect()]
    assert got == [0] * 10 + [1] * 3990


def test_4000_points_equal_any_order(spark):
    """Average linkage of 4,000 points in three groups of their own scale."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (2000, 2)), rng.normal(4, 0.2, (1500, 2)), rng.normal((0, 7), 0.3, (500, 2))])
    got = [r["cluster"] for r in H.agglomerative(frame(spark, x), ["x", "y"], 3, "average").orderBy("row_id").collect()]
    assert got == [0] * 2000 + [1] * 1500 + [2] * 500


def test_copies_few_and_bad_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 5.0, 0.0), (4, None, 1.0), (5, float("inf"), 0.0)],
                               "row_id long, x double, y double")
    for linkage in LINKAGES:
        got = {r["row_id"]: r["cluster"] for r in H.agglomerative(df, ["x", "y"], 3, linkage).collect()}
        assert got == {1: 0, 2: 0, 3: 1}
    assert H.agglomerative(df.limit(0), ["x", "y"], 2).count() == 0


def test_quantiles_among_infinite_values(spark):
    values = list(np.random.default_rng(3).normal(size=100_000)) + [float("inf")] * 3 + [float("-inf")] * 2
    df = spark.createDataFrame([(float(v),) for v in values], "a double")
    q = exact_quantiles(df, ["a"], [0.0, 0.25, 0.5, 0.9, 1.0])
    ordered = sorted(values)
    assert q[("a", 0.0)] == float("-inf") and q[("a", 1.0)] == float("inf")
    for p in (0.25, 0.5, 0.9):
        at = (len(values) - 1) * p
        low = ordered[int(at)]
        assert q[("a", p)] == pytest.approx(low + (ordered[int(at) + 1] - low) * (at - int(at)), rel=1e-12)
