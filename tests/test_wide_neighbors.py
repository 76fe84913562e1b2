"""Random-projection forest on 64 columns: recall against brute force."""

import numpy as np

from constella.operators import wide_neighbors as W
from test_density import frame

WIDE = [f"c{i}" for i in range(64)]


def test_recall_of_64_columns(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 3, (20, 64))
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 64))
    df = frame(spark, x, WIDE)
    found = W.knn_forest(df, WIDE, 5)
    got = {}
    for r in found.collect():
        got.setdefault(r["row_id"], set()).add(r["neighbor_id"])
    want = plain_neighbours_of(x, range(0, 3000, 50))
    share = np.mean([len(got[i] & set(want[i])) / 5 for i in want])
    assert share >= 0.9
    row = W.recall(df, WIDE, found, 5).first()
    assert row["queries"] == 60 and abs(row["recall"] - share) < 1e-9


def plain_neighbours_of(x, ids):
    out = {}
    for i in ids:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        out[i] = np.argsort(d, kind="stable")[:5].tolist()
    return out


def test_copies_and_few_rows(spark):
    x = np.concatenate([np.zeros((200, 3)), np.ones((3, 3))])
    found = W.knn_forest(frame(spark, x), ["x", "y", "z"], 4, trees=2, leaf_rows=50)
    rows = {r["row_id"]: r["distance"] for r in found.where("rank = 4").collect()}
    assert all(rows[i] == 0.0 for i in range(200))
    assert W.knn_forest(frame(spark, x).limit(0), ["x", "y", "z"], 4).count() == 0
