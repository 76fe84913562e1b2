"""Invariants of the kernel embeddings / one-class SVM, and streaming
replays: the same input in one micro-batch and in many gives the same final
table, and equals the batch twin."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from constella.operators import embed as EM
from constella.streaming import operators as T


def _frame(spark, X):
    rows = [(i, *map(float, r)) for i, r in enumerate(X)]
    return spark.createDataFrame(rows, "row_id long, x double, y double, z double")


def test_kernel_pca_exact_with_all_landmarks(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(60, 3))
    coords, info = EM.kernel_pca(_frame(spark, X), ["x", "y", "z"], 3, m=60)
    got = np.array([[r["x"], r["y"], r["z"]] for r in coords.orderBy("row_id").collect()])
    d2 = ((X[:, None] - X[None]) ** 2).sum(-1)
    K = np.exp(-d2 / 3.0)
    J = np.eye(60) - 1.0 / 60
    lam = np.sort(np.linalg.eigvalsh(J @ K @ J))[::-1][:3]
    assert np.allclose(np.var(got, axis=0), lam / 60, rtol=1e-6)


def test_landmark_mds_preserves_3d_distances(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(80, 3))
    coords, info = EM.landmark_mds(_frame(spark, X), ["x", "y", "z"], 3, m=30)
    Y = np.array([[r["x"], r["y"], r["z"]] for r in coords.orderBy("row_id").collect()])
    dx = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    dy = np.sqrt(((Y[:, None] - Y[None]) ** 2).sum(-1))
    assert np.allclose(dx, dy, atol=1e-8)
    assert info["landmark_stress"] < 1e-8


@pytest.mark.parametrize("method", ["tsne", "umap"])
def test_layouts_preserve_neighbourhoods(spark, method):
    from constella.operators import layout as LY

    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0.0, 3.0, 6.0)])
    df = _frame(spark, X)
    if method == "tsne":
        coords = LY.tsne(df, ["x", "y", "z"], perplexity=10, iters=8)
    else:
        coords = LY.umap(df, ["x", "y", "z"], n_neighbors=10, iters=8)
    from constella.operators.neighbors import knn_join

    nb = knn_join(coords.persist(), ["x", "y", "z"], 5).collect()
    same = sum(1 for r in nb if r["row_id"] // 40 == r["neighbor_id"] // 40) / len(nb)
    assert same > 0.9  # layout neighbours stay in their blob (random: about 1/3)


def test_one_class_svm_flags_share_and_outliers(spark):
    rng = np.random.default_rng(2)
    X = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(0, 1, (8, 3)) + 7])
    flagged, _ = EM.one_class_svm(_frame(spark, X), ["x", "y", "z"], nu=0.1, iters=40)
    rows = {r["row_id"]: r["is_anomaly"] for r in flagged.collect()}
    assert sum(rows.values()) / len(rows) == pytest.approx(0.1, abs=0.01)
    assert sum(rows[i] for i in range(400, 408)) >= 7


@pytest.fixture(scope="module")
def split_events(spark, sf_small):
    """The sf0.001 events written as one parquet file per day."""
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    d = tempfile.mkdtemp(prefix="constella-events-")
    days = [r[0] for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    for i, day in enumerate(days):
        ev.where(F.to_date("ts") == F.lit(day)).coalesce(1).write.parquet(os.path.join(d, f"day={i:03d}"))
    return d, ev


def _stream(spark, d, schema, per_trigger):
    # one parquet file per day in sub-folders; per_trigger files per micro-batch
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
            .option("recursiveFileLookup", "true").parquet(d).withColumn("ts", F.col("ts").cast("timestamp")))


def test_latest_progress_replay_same_in_one_and_many_batches(spark, split_events):
    d, ev = split_events
    one = T.run_available_now(T.latest_progress(_stream(spark, d, ev.schema, 1000)), "rp1", "update",
                              key=["dataset_id"])
    many = T.run_available_now(T.latest_progress(_stream(spark, d, ev.schema, 1)), "rpn", "update",
                               key=["dataset_id"])
    cols = ["dataset_id", "stage", "progress"]
    a = sorted(tuple(r) for r in one.select(*cols).collect())
    b = sorted(tuple(r) for r in many.select(*cols).collect())
    batch = sorted(tuple(r) for r in T.latest_progress_batch(ev).select(*cols).collect())
    assert a == b == batch


def test_stage_durations_stream_equals_batch(spark, split_events):
    d, ev = split_events
    s = T.run_available_now(T.stage_durations(_stream(spark, d, ev.schema, 1)), "sd", "append")
    got = {r["event_id"]: r["seconds_since_previous"] for r in s.collect()}
    want = {r["event_id"]: r["seconds_since_previous"] for r in T.stage_durations_batch(ev).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert (got[k] is None and want[k] is None) or got[k] == pytest.approx(want[k], abs=1e-6)


def test_exact_rate_limit_matches_python(spark, split_events):
    d, ev = split_events
    s = T.run_available_now(T.rate_limit_exact(T.requests(_stream(spark, d, ev.schema, 3)), limit=2, seconds=3600),
                            "rl", "append")
    got = {r["event_id"]: r["allowed"] for r in s.collect()}
    reqs = sorted((r["ip"], r["agent"], r["ts"], r["event_id"]) for r in T.requests(ev).collect())
    want, state = {}, {}
    import datetime as dt
    for ip, agent, ts, eid in sorted(reqs, key=lambda t: (t[0], t[1], t[2], t[3])):
        start, cnt = state.get((ip, agent), (None, 0))
        if start is None or ts >= start + dt.timedelta(seconds=3600):
            start, cnt = ts, 0
        ok = cnt < 2
        cnt += ok
        state[(ip, agent)] = (start, cnt)
        want[eid] = ok
    assert got == want
