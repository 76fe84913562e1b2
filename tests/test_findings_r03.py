"""Steps that have to grow no faster than their input."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from constella.operators import hierarchy as H
from constella.operators import metrics as M
from constella.operators import neighbors as N
from constella.sources import io as S
from constella.streaming import operators as T
from constella.streaming import ordered as O


def _room_fold(spark, monkeypatch):
    """The fold that room_deliveries hands to in_event_order."""
    held = {}
    monkeypatch.setattr(O, "in_event_order", lambda rows, keys, schema, fold, keep: held.update(fold=fold) or rows)
    a = spark.createDataFrame([], "event_id long, ts timestamp, room long, watcher_id long, joins boolean")
    O.room_deliveries(a, a.select("event_id", "ts", "room"))
    return held["fold"]


def test_room_deliveries_hold_few_rows_at_once(spark, monkeypatch):
    fold = _room_fold(spark, monkeypatch)
    monkeypatch.setattr(O, "DELIVERIES", 100)
    joins = [(i, 1000 + i, True) for i in range(250)] + [(250, 1007, False)]
    sent = [(300 + i, None, None) for i in range(7)]
    frame = pd.DataFrame(joins + sent, columns=["event_id", "watcher_id", "joins"]).astype({"event_id": "int64"})
    run, parts = fold((3, 0), None, frame), []
    try:
        while True:
            parts.append(next(run))
    except StopIteration as end:
        members = end.value
    assert max(len(p) for p in parts) < 200
    got = pd.concat(parts)
    there = set(range(1000, 1250)) - {1007}
    assert set(members) == there and set(got["room"]) == {3}
    assert sorted(zip(got["event_id"], got["watcher_id"])) == sorted(itertools.product(range(300, 307), there))


def test_routing_makes_a_row_an_event_and_group(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(i, t, i % 50, "view") for i in range(200)] + [(900, t, None, "view")],
                               "event_id long, ts timestamp, user_id long, event_type string")
    rows = [(i % 25, i) for i in range(5000)] + [(3, 3), (3, None), (None, 7)]
    watchers = spark.createDataFrame(rows, "room int, watcher_id long").coalesce(1)
    routed = T.route_to_watchers(ev, T.watch_groups(watchers))
    assert routed.count() == 200
    pairs = routed.select("event_id", F.explode("watchers.watcher_id").alias("w")).collect()
    want = [(i, w) for i in range(200) for room, w in rows if room == i % 25]
    key = lambda p: (p[0], -1 if p[1] is None else p[1])
    assert sorted(((r["event_id"], r["w"]) for r in pairs), key=key) == sorted(want, key=key)
    split = T.route_to_watchers(ev, T.watch_groups(watchers, chunk=1000))
    assert split.agg(F.sum(F.size("watchers"))).first()[0] == len(want)


@pytest.mark.parametrize("copies", [1, 3])
def test_silhouette_of_many_clusters(spark, copies):
    rng = np.random.default_rng(5)
    spots = rng.normal(size=(600, 2))
    rows = [(int(i), *map(float, spots[i] + 0.01 * rng.normal(size=2)), int(i)) for i in range(600) for _ in range(copies)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double, cluster int")
    got = M.silhouette_sq(df, ["x", "y"], per_row=True).toPandas().groupby("cluster")["silhouette"].mean()
    p, label = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    for c in range(0, 600, 97):
        own = np.flatnonzero(label == c)
        values = []
        for i in own:
            a = d2[i, own].sum() / max(len(own) - 1, 1)
            b = min(d2[i, label == o].mean() for o in range(600) if o != c)
            values.append(0.0 if len(own) == 1 else (b - a) / max(a, b))
        assert got[c] == pytest.approx(np.mean(values), abs=1e-6)


def test_silhouette_is_the_same_by_literals_and_arrays(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(i), *map(float, rng.normal(size=3)), int(i % 8) - 1) for i in range(400)],
                               "row_id long, x double, y double, z double, cluster int")
    a = M.silhouette_sq(df, ["x", "y", "z"]).first()[0]
    monkeypatch.setattr(M, "LITERAL_CLUSTERS", 2)
    assert M.silhouette_sq(df, ["x", "y", "z"]).first()[0] == pytest.approx(a, abs=1e-9)


def test_automatic_dbscan_where_every_point_has_copies(spark):
    rng = np.random.default_rng(7)
    spots = rng.normal(size=(700, 3))
    df = spark.createDataFrame([(int(i * 12 + k), *map(float, p)) for i, p in enumerate(spots) for k in range(12)],
                               "row_id long, x double, y double, z double")
    best, table = N.dbscan_auto(df, ["x", "y", "z"], min_samples_grid=(3,), factors=(1.0,))
    row = table.first()
    assert (row["eps"], row["n_clusters"], row["noise_ratio"]) == (0.0, 700, 0.0)
    assert best[0] == pytest.approx(1.0, abs=1e-6)


def test_intake_reads_no_content_that_decides_nothing(spark, tmp_path):
    (tmp_path / "big.csv").write_bytes(b"a,b\n" * 2000)
    (tmp_path / "table.parquet").write_bytes(b"PAR1" * 2000)
    (tmp_path / "good.xlsx").write_bytes(b"PK\x03\x04" + b"0" * 50)
    (tmp_path / "BAD.XLS").write_bytes(b"PK\x03\x04" + b"0" * 50)
    (tmp_path / "tiny.xls").write_bytes(b"PK")
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "1000")  # reading the content of a longer file is an error
    try:
        got = {r["filename"]: r["reason"] for r in S.file_intake(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(key)
    assert got == {"big.csv": None, "good.xlsx": None, "table.parquet": "Unsupported file type",
                   "BAD.XLS": "File content doesn't match the declared file type", "tiny.xls": "File is too small or empty"}


def test_single_linkage_cut_makes_no_pairs(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a table of pairs")

    monkeypatch.setattr(H, "neighbour_pairs", refuse, raising=False)
    rng = np.random.default_rng(8)
    p = np.round(np.concatenate([rng.normal(size=(300, 2)) * 0.5, rng.normal(size=(300, 2)) * 0.02 + 4]), 3)
    df = spark.createDataFrame([(int(i) + 10, *map(float, x)) for i, x in enumerate(p)] + [(5, None, 1.0), (990, *map(float, p[0]))],
                               "row_id long, x double, y double")
    got = {r["row_id"]: r["cluster"] for r in H.single_linkage_threshold(df, ["x", "y"], 0.12).collect()}
    p = np.concatenate([p, p[:1]])
    ids = [*range(10, 610), 990]
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) <= 0.12
    low = np.array(ids)
    while True:
        new = np.where(near, low[None, :], 10 ** 6).min(1)
        if (new == low).all():
            break
        low = new
    number = {c: k for k, c in enumerate(sorted(set(low.tolist())))}
    assert got == {i: number[c] for i, c in zip(ids, low.tolist())}


def test_component_rounds_do_not_multiply_the_size_estimate(spark):
    ids = list(range(200))
    vertices = spark.createDataFrame([(i,) for i in ids], "id long")
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
    comp = N.connected_components(vertices, edges)
    assert comp._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2 ** 63
    assert {r["component"] for r in comp.collect()} == {0} and comp.count() == 200


def test_texts_find_their_shard_without_a_join_by_row(spark, tmp_path, monkeypatch):
    from constella.llm import reshard as R

    place, plans = R._place, []

    def seen(*args):
        out = place(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(R, "_place", seen)
    rows = [(i % 90 if i % 11 else None, f"w{i % 7} " * (1 + i % 13), 0 if i % 3 else 1, i) for i in range(400)]
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    spark.createDataFrame(rows, "doc_id long, text string, shard int, size long").repartition(3).write.partitionBy("shard").parquet(old)
    p = R.rewrite(spark, old, new, 5).collect()
    # no shuffle by row key: texts travel to the range of their slots alone
    assert len(plans) == 1 and "SortMergeJoin" not in plans[0] and plans[0].count("rangepartitioning") == 1
    out = spark.read.parquet(new).collect()
    key = lambda r: (r["shard"], r["slot"])
    got = {key(r): (r["doc_id"], len(r["text"]) + 1) for r in out}
    assert got == {key(r): (r["doc_id"], r["size"]) for r in p} and len(out) == 400
    assert sorted(r["size"] for r in out) == list(range(400))


def test_distinct_words_are_merged_once():
    import public_tokenizers

    from constella.llm.binary_packing import Tokens

    t = Tokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    t([""])
    make, merged = t.known.make, []
    t.known.make = lambda word: merged.append(word) or make(word)
    texts = ["a quokkast, a quokkast. The quokkast! éta? quokkast", "x quokkast; is\nquokkast, b", "'tis \u00a0 odd  one"]
    ids = t(texts)
    assert merged.count(" quokkast") == 1
    whole = t._tokenizer()
    assert [list(np.frombuffer(x, "<u2")) for x in ids] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_shingles_of_a_column_equal_those_of_single_texts():
    import pyarrow as pa
    import xxhash

    from constella.llm import ngram_join as J

    rng = np.random.default_rng(9)
    texts = [None, "", " \n\t", " a", "b ", "A  B\tc\x0bd\x0c e\r\n", "é É \xa0x\x85 y z  w q r", "one TWO three four",
             *(" ".join(f"W{x}" for x in rng.integers(0, 9, n)) for n in rng.integers(0, 60, 40))]

    def plain(text):
        w = (text or "").encode().lower().split()
        if len(w) < 5:
            return {xxhash.xxh64_intdigest(b" ".join(w), len(w))} if w else set()
        h = np.array([xxhash.xxh64_intdigest(x) for x in w], np.uint64)
        out = set()
        for i in range(len(w) - 4):
            s = h[i:i + 1]
            for k in range(1, 5):
                s = J._mix(s * J.MIX + h[i + k:i + k + 1])
            out.add(int(s[0]))
        return out

    for some in (texts, texts[::-1], texts[:1], texts[:3], []):
        got = J.Shingler().sets(pa.array(some, pa.string()))
        assert [s.tolist() for s in got] == [sorted(plain(x)) for x in some]
    J.GROUP_BYTES, kept = 50, J.GROUP_BYTES
    try:
        assert [s.tolist() for s in J.Shingler().sets(pa.array(texts))] == [sorted(plain(x)) for x in texts]
    finally:
        J.GROUP_BYTES = kept


def test_forest_walks_hold_a_block_of_rows():
    import tracemalloc

    from constella.operators import anomaly as A

    rng = np.random.default_rng(3)
    X = rng.normal(size=(2 * A.BLOCK + 5, 3))
    X[:, 1] = np.round(X[:, 1])
    trees = [A._grow(X[rng.choice(len(X), 64)], np.random.default_rng([7, t]), 6) for t in range(40)]
    trees[0] = A._grow(np.zeros((64, 3)), rng, 6)  # a root that is a leaf
    width = max(len(t[0]) for t in trees)
    table = lambda i, kind: np.array([np.pad(np.asarray(t[i], kind), (0, width - len(t[i]))) for t in trees])
    feature = table(0, int)
    for f, t in zip(feature, trees):
        f[len(t[0]):] = -1
    forest = {"feature": feature, "threshold": table(1, float), "left": np.maximum(table(2, int), 0),
              "right": np.maximum(table(3, int), 0), "leaf_adjust": rng.random((40, width)), "depth_limit": 6}
    X[5, 0], X[6, 1] = np.nan, np.inf
    tracemalloc.start()
    got = A.path_lengths(forest, X)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 8 * A.BLOCK * len(trees)  # one table of all rows and trees takes half of it
    for row in (0, 5, 6, A.BLOCK - 1, A.BLOCK, len(X) - 1):
        want = []
        for (feat, thr, left, right, _), adjust in zip(trees, forest["leaf_adjust"]):
            node = depth = 0
            while feat[node] >= 0:
                node, depth = (left if X[row, feat[node]] < thr[node] else right)[node], depth + 1
            want.append(depth + adjust[node])
        assert got[row] == pytest.approx(np.mean(want), rel=1e-12)
    assert len(A.path_lengths(forest, X[:0])) == 0


def _cells(Y, cells):
    lo = Y.min(0)
    size = (Y.max(0) - lo) / cells
    key = pd.DataFrame(np.clip(np.floor((Y - lo) / size), 0, cells - 1)).assign(x=Y[:, 0], y=Y[:, 1], z=Y[:, 2])
    g = key.groupby([0, 1, 2]).agg(n=("x", "size"), x=("x", "mean"), y=("y", "mean"), z=("z", "mean")).reset_index()
    return g[["n", "x", "y", "z", 0, 1, 2]].to_numpy(float), lo, size, cells


@pytest.mark.parametrize("mode", ["umap", "tsne"])
def test_repulsion_holds_a_block_of_rows(mode):
    import tracemalloc

    from constella.operators import layout as L

    rng = np.random.default_rng(4)
    Y = rng.normal(size=(8 * L.ROWS + 3, 3))
    S, lo, size, cells = summary = _cells(Y, 6)
    Y[9] = np.nan
    tracemalloc.start()
    force, share = L._repulsion(summary, Y, mode, 3.0, 1.5, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * 8 * len(S) * L.ROWS  # one table of all rows and cells takes 64
    own = np.clip(np.floor((Y - lo) / size), 0, cells - 1)
    cnt = np.where((own[:, None, :] == S[None, :, 4:7]).all(-1), 0.0, S[None, :, 0])
    diff = Y[:, None, :] - S[None, :, 1:4]
    d2 = (diff ** 2).sum(-1)
    if mode == "tsne":
        w = 1.0 / (1.0 + d2)
        want, z = 4.0 * ((cnt * w * w)[:, :, None] * diff).sum(1) / 3.0, (cnt * w).sum(1)
    else:
        coef = 2.0 * 0.9 / ((0.001 + d2) * (1.0 + 1.5 * d2 ** 0.9))
        want, z = np.clip((cnt * coef)[:, :, None] * diff, -4, 4).sum(1) / cnt.sum(), np.zeros(len(Y))
    assert np.allclose(force, want, rtol=1e-9, atol=1e-12, equal_nan=True)
    assert np.allclose(share, z, rtol=1e-12, equal_nan=True)


def test_edges_travel_once_an_iteration(spark):
    from constella.operators import layout as L

    n = 400
    coords = spark.range(n).select(F.col("id").alias("row_id"), *[F.rand(i).alias(a) for i, a in enumerate("xyz")]).checkpoint()
    e = spark.range(4 * n).select((F.col("id") % n).alias("i"), (F.col("id") * 7 % 13).alias("j"), F.lit(0.5).alias("w"))
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "j").persist()
    e.count()
    got = L._attraction(e, coords, "tsne", 1.0, 1.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 3, plan  # the coordinates to j and to i, the edges to i
    y = {r["row_id"]: np.array([r["x"], r["y"], r["z"]]) for r in coords.collect()}
    want = dict.fromkeys(range(n), 0.0)
    for r in e.collect():
        d = y[r["i"]] - y[r["j"]]
        want[r["i"]] = want[r["i"]] + 4.0 * 0.5 / (1.0 + d @ d) * d
    for r in got.collect():
        assert np.allclose([r["gx"], r["gy"], r["gz"]], want[r["row_id"]], rtol=1e-9, atol=1e-12)
    e.unpersist()


@pytest.mark.parametrize("mode", ["umap", "tsne"])
def test_bandwidths_of_rows_of_any_length(mode):
    from constella.operators import layout as L

    rng = np.random.default_rng(6)
    rows = [np.sort(rng.random(12)) * s for s in (0.01, 1.0, 50.0)] + [np.zeros(12), np.array([0.5]), np.zeros(0)]
    target = np.log2(5)
    for d in rows:
        p = L._bandwidths(d[None, :], mode, target)[0]
        assert len(p) == len(d) and np.isfinite(p).all()
        if len(d) == 12 and d.any():
            met = -(p * np.log2(np.maximum(p, 1e-300))).sum() if mode == "tsne" else p.sum()
            assert met == pytest.approx(target, abs=1e-5)
    many = np.array(rows[:4])
    assert np.array_equal(L._bandwidths(many, mode, target), np.concatenate([L._bandwidths(r[None, :], mode, target) for r in many]))


def test_nearest_orders_candidates_once_a_leaf_of_queries(monkeypatch):
    from constella.operators import celltree

    rng = np.random.default_rng(8)
    P, ids, k = rng.normal(size=(1500, 3)), rng.permutation(1500) * 3, 40
    calls, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda *a, **kw: calls.append(1) or sort(*a, **kw))
    found, far = celltree.nearest(P, ids, P, ids, k)
    assert len(calls) == len(celltree.Leaves(P).slices)
    monkeypatch.undo()
    for points in (P, np.round(P)):  # the second with many ties, which go by id
        found, far = celltree.nearest(points, ids, points, ids, k)
        d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        for row in range(0, 1500, 50):
            best = np.lexsort((ids, d[row]))[:k]
            assert np.array_equal(found[row], ids[best]) and np.allclose(far[row], d[row][best], rtol=1e-12)


def test_short_stays_meet_few_messages(spark):
    rng = np.random.default_rng(5)
    day = dt.datetime(1969, 12, 31, 20)
    when = lambda k: day + dt.timedelta(seconds=int(k) // 4)  # noqa: E731  four events a second, some at the same time
    kinds = rng.integers(0, 4, 6000)
    rows = [(i, when(rng.integers(0, 4 * 30_000)), int(rng.integers(0, 2)), int(rng.integers(0, 6)), int(k)) for i, k in enumerate(kinds)]
    rows += [(9000, when(4 * 40_000_000), 0, 1, 3), (9001, None, 0, 1, 3), (9002, None, 0, 1, 0), (9003, when(8), None, 1, 0), (9004, when(9), None, 1, 3)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, room long, user long, kind int")
    actions = ev.where("kind < 2").select("event_id", "ts", "room", F.col("user").alias("watcher_id"), (F.col("kind") == 0).alias("joins"))
    messages = ev.where("kind >= 2").select("event_id", "ts", "room")
    got = O.room_deliveries_batch(actions, messages)
    inside, want = {}, []
    for event, ts, room, user, kind in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[0])):
        there = inside.setdefault(room, set())
        if kind >= 2:
            want += [(event, room, w) for w in there]
        else:
            (there.add if kind == 0 else there.discard)(user)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    stays = sum(k == 0 for k in kinds)
    assert O.room_meetings(actions, messages).count() < len(want) + 150 * stays  # by days: 2,000 messages of a room a stay
    none = ev.where("false")
    assert O.room_deliveries_batch(actions, none.select("event_id", "ts", "room")).count() == 0


def _peak(work):
    """Bytes that numpy and Python held at once, without what was there."""
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_suffix_dedup_steps_hold_a_few_times_their_texts():
    import pyarrow as pa

    from constella.llm import suffix_dedup as D

    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 4000).astype(np.uint8).tobytes().decode() for _ in range(1000)]
    size = sum(map(len, texts))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000), pa.int64()), "text": texts})
    anchored = _peak(lambda: [None for _ in D._anchor_rows([batch], 12)])
    assert anchored < 20 * size
    packed = pd.DataFrame({"data": [d for b in D._text_rows([batch], 1) for d in b.column("data").to_pylist()]})
    doc = np.arange(1000)
    gone = pd.DataFrame({"data": D.covered(doc, doc % 50, doc % 50 + 200, 1).column("data").to_pylist()})
    held = {}
    cut = _peak(lambda: held.update(out=D._cut(packed, gone, True)))
    assert cut < 12 * size
    out = held["out"].sort_values("doc_id")
    assert [k.decode() for k in out["kept"]] == [t[:i % 50] + t[i % 50 + 200:] for i, t in enumerate(texts)]
    assert set(out["n_removed"]) == {200} and set(out["n_spans"]) == {1}
