"""Steps that have to grow no faster than their input (findings of round 4)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from constella.operators import neighbors as N
from constella.streaming import ordered as O

ACTS = "event_id long, ts timestamp, room long, watcher_id long, joins boolean"


def _fold(spark, monkeypatch, packed):
    held = {}
    monkeypatch.setattr(O, "in_event_order", lambda rows, keys, schema, fold, keep: held.update(fold=fold) or rows)
    acts = spark.createDataFrame([], ACTS)
    O.room_deliveries(acts, acts.select("event_id", "ts", "room"), packed=packed)
    return held["fold"]


def _ended(run):
    parts = []
    while True:
        try:
            parts.append(next(run))
        except StopIteration as end:
            return parts, end.value


@pytest.mark.parametrize("packed", [False, True])
def test_room_folds_in_any_blocks(spark, monkeypatch, packed):
    fold = _fold(spark, monkeypatch, packed)
    for name, n in (("ROWS", 70), ("BLOCK", 8), ("STAYS", 3), ("DELIVERIES", 20)):
        monkeypatch.setattr(O, name, n)
    rng = np.random.default_rng(3)
    rows = [(i, *((int(rng.integers(0, 12)), [True, False, None][rng.integers(0, 3)]) if rng.integers(0, 2) else (None, None))) for i in range(400)]
    frame = pd.DataFrame(rows, columns=["event_id", "watcher_id", "joins"])
    here, want = {3: None, 50: None}, []
    for event, watcher, joins in rows:
        if watcher is None:
            want += [(event, 7, w) for w in here]
        elif joins:
            here[watcher] = None
        else:
            here.pop(watcher, None)
    parts, members = _ended(fold((7, 0), [3, 50], frame))
    assert members == list(here)
    if packed:
        assert max(len(w) for p in parts for w in p["watcher_ids"]) <= 3 and max(len(e) for p in parts for e in p["event_ids"]) <= 8
        got = [(int(e), int(room), int(w)) for p in parts for room, events, watchers, first, last in zip(
            p["room"], p["event_ids"], p["watcher_ids"], p["first"], p["last"]) for w, a, b in zip(watchers, first, last) for e in events[a:b]]
        assert sum(int(p["n"].sum()) for p in parts) == len(got)
    else:
        assert max(map(len, parts)) <= 20
        got = [tuple(map(int, r)) for p in parts for r in p.itertuples(index=False)]
    assert sorted(got) == sorted(want)
    assert _ended(fold((7, 0), None, frame.iloc[:0])) == ([], [])


def test_the_rooms_stream_writes_no_row_a_delivery(spark, tmp_path, monkeypatch):
    """400 members and 1,500 messages of one room: 600,000 deliveries."""
    from constella.plans import q_streaming as Q

    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(seconds=i), 25 * i, "signup", 0.0, "{}") for i in range(400)]
    rows += [(400 + i, day + dt.timedelta(seconds=1000 + i // 2), 25, "view", 0.0, "{}") for i in range(1500)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    ev.coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("part-*")).rename(tmp_path / "events.parquet")
    (tmp_path / "w" / "_SUCCESS").unlink(missing_ok=True)
    written = []
    run = O.run_to_end
    monkeypatch.setattr(O, "run_to_end", lambda *a: written.append(run(*a)) or written[0])
    monkeypatch.setattr(O, "UNPACKED", 100_000)
    out = Q.t5_room_deliveries_stream(spark, str(tmp_path))
    assert written[0].count() < 100
    at = out.agg(F.count(F.lit(1)), F.count_distinct("event_id", "watcher_id"), F.min("event_id"), F.max("event_id"), F.max("watcher_id")).first()
    assert tuple(at) == (600_000, 600_000, 400, 1899, 25 * 399) and out.columns == ["event_id", "room", "watcher_id"]


def test_messages_meet_stays_in_blocks(spark, monkeypatch):
    """Rows that meet: about one a stay and 2,048 messages of its room."""
    rng = np.random.default_rng(8)
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(seconds=int(rng.integers(0, 20_000))), i % 2, int(rng.integers(0, 40)), int(rng.integers(0, 20))) for i in range(12_000)]
    rows += [(20_000, None, 0, 1, 0), (20_001, None, 0, 1, 9), (None, day + dt.timedelta(seconds=50), 0, 1, 9), (20_002, day, None, 1, 0), (20_003, day, 0, None, 0)]
    rows += [(20_004, day + dt.timedelta(seconds=70), 1, 5, k) for k in (1, 9, 9)]  # equal (ts, event_id)
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp, room long, user long, kind int")
    acts = ev.where("kind < 2").select("event_id", "ts", "room", F.col("user").alias("watcher_id"), (F.col("kind") == 0).alias("joins"))
    sent = ev.where("kind >= 2").select("event_id", "ts", "room")
    at, out = {}, []
    key = lambda r: (r[1], -1 if r[0] is None else r[0])
    timed = sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (*key(r), r[4]))
    for r in timed:
        if r[4] < 2:
            at.setdefault((r[2], r[3]), []).append((key(r), r[4] == 0))
    for (room, watcher), acts_ in at.items():
        for (since, joins), (until, _) in zip(acts_, [*acts_[1:], (None, None)]):
            if joins:
                out += [(r[0], room, watcher) for r in timed if r[4] >= 2 and r[2] == room and since < key(r) and (until is None or key(r) < until)]
    none = lambda rows_: sorted(rows_, key=lambda r: tuple((x is None, x or 0) for x in r))
    met = O.room_meetings(acts, sent)
    stays = sum(r[4] == 0 for r in rows)
    assert len(out) > 100_000 and met.count() <= stays + len(out) / 2048 + 2 * stays
    assert none(map(tuple, O.room_deliveries_batch(acts, sent).collect())) == none(out)
    monkeypatch.setattr(O, "RUN", 16)
    monkeypatch.setattr(O, "CELL", 50)
    monkeypatch.setattr(O, "UNPACKED", 20_000)
    assert none(map(tuple, O.room_deliveries_batch(acts, sent).collect())) == none(out)


@pytest.mark.parametrize("task_edges", [200_000, 100])
def test_components_of_a_long_path_in_any_order(spark, task_edges):
    """A path of 3,000 vertices in random order: labels that walk along it need
    more than 200 rounds."""
    p = np.random.default_rng(1).permutation(3_000)
    path = list(zip(p[:-1].tolist(), p[1:].tolist()))
    cut = [(a, b) for k, (a, b) in enumerate(path) if k not in (1_000, 1_007)]
    vertices = spark.range(3_003).union(spark.range(5_000, 5_001))
    edges = spark.createDataFrame([*cut, *cut[:50], (3_001, 3_001), (5_000, 3_002), (None, 4)], "src long, dst long")
    comp = N.connected_components(vertices, edges, task_edges=task_edges)
    want = {int(v): int(g.min()) for g in (p[:1_001], p[1_001:1_008], p[1_008:]) for v in g} | {3_000: 3_000, 3_001: 3_001, 3_002: 3_002, 5_000: 3_002}
    got = comp.collect()
    assert {r["id"]: r["component"] for r in got} == want and len(got) == 3_004
    assert comp._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2 ** 63


def test_components_of_names_and_of_a_star(spark):
    names = [f"n{i:03d}" for i in range(300)]
    edges = spark.createDataFrame([("hub", n) for n in names[:250]] + [(names[250], names[251])], "src string, dst string")
    vertices = spark.createDataFrame([(n,) for n in ["hub", *names]], "id string")
    for task_edges in (1000, 10):
        got = {r["id"]: r["component"] for r in N.connected_components(vertices, edges, task_edges=task_edges).collect()}
        assert got == {"hub": "hub"} | dict.fromkeys(names[:250], "hub") | dict.fromkeys(names[250:252], "n250") | {n: n for n in names[252:]}


def test_cells_of_a_spanning_tree_name_their_own_components(spark, monkeypatch):
    """Sure edges stay in a cell, so no round over all vertices looks for them."""
    from constella.operators import density as DN

    sizes, run = [], DN.connected_components
    monkeypatch.setattr(DN, "connected_components", lambda v, e, *a, **k: sizes.append(v.count()) or run(v, e, *a, **k))
    rng = np.random.default_rng(2)
    xyz = rng.normal(size=(400, 2))
    vertices = spark.createDataFrame([(i, *map(float, p), 0.0) for i, p in enumerate(xyz)], "id long, x double, y double, core double")
    tree = [(r["a"], r["b"], r["weight"]) for r in DN.spanning_tree(vertices, ["x", "y"], 50).collect()]
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    there, want = [0], 0.0
    best = d[0].copy()
    for _ in range(399):
        best[there] = np.inf
        k = int(np.argmin(best))
        want, best = want + best[k], np.minimum(best, d[k])
        there.append(k)
    assert len(tree) == 399 and abs(sum(w for _, _, w in tree) - want) < 1e-9
    assert sizes and max(sizes) < 400
