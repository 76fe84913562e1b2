"""Neighbour operators on low-dimensional points (the reduced 3-D cloud):
exact k-nearest-neighbour join, DBSCAN, local outlier factor, connected
components.

No cross join: points are bucketed into cells and only rows of near cells
meet.

* kNN: over a cell tree (``celltree``), exact after two passes.
* DBSCAN: cells of the tree with what lies within eps of them; inside, a grid
  whose cells are cliques; clusters = connected components of the parts.
* LOF: from the kNN table by joins and grouped aggregates.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constella.functions.ordering import global_row_number
from constella.operators import celltree
from constella.session import settle


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _cells(cols: Sequence[str], r: float, prefix: str = "c") -> list[Column]:
    return [F.floor(_q(c) / F.lit(r)).cast("long").alias(f"{prefix}{i}") for i, c in enumerate(cols)]


def _offsets(d: int) -> Column:
    offs = list(itertools.product((-1, 0, 1), repeat=d))
    return F.array(*[F.array(*[F.lit(o) for o in off]) for off in offs])


def _dist(cols: Sequence[str], a: str, b: str, weight: float = 1.0) -> Column:
    ss = sum([(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in cols[1:]],
             (F.col(f"{a}.{cols[0]}") - F.col(f"{b}.{cols[0]}")) ** 2)
    return F.sqrt(ss) if weight == 1.0 else F.sqrt(F.lit(float(weight)) * ss)


def neighbour_pairs(points: DataFrame, cols: Sequence[str], r: float, id_col: str = "row_id",
                    queries: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """All (q, p) with p in q's 3^d neighbour cells at side r, with distance.
    ``queries`` (default: all points) are the probing side."""
    d = len(cols)
    data = points.select(_q(id_col).alias("pid"), *[_q(c) for c in cols], *_cells(cols, r))
    probe_src = points if queries is None else queries
    probe = probe_src.select(_q(id_col).alias("qid"), *[_q(c) for c in cols], *_cells(cols, r, "h"),
                             F.explode(_offsets(d)).alias("off"))
    probe = probe.select("qid", *[F.col(c) for c in cols],
                         *[(F.col(f"h{i}") + F.col("off")[i]).alias(f"c{i}") for i in range(d)])
    a, b = probe.alias("a"), data.alias("b")
    on = [F.col(f"a.c{i}") == F.col(f"b.c{i}") for i in range(d)]
    j = a.join(b, on)
    return j.select(F.col("a.qid").alias("qid"), F.col("b.pid").alias("pid"),
                    _dist(cols, "a", "b", weight).alias("dist"))


def _finite(points: DataFrame, cols: Sequence[str], id_col: str) -> DataFrame:
    """Rows whose coordinates are numbers: null, NaN and infinite ones have no
    distance and take no part."""
    pts = points.select(_q(id_col).cast("long").alias(id_col), *[_q(c).cast("double").alias(c) for c in cols])
    # one condition for any number of columns; a null makes it null
    return pts.where(F.col(id_col).isNotNull() & F.forall(F.array(*[_q(c) for c in cols]), lambda x: F.abs(x) < float("inf")))


def knn_between(queries: DataFrame, data: DataFrame, cols: Sequence[str], k: int, id_col: str = "row_id",
                weight: float = 1.0) -> DataFrame:
    """Exact k nearest rows of ``data`` for every row of ``queries`` (equal ids
    left out, ties by id), distance sqrt(weight * sum of squares): (row_id,
    neighbor_id, rank, distance). Heavy duplicate coordinates of ``data`` keep
    k + 1 representatives."""
    q, d = _finite(queries, cols, id_col), _finite(data, cols, id_col)
    w = Window.partitionBy(*cols).orderBy(id_col)
    d = d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k + 1).drop("__r")
    return celltree.knn(d, cols, k, id_col, queries=q, weight=weight)


def impute_knn(df: DataFrame, cols: Sequence[str], k: int = 5, id_col: str = "row_id") -> DataFrame:
    """Fill each missing feature with the mean of that feature over the k
    nearest rows that have it, by nan-Euclidean distance (coordinates present
    in both rows, squared sum scaled by d / #shared); no donor with a shared
    coordinate -> the column mean. Rows are grouped by which features they
    have, so each (query pattern, donor pattern) pair is an ordinary exact
    kNN in the shared coordinates (at most 2^d patterns)."""
    cols = list(cols)
    d = len(cols)
    base = df.select(_q(id_col), *[_q(c).cast("double").alias(c) for c in cols])
    pat = F.concat_ws("", *[F.when(_q(c).isNull(), "0").otherwise("1") for c in cols])
    tagged = base.withColumn("__p", pat).persist()
    patterns = [r["__p"] for r in tagged.select("__p").distinct().collect()]
    means = tagged.agg(*[F.avg(_q(c)).alias(c) for c in cols]).first()
    fills = []
    for fi, f in enumerate(cols):
        q_pats = [p for p in patterns if p[fi] == "0"]
        d_pats = [p for p in patterns if p[fi] == "1"]
        if not q_pats:
            continue
        cand = None
        for qp in q_pats:
            for dp in d_pats:
                shared = [c for j, c in enumerate(cols) if qp[j] == "1" and dp[j] == "1"]
                if not shared:
                    continue
                qs = tagged.where(F.col("__p") == qp)
                ds = tagged.where(F.col("__p") == dp)
                nb = knn_between(qs, ds, shared, k, id_col, weight=d / len(shared))
                cand = nb if cand is None else cand.unionByName(nb)
        if cand is None:
            continue
        w = Window.partitionBy(id_col).orderBy("distance", "neighbor_id")
        top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        vals = tagged.select(F.col(id_col).alias("neighbor_id"), F.col(f).alias("__v"))
        fills.append((f, top.join(vals, "neighbor_id").groupBy(id_col).agg(F.avg("__v").alias(f"__fill_{f}"))))
    out = tagged
    for f, fl in fills:
        out = out.join(fl, id_col, "left")
    exprs = []
    for f in cols:
        fill_col = F.col(f"__fill_{f}") if any(f == g for g, _ in fills) else F.lit(None).cast("double")
        exprs.append(F.coalesce(_q(f), fill_col, F.lit(means[f]).cast("double")).alias(f))
    return out.select(id_col, *exprs)


def knn_join(points: DataFrame, cols: Sequence[str], k: int, id_col: str = "row_id",
             cell_rows: int = celltree.CELL_ROWS) -> DataFrame:
    """Exact k nearest neighbours of every point (itself excluded; ties by
    id): rows (row_id, neighbor_id, rank, distance), over a cell tree.

    A coordinate held by more than k rows is "heavy": every row there has k
    neighbours at distance 0, the smallest ids of the group (ties go by id),
    and no other row can use more than its k + 1 smallest ids. So heavy rows
    are answered from that short list, and the data side keeps only those
    k + 1 representatives: a coordinate holding a third of all rows costs
    k + 1 rows, not a third of all rows squared."""
    pts = _finite(points, cols, id_col)
    heavy_coords = (pts.groupBy(*[_q(c) for c in cols]).agg(F.count(F.lit(1)).alias("__m"))
                    .where(F.col("__m") > k).select(*cols, F.lit(True).alias("__heavy")))
    if k <= 0 or heavy_coords.limit(1).count() == 0:
        return settle(celltree.knn(pts, cols, max(k, 0), id_col, cell_rows=cell_rows))
    tagged = pts.join(heavy_coords, list(cols), "left")
    light = tagged.where(F.col("__heavy").isNull()).select(id_col, *cols)
    heavy = tagged.where(F.col("__heavy")).select(id_col, *cols)
    w = Window.partitionBy(*cols).orderBy(id_col)
    reps = settle(heavy.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k + 1).drop("__r"))
    short = reps.groupBy(*[_q(c) for c in cols]).agg(F.sort_array(F.collect_list(id_col)).alias("__ids"))
    same = heavy.join(short, list(cols)).select(id_col, F.posexplode(F.slice(F.filter(
        "__ids", lambda x: x != F.col(id_col)), 1, k)).alias("r", "neighbor_id")).select(
        id_col, "neighbor_id", (F.col("r") + 1).cast("int").alias("rank"), F.lit(0.0).alias("distance"))
    rest = celltree.knn(light.unionByName(reps), cols, k, id_col, queries=light, cell_rows=cell_rows)
    return settle(same.unionByName(rest))


# ------------------------------------------------------------------ components
#: edges that one task joins to components
TASK_EDGES = 200_000


def joined(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, components): the ends of the edges and the smallest id that each
    one reaches."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(at[:len(src)].tolist(), at[len(src):].tolist()):
        a, b = find(a), find(b)
        if a < b:
            up[b] = a
        else:
            up[a] = b
    return ids, ids[[find(x) for x in range(len(ids))]] if len(ids) else ids


def connected_components(vertices: DataFrame, edges: DataFrame, max_iter: int = 200,
                         checkpoint_every: int = 4, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, component = smallest id reachable). ``edges`` (src, dst) are
    treated as undirected. Every round contracts the graph: a vertex follows its
    first neighbour in an order that is drawn anew each round, if that one comes
    before it, so at least about half of the vertices go, whatever the graph
    looks like (long paths too); ``task_edges`` that are left are joined in one
    task. Stops when no edge is left and raises when ``max_iter`` rounds are not
    enough."""
    spark, kind = vertices.sparkSession, vertices.schema["id"].dataType.simpleString()
    labels = vertices.select("id", F.col("id").alias("label"))
    e = settle(edges.select(F.least("src", "dst").cast(kind).alias("src"), F.greatest("src", "dst").cast(kind).alias("dst"))
               .where("src <> dst").distinct())  # truncates the plan the loop re-analyses

    def rest(frames):
        parts = list(frames)
        if parts:
            ids, to = joined(np.concatenate([f["src"] for f in parts]), np.concatenate([f["dst"] for f in parts]))
            yield pd.DataFrame({"id": ids, "to": to})

    left = e.count()
    for i in range(max_iter):
        if not left:
            return labels.withColumnRenamed("label", "component")
        if left <= task_edges:
            steps, left = settle(e.coalesce(1).mapInPandas(rest, f"id {kind}, to {kind}")), 0
        else:
            steps = _contracted(e, i)
            for end in ("src", "dst"):
                e = e.join(steps.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("to", end)
            e = settle(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())
            left = e.count()
        # written and read again each round: a checkpoint keeps its plan's size
        # estimate, a number that the joins multiply from round to round
        labels = settle(labels.join(steps.withColumnRenamed("id", "label"), "label", "left").select(
            "id", F.coalesce("to", "label").alias("label")))
    raise RuntimeError(f"components still change after {max_iter} rounds; raise max_iter")


def _contracted(e: DataFrame, turn: int) -> DataFrame:
    """(id, to): the ends of the edges, and the smallest id of the group that
    each one falls into."""
    drawn = lambda c: F.xxhash64(c, F.lit(turn))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    first = both.groupBy(F.col("src").alias("id")).agg(F.min(F.struct(drawn("dst").alias("h"), "dst")).alias("m"))
    up = settle(first.select("id", F.when(F.col("m.h") < drawn("id"), F.col("m.dst")).otherwise(F.col("id")).alias("to")))
    while True:  # paths of falling draws are short; each turn halves them
        far = up.select(F.col("id").alias("to"), F.col("to").alias("far"))
        up = settle(up.join(far, "to").select("id", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("changed")))
        if not up.where("changed").limit(1).count():
            break
        up = up.drop("changed")
    least = up.groupBy("to").agg(F.min("id").alias("least"))
    return settle(up.join(least, "to").select("id", F.col("least").alias("to")))


# ------------------------------------------------------------------ DBSCAN
def dbscan(points: DataFrame, cols: Sequence[str], eps: float = 0.5, min_samples: int = 5,
           id_col: str = "row_id", cell_rows: int = celltree.CELL_ROWS) -> DataFrame:
    """(row_id, cluster, is_core); cluster -1 = noise. Clusters are numbered
    0.. by their smallest core row id (the order a scan in id order meets
    them); a border row takes the smallest cluster among its core neighbours.

    DBSCAN depends only on coordinates, so it runs on the *distinct*
    coordinates with their multiplicity: a coordinate holding a third of all
    rows is one vertex. Tasks get a cell of the cell tree and what lies within
    eps of its box, and work on a grid of side eps / sqrt(d), whose cells need
    no pairs inside (``grid_cells``): so a dense region costs its rows, not their
    square. Components of the cells meet in the rows that several tasks saw.
    With eps = 0 only equal coordinates are neighbours. Rows with a null, NaN or
    infinite coordinate are noise."""
    if eps < 0 or min_samples < 1:
        raise ValueError("eps must not be negative and min_samples at least 1")
    cols = list(cols)
    pts = _finite(points, cols, id_col)
    coords = settle(pts.groupBy(*[_q(c) for c in cols]).agg(F.min(_q(id_col)).alias("cid"), F.count(F.lit(1)).alias("m")))
    near = _near_cells(coords, cols, eps, cell_rows)
    whole = [*cols, "cid", "m", "cell", "own"]
    shape = ", ".join([*(f"`{c}` double" for c in cols), "cid long, m long, cell int, own boolean"])

    def cores(frame: pd.DataFrame) -> pd.DataFrame:
        core = celltree.grid_cells(frame[cols].to_numpy(float), frame["m"].to_numpy(), eps, min_samples).core()
        return frame[whole].assign(core=core)[frame["own"].to_numpy()][["cid", "core"]]

    core = near.groupBy("cell").applyInPandas(cores, "cid long, core boolean")
    told = settle(near.join(core, "cid"))

    def parts(frame: pd.DataFrame) -> pd.DataFrame:
        """kind 0: a core row and its component here; 1: a border row and a
        component that it touches."""
        grid = celltree.grid_cells(frame[cols].to_numpy(float), frame["m"].to_numpy(), eps, min_samples)
        ids, is_core, own = frame["cid"].to_numpy(), frame["core"].to_numpy(bool), frame["own"].to_numpy(bool)
        group = grid.components(is_core)
        names = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(names, group[is_core], ids[is_core])
        rows, touched = grid.touching(is_core, group, own & ~is_core)
        return pd.concat([
            pd.DataFrame({"id": ids[is_core], "part": names[group[is_core]], "kind": 0, "own": own[is_core]}),
            pd.DataFrame({"id": ids[rows], "part": names[touched], "kind": 1, "own": True})])

    found = settle(told.groupBy("cell").applyInPandas(parts, "id long, part long, kind int, own boolean"))
    members = found.where("kind = 0")
    comp = settle(connected_components(members.select("id").distinct(), members.where("id <> part").select(
        F.col("id").alias("src"), F.col("part").alias("dst"))).select("id", "component"))
    # clusters numbered 0.. by smallest core id, without a one-task window
    number = global_row_number(comp.select("component").distinct(), ["component"], "__rn").select(
        "component", (F.col("__rn") - 1).cast("int").alias("cluster"))
    cluster = settle(comp.join(number, "component").select("id", "cluster"))
    border = found.where("kind = 1").select(F.col("id").alias("edge"), F.col("part").alias("id")).join(cluster, "id").groupBy(
        F.col("edge").alias("id")).agg(F.min("cluster").alias("cluster"))
    labels = cluster.withColumn("is_core", F.lit(True)).unionByName(border.withColumn("is_core", F.lit(False)))
    spots = coords.join(labels.withColumnRenamed("id", "cid"), "cid").select(*[_q(c) for c in cols], "cluster", "is_core")
    out = points.select(_q(id_col)).join(pts.join(spots, cols).select(id_col, "cluster", "is_core"), id_col, "left")
    return out.select(id_col, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def _near_cells(coords: DataFrame, cols: list[str], eps: float, cell_rows: int) -> DataFrame:
    """Every coordinate once in its own cell and in each cell whose box is
    within eps."""
    placed, tree = celltree.build(coords, cols, cell_rows)
    rows = placed.select(*[_q(c) for c in cols], "cid", "m", "cell", F.lit(True).alias("own"))
    if len(tree.rows) == 1:
        return settle(rows)
    held = coords.sparkSession.sparkContext.broadcast(tree)

    def send(frames):
        t = held.value
        for frame in frames:
            for k in range(0, len(frame), 2000):
                f = frame.iloc[k:k + 2000]
                reach = t.gaps(f[cols].to_numpy(float)) <= eps
                reach[np.arange(len(f)), f["cell"].to_numpy()] = False
                r, c = np.nonzero(reach)
                yield f.iloc[r].assign(cell=c.astype(np.int32), own=False)

    return settle(rows.unionByName(rows.mapInPandas(send, rows.schema)))


def dbscan_auto(points: DataFrame, cols: Sequence[str], min_samples_grid: Sequence[int] = (3, 5, 7, 10),
                factors: Sequence[float] = (0.5, 0.75, 1.0, 1.25, 1.5), id_col: str = "row_id"):
    """K5: eps candidates = the k-distance order statistic at 95 % (k = 5
    counting the point itself) times each factor; every (eps, min_samples)
    with at least two clusters is scored silhouette x (1 - noise share)
    (squared-distance silhouette on non-noise rows). Returns the
    best (eps, min_samples), its labels and the score table."""
    from constella.operators.metrics import silhouette_sq

    pts = settle(_finite(points, cols, id_col))
    n = pts.count()
    base = eps_base(pts, cols, id_col) or 0.0
    grid = [(base * f, m) for f in factors for m in min_samples_grid if m < n]

    def score(candidate):
        eps, m = candidate
        lab = settle(dbscan(pts, cols, eps, m, id_col))
        st = lab.agg(F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("k"),
                     F.avg((F.col("cluster") == -1).cast("double")).alias("noise")).first()
        value = None
        if st["k"] >= 2:
            sil = silhouette_sq(pts.join(lab.select(id_col, "cluster"), id_col), cols).first()[0]
            value = None if sil is None else float(sil) * (1.0 - st["noise"])
        return (float(eps), int(m), int(st["k"]), float(st["noise"] or 0.0), value), lab

    with ThreadPoolExecutor(max_workers=4) as pool:  # candidates are independent jobs
        scored = list(pool.map(score, grid))
    rows, best = [r for r, _ in scored], None
    for (eps, m, _, _, value), lab in scored:
        if value is not None and (best is None or value > best[0]):
            best = (value, eps, m, lab)
    table = points.sparkSession.createDataFrame(
        rows, "eps double, min_samples int, n_clusters int, noise_ratio double, score double")
    return best, table


def eps_base(points: DataFrame, cols: Sequence[str], id_col: str = "row_id", k: int = 5,
             share: float = 0.95) -> float | None:
    """The k-distance (k counting the point itself, i.e. the (k-1)-th other
    neighbour) at sorted position floor(share x n)."""
    from constella.functions.quantiles import order_statistic

    pts = points.select(_q(id_col), *[_q(c) for c in cols]).dropna()
    n = pts.count()
    kk = min(k, n - 1)
    if kk <= 1:
        return 0.0
    kd = knn_join(pts, cols, kk - 1, id_col).groupBy(id_col).agg(F.max("distance").alias("kd"))
    return order_statistic(kd, "kd", int(n * share))


# ------------------------------------------------------------------ LOF
def lof(points: DataFrame, cols: Sequence[str], k: int = 20, id_col: str = "row_id",
        knn: DataFrame | None = None) -> DataFrame:
    """Local outlier factor (row_id, score = LOF, high = anomalous) from the
    exact kNN table: k-distance, reachability, local density, ratio."""
    nb = knn if knn is not None else knn_join(points, cols, k, id_col)
    nb = nb.select(F.col(id_col).alias("p"), F.col("neighbor_id").alias("o"), "rank", "distance")
    kd = nb.groupBy("p").agg(F.max("distance").alias("kdist"))
    reach = nb.join(kd.withColumnRenamed("p", "o").withColumnRenamed("kdist", "kdist_o"), "o").select(
        "p", "o", F.greatest(F.col("distance"), F.col("kdist_o")).alias("reach"))
    lrd = reach.groupBy("p").agg((F.lit(1.0) / (F.avg("reach") + F.lit(1e-10))).alias("lrd"))
    ratio = nb.join(lrd.withColumnRenamed("p", "o").withColumnRenamed("lrd", "lrd_o"), "o").groupBy("p").agg(
        F.avg("lrd_o").alias("mean_lrd_o"))
    out = ratio.join(lrd, "p").select(F.col("p").alias(id_col), (F.col("mean_lrd_o") / F.col("lrd")).alias("score"))
    return out


def k_distance(points: DataFrame, cols: Sequence[str], k: int, id_col: str = "row_id") -> DataFrame:
    """Distance to the k-th nearest neighbour of every point (K5's input)."""
    nb = knn_join(points, cols, k, id_col)
    return nb.groupBy(id_col).agg(F.max("distance").alias("k_distance"))
