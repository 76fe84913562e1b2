"""Hierarchical density clustering (K6): exact minimum spanning tree of the
mutual reachability distance, condensed tree, stability choice.

1. Equal coordinates become one vertex with a multiplicity; core distances come
   from the exact neighbour join.
2. Spanning tree. Vertices are grouped by the cell tree; each task builds the
   exact tree of its cell (Prim). An edge is kept for good when no vertex
   outside the cell can be nearer to the side it closes (the distance to the
   cell's region decides); the other edges stay candidates, since an edge that
   is not in a cell's own tree is in no tree at all. Rounds then join what is
   left: every component takes its least edge out, over the candidates and over
   a search that sends a vertex to those cells only that are nearer than the
   component's best edge and hold other components.
3. Condensed tree. Merges are processed by rising weight in bands; inside a band
   the components of its edges are independent, so each is merged in its own
   task, and only the sums of a component go on to the next band. A band is
   halved until its largest component fits a task.
4. Stability is compared at each true split; the topmost chosen cluster of a
   vertex is found by pointer doubling.

The driver holds counts, band limits and cell boxes, never vertices or edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constella.functions.ordering import global_row_number
from constella.operators import celltree
from constella.operators.neighbors import _finite, _q, connected_components, joined
from constella.session import settle

#: vertices of one cell: Prim's work grows with their square
TREE_ROWS = 5_000
#: edges of one component that a task merges
BAND_EDGES = 200_000


def _prim(points: np.ndarray, core: np.ndarray):
    """Edges (a, b, weight) of the tree of mutual reachability, by weight."""
    n = len(points)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    best, source = np.full(n, np.inf), np.zeros(n, np.int64)
    out = np.ones(n, bool)
    a, b, w = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1)
    at = 0
    for step in range(n - 1):
        out[at] = False
        best[at] = np.inf
        d2 = np.zeros(n)
        for i in range(points.shape[1]):
            d2 += (points[:, i] - points[at, i]) ** 2
        d = np.maximum(np.maximum(np.sqrt(d2), core), core[at])
        closer = out & (d < best)
        best[closer], source[closer] = d[closer], at
        at = int(np.argmin(best))
        a[step], b[step], w[step] = source[at], at, best[at]
    order = np.argsort(w, kind="stable")
    return a[order], b[order], w[order]


class Sets:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


def _cell_tree(ids, points, core, low, high):
    """(a, b, weight, sure) of one cell. ``sure``: one side of the cut that the
    edge closes has nothing outside the region as near."""
    a, b, w = _prim(points, core)
    border = np.minimum(points - low, high - points).min(1)  # how far the outside is
    horizon = np.maximum(core, border).tolist()
    sets, sure = Sets(len(ids)), np.zeros(len(a), bool)
    for e, (x, y, weight) in enumerate(zip(a.tolist(), b.tolist(), w.tolist())):
        x, y = sets.find(x), sets.find(y)
        sure[e] = max(horizon[x], horizon[y]) >= weight
        sets.up[y] = x
        horizon[x] = min(horizon[x], horizon[y])
    return ids[a], ids[b], w, sure


def spanning_tree(vertices: DataFrame, cols: Sequence[str], cell_rows: int = TREE_ROWS) -> DataFrame:
    """Exact minimum spanning tree (a, b, weight) of the mutual reachability
    distance over ``vertices`` (id, coordinates, core; distinct points)."""
    cols = list(cols)
    spark = vertices.sparkSession
    placed, tree = celltree.build(vertices, cols, cell_rows)
    placed = settle(placed.select("id", "cell", "core", *[_q(c) for c in cols]))
    held = spark.sparkContext.broadcast(tree)

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        cell = int(frame["cell"].iloc[0])
        t = held.value
        a, b, w, sure = _cell_tree(frame["id"].to_numpy(), frame[cols].to_numpy(float), frame["core"].to_numpy(float),
                                   t.low[cell], t.high[cell])
        # and a row a vertex, without weight: the smallest id that sure edges reach, all of them in the cell
        ids, near = joined(a[sure], b[sure])
        alone = np.setdiff1d(frame["id"].to_numpy(), ids)
        none = np.full(len(ids) + len(alone), None)
        return pd.DataFrame({"a": np.concatenate([a, ids, alone]), "b": np.concatenate([b, near, alone]),
                             "weight": np.concatenate([w, np.full(len(none), np.nan)]), "sure": np.concatenate([sure.astype(object), none])})

    local = settle(placed.groupBy("cell").applyInPandas(grow, "a long, b long, weight double, sure boolean"))
    if int((tree.rows > 0).sum()) <= 1:
        return local.where("sure IS NOT NULL").select("a", "b", "weight")
    kept = local.where("sure").select("a", "b", "weight")
    open_edges = local.where(~F.col("sure")).select("a", "b", "weight")
    labels = local.where("sure IS NULL").select(F.col("a").alias("id"), F.col("b").alias("component"))
    while True:
        rows = settle(placed.join(labels, "id"))
        cells = rows.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                         F.max("core").alias("core")).collect()  # a few numbers a cell
        if len({r["lo"] for r in cells} | {r["hi"] for r in cells}) == 1:
            return kept
        least = _least_edges(rows, labels, open_edges, cols, tree, {r["cell"]: r for r in cells})
        # the least edges of all components hold no cycle: weight, then ends decide
        kept = settle(kept.unionByName(least.select("a", "b", "weight").distinct()))
        links = least.select(F.col("component").alias("src"), F.col("other").alias("dst"))
        merged = connected_components(labels.select(F.col("component").alias("id")).distinct(), links)
        labels = settle(labels.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component")
                             .select("id", F.col("to").alias("component")))


def _least_edges(rows, labels, open_edges, cols, tree, cells) -> DataFrame:
    """component, other, a, b, weight: the least edge out of each component."""
    spark = rows.sparkSession
    side = labels.withColumnRenamed("component", "ca").withColumnRenamed("id", "a")
    there = labels.withColumnRenamed("component", "cb").withColumnRenamed("id", "b")
    known = settle(open_edges.join(side, "a").join(there, "b").where("ca <> cb"))
    both = known.select(F.col("ca").alias("component"), F.col("cb").alias("other"), "a", "b", "weight").unionByName(
        known.select(F.col("cb").alias("component"), F.col("ca").alias("other"), "a", "b", "weight"))
    info = spark.sparkContext.broadcast((tree, [(c, r["lo"], r["hi"], r["core"]) for c, r in sorted(cells.items())]))

    # a bound for every component: its least candidate, or the farthest corner
    # of a cell that holds another component
    def corners(frames):
        t, list_ = info.value
        numbers = np.array([x[0] for x in list_])
        lo, hi, core = (np.array([x[i] for x in list_]) for i in (1, 2, 3))
        for f in frames:
            for k in range(0, len(f), 2000):
                g = f.iloc[k:k + 2000]
                p, comp = g[cols].to_numpy(float), g["component"].to_numpy()
                d2 = np.zeros((len(g), len(numbers)))
                for i in range(len(cols)):
                    x = p[:, i, None]
                    d2 += np.maximum(np.abs(x - t.box_low[numbers, i]), np.abs(t.box_high[numbers, i] - x)) ** 2
                w = np.maximum(np.maximum(np.sqrt(d2), core[None, :]), g["core"].to_numpy(float)[:, None])
                w[(lo[None, :] == hi[None, :]) & (lo[None, :] == comp[:, None])] = np.inf
                yield pd.DataFrame({"component": comp, "bound": w.min(1) * (1 + 1e-9)}).groupby(
                    "component", as_index=False).min()

    coords = ", ".join(f"`{c}` double" for c in cols)
    far = rows.select("component", "core", *[_q(c) for c in cols]).mapInPandas(corners, "component long, bound double")
    bound = settle(far.unionByName(both.select("component", F.col("weight").alias("bound"))).groupBy("component").agg(
        F.min("bound").alias("bound")))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        """Least edge of every visiting component to another one's vertex."""
        data, ask = frame[frame["data"]], frame[~frame["data"]]
        pts, ids, comp, core = (data[cols].to_numpy(float), data["id"].to_numpy(), data["component"].to_numpy(), data["core"].to_numpy(float))
        q_pts, q_ids, q_comp, q_core = (ask[cols].to_numpy(float), ask["id"].to_numpy(), ask["component"].to_numpy(), ask["core"].to_numpy(float))
        limit, found = ask["bound"].to_numpy(float), []
        if len(pts) and len(q_pts):
            leaves, probes = celltree.Leaves(pts), celltree.Leaves(q_pts)
            best: dict[int, float] = {}
            for a, b in probes.slices:
                at = probes.order[a:b]
                for c in np.unique(q_comp[at]).tolist():
                    mine = at[q_comp[at] == c]
                    reach = min(best.get(c, np.inf), float(limit[mine].max()))
                    x = q_pts[mine]
                    gaps = leaves.gaps(x.min(0), x.max(0))
                    for leaf in np.argsort(gaps, kind="stable"):
                        if gaps[leaf] > reach:
                            break
                        u, v = leaves.slices[leaf]
                        rows_ = leaves.order[u:v]
                        rows_ = rows_[comp[rows_] != c]
                        live = mine[q_core[mine] <= reach]
                        if not len(rows_) or not len(live):
                            continue
                        d = np.maximum(np.maximum(celltree.distances(q_pts[live], pts[rows_]), core[rows_][None, :]), q_core[live][:, None])
                        m = float(d.min())
                        if m <= reach:
                            reach = m
                            i, j = np.nonzero(d == m)
                            found += [(c, int(comp[rows_[y]]), *sorted((int(q_ids[live[x_]]), int(ids[rows_[y]]))), m) for x_, y in zip(i, j)]
                    best[c] = reach
        out = pd.DataFrame(found, columns=["component", "other", "a", "b", "weight"])
        return out.sort_values(["component", "weight", "a", "b"]).groupby("component", as_index=False).first() if len(out) else out

    def send(frames):
        t, list_ = info.value
        numbers = np.array([x[0] for x in list_])
        lo, hi = (np.array([x[i] for x in list_]) for i in (1, 2))
        for f in frames:
            for k in range(0, len(f), 2000):
                g = f.iloc[k:k + 2000]
                gaps = t.gaps(g[cols].to_numpy(float))[:, numbers]
                reach = (gaps <= g["bound"].to_numpy(float)[:, None]) & ~(
                    (lo[None, :] == hi[None, :]) & (lo[None, :] == g["component"].to_numpy()[:, None]))
                reach &= numbers[None, :] != g["home"].to_numpy()[:, None]  # its own edges are candidates already
                r, c = np.nonzero(reach)
                out = g.iloc[r][["id", "component", "core", "bound", *cols]].copy()
                out["cell"] = numbers[c].astype(np.int32)
                yield out

    asking = rows.withColumnRenamed("cell", "home").join(bound, "component").where(F.col("core") <= F.col("bound"))
    kinds = f"id long, component long, core double, bound double, {coords}"
    visits = settle(asking.select("id", "component", "core", "bound", "home", *[_q(c) for c in cols]).mapInPandas(send, f"{kinds}, cell int"))
    visitors = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    shares = F.broadcast(spark.createDataFrame(  # one row a cell
        [(r["cell"], -(-r["n"] // (4 * TREE_ROWS))) for r in visitors], "cell int, shares long"))
    ask = visits.join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares"))).drop("shares").withColumn("data", F.lit(False))
    data = rows.join(shares, "cell").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares").withColumn(
        "data", F.lit(True)).withColumn("bound", F.lit(None).cast("double"))
    crossing = ask.unionByName(data).groupBy("cell", "share").applyInPandas(
        search, "component long, other long, a long, b long, weight double")
    everything = both.select("component", "other", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").unionByName(crossing)
    return settle(everything.groupBy("component").agg(
        F.min(F.struct("weight", "a", "b", "other")).alias("e")).select("component", "e.other", "e.a", "e.b", "e.weight"))


# ------------------------------------------------------------- condensed tree
@dataclass
class _Part:
    """What a component carries on: its rows, and its cluster once it has
    enough of them."""

    size: int
    cluster: int | None = None
    left: float = 0.0     # sum of size * lambda of what has left the cluster
    below: float = 0.0    # best stability of the clusters below
    death: float = 0.0    # lambda at which the cluster breaks up
    members: list | None = None


def _condense(parts: list, edges, least: int, floor: float):
    """Merges edges (number, a, b, weight), lightest first, over parts. Gives
    the vertices that fell out (vertex, cluster, lambda) and the clusters that
    ended at a true split; ``parts`` keeps what is left. A cluster is named by
    the number of the edge that makes it."""
    fell, ended, sets = [], [], Sets(len(parts))
    for number, a, b, w in edges:
        a, b = sets.find(a), sets.find(b)
        lam = 1.0 / max(w, floor)
        if parts[a].cluster is None and parts[b].cluster is not None:
            a, b = b, a
        x, y = parts[a], parts[b]
        size = x.size + y.size
        if y.cluster is not None:  # two clusters: their parent splits here
            parent = _Part(size, number, size * lam, 0.0, lam)
            for child in (x, y):
                stability = child.left - lam * child.size
                chosen = stability >= child.below
                ended.append((child.cluster, number, lam, stability, chosen, child.death, child.size))
                parent.below += stability if chosen else child.below
            parts[a] = parent
        elif x.cluster is not None:
            x.left += y.size * lam
            fell += [(v, x.cluster, lam) for v in y.members]
        else:
            x.members += y.members
            if size >= least:
                x.cluster, x.left, x.death = number, size * lam, lam
                fell += [(v, number, lam) for v in x.members]
                x.members = None
        parts[a].size = size
        sets.up[b] = a
        parts[b] = None
    return fell, ended


STATE = "component long, size long, cluster long, left double, below double, death double, members array<long>"
CARRIED = [f.split()[0] for f in STATE.split(", ")]


def condensed_tree(vertices: DataFrame, edges: DataFrame, min_cluster_size: int, band_edges: int = BAND_EDGES):
    """(fell, clusters): vertex, cluster, lam of every vertex that a cluster
    held; cluster, parent, birth, stability, chosen, death, size of every
    cluster but the root. ``vertices``: id (0, 1, ...), m (rows), core."""
    numbered = global_row_number(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight"),
                                 ["weight", "a", "b"], "number")
    floor = float(edges.where("weight > 0").agg(F.min("weight")).first()[0] or 1.0)
    big = F.col("m") >= min_cluster_size  # copies of one point that are a cluster by themselves
    lam, own = F.lit(1.0) / F.greatest(F.col("core"), F.lit(floor)), (-F.col("id") - 1).cast("long")
    state = settle(vertices.select(
        F.col("id").alias("component"), F.col("m").cast("long").alias("size"), F.when(big, own).alias("cluster"),
        F.when(big, F.col("m") * lam).otherwise(0.0).alias("left"), F.lit(0.0).alias("below"),
        F.when(big, lam).otherwise(0.0).alias("death"), F.when(~big, F.array("id")).alias("members")))
    fell = [vertices.where(big).select(F.col("id").alias("vertex"), own.alias("cluster"), lam.alias("lam"))]
    ended = []
    rest = settle(numbered)
    while (n := rest.count()) > 0:
        part, rest, comps = _band(rest, state, n, band_edges)
        outcome = settle(_merge_band(state.join(comps, "component"), part, comps, min_cluster_size, floor))
        fell.append(outcome.where("kind = 'fell'").select(F.col("x").alias("vertex"), F.col("cluster"), F.col("l").alias("lam")))
        ended.append(outcome.where("kind = 'ended'").select(
            "cluster", F.col("x").alias("parent"), F.col("l").alias("birth"), F.col("below").alias("stability"), "chosen", "death", "size"))
        state = settle(outcome.where("kind = 'part'").select(
            F.col("x").alias("component"), "size", "cluster", F.col("l").alias("left"), "below", "death", "members").select(CARRIED)
            .unionByName(state.join(comps, "component", "left_anti").select(CARRIED)))
        for end in ("a", "b"):
            moved = comps.select(F.col("component").alias(end), F.col("grouped").alias("to"))
            rest = rest.join(moved, end, "left").withColumn(end, F.coalesce("to", F.col(end))).drop("to")
        rest = settle(rest.select("number", "a", "b", "weight"))
    every_fell = fell[0]
    for f in fell[1:]:
        every_fell = every_fell.unionByName(f)
    every_end = vertices.sparkSession.createDataFrame(
        [], "cluster long, parent long, birth double, stability double, chosen boolean, death double, size long")
    for e in ended:
        every_end = every_end.unionByName(e)
    return every_fell, every_end


def _band(rest, state, n, band_edges):
    """The lightest edges whose components a task can merge; the others; and
    component, grouped (the component it becomes)."""
    if n <= band_edges:  # what is left of a spanning tree joins everything
        first = state.agg(F.min("component")).first()[0]
        return rest, rest.limit(0), state.select("component", F.lit(first).alias("grouped"))
    share = 0.5
    while True:
        limit = rest.approxQuantile("weight", [share], share / 4)[0]
        part = rest.where(F.col("weight") <= limit)
        ends = part.select(F.col("a").alias("id")).union(part.select("b")).distinct()
        comps = settle(connected_components(ends, part.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(
            F.col("id").alias("component"), F.col("component").alias("grouped")))
        largest = comps.groupBy("grouped").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if largest <= band_edges or share * n <= band_edges:
            return part, rest.where(F.col("weight") > limit), comps
        share /= 2.0


def _merge_band(parts, edges, comps, least, floor) -> DataFrame:
    shape = [("a", "long"), ("b", "long"), ("weight", "double"), ("number", "long")]
    v = parts.select("grouped", *CARRIED, *[F.lit(None).cast(t).alias(c) for c, t in shape])
    e = edges.join(comps.select(F.col("component").alias("a"), "grouped"), "a").select(
        "grouped", *[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in STATE.split(", "))], *[c for c, _ in shape])
    kinds = "kind string, x long, cluster long, l double, below double, death double, size long, chosen boolean, members array<long>"

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["grouped"].iloc[0])
        v, e = frame[frame["number"].isna()], frame[frame["number"].notna()].sort_values("number")
        at = {int(c): i for i, c in enumerate(v["component"])}
        parts = [_Part(int(size), None if pd.isna(cluster) else int(cluster), left, below, death,
                       None if members is None else [int(x) for x in members])
                 for size, cluster, left, below, death, members in zip(*(v[c] for c in CARRIED[1:]))]
        edges = zip(e["number"].astype(int).tolist(), [at[int(x)] for x in e["a"]], [at[int(x)] for x in e["b"]], e["weight"].tolist())
        fell, ended = _condense(parts, edges, least, floor)
        rows = [("fell", x, c, lam, None, None, None, None, None) for x, c, lam in fell]
        rows += [("ended", up, c, lam, s, d, n, bool(chosen), None) for c, up, lam, s, chosen, d, n in ended]
        rows += [("part", group, p.cluster, p.left, p.below, p.death, p.size, None, p.members) for p in parts if p is not None]
        out = pd.DataFrame(rows, columns=["kind", "x", "cluster", "l", "below", "death", "size", "chosen", "members"])
        for c in ("x", "cluster", "size"):
            out[c] = out[c].astype("Int64")
        return out

    return v.unionByName(e).groupBy("grouped").applyInPandas(merge, kinds)


# ------------------------------------------------------------------ selection
def _doubled(table: DataFrame, step) -> DataFrame:
    """Follows ``jump`` (null at the end) by doubling; ``step(own, far)`` joins
    what a row knows with what the row it jumps to knows."""
    while table.where(F.col("jump").isNotNull()).limit(1).count():
        far = table.select(F.col("cluster").alias("jump"), F.col("jump").alias("next"), F.col("known").alias("beyond"))
        table = settle(table.join(far, "jump", "left").select(
            "cluster", F.col("next").alias("jump"), step(F.col("known"), F.col("beyond")).alias("known")))
    return table


def _topmost(clusters: DataFrame, flag: str) -> DataFrame:
    """cluster, top: the highest flagged cluster on the way to the root."""
    held = clusters.select("cluster", "parent", flag)
    inner = held.select(F.col("cluster").alias("parent"), F.lit(True).alias("__in"))
    table = settle(held.join(inner, "parent", "left").select(
        "cluster", F.when(F.col("__in"), F.col("parent")).alias("jump"), F.when(F.col(flag), F.col("cluster")).alias("known")))
    return _doubled(table, lambda own, far: F.coalesce(far, own)).select("cluster", F.col("known").alias("top"))


def _raised(clusters: DataFrame, epsilon: float) -> DataFrame:
    """Chosen clusters born below distance ``epsilon`` give way to their first
    ancestor born beyond it (the last one below the root, if there is none)."""
    chosen = clusters.join(_topmost(clusters, "chosen").where("top = cluster").select("cluster"), "cluster", "left_semi")
    inner = clusters.select(F.col("cluster").alias("parent"), F.lit(True).alias("__in"))
    ways = clusters.join(inner, "parent", "left").withColumn("__up", F.when(F.col("__in"), F.col("parent")))
    # every cluster points up until it stops; ``known`` is where it stopped
    stops = (F.lit(1.0) / F.col("birth") > F.lit(float(epsilon))) | F.col("__up").isNull()
    table = settle(ways.select("cluster", F.when(~stops, F.col("__up")).alias("jump"), F.when(stops, F.col("cluster")).alias("known")))
    end = _doubled(table, lambda own, far: F.coalesce(own, far))
    start = chosen.join(ways.select("cluster", "__up"), "cluster").select(
        F.when(F.lit(1.0) / F.col("birth") < F.lit(float(epsilon)), F.coalesce("__up", F.col("cluster"))).otherwise(F.col("cluster")).alias("at"),
        (F.lit(1.0) / F.col("birth") < F.lit(float(epsilon))).alias("low"))
    new = start.join(end.withColumnRenamed("cluster", "at"), "at").select(
        F.when(F.col("low"), F.coalesce("known", "at")).otherwise(F.col("at")).alias("cluster")).distinct().withColumn("__new", F.lit(True))
    return clusters.join(new, "cluster", "left").withColumn("chosen", F.coalesce("__new", F.lit(False))).drop("__new")


@dataclass
class DensityClusters:
    """``labels``: id, cluster (-1: noise), probability. ``clusters``: cluster,
    size, stability, persistence, birth_distance. ``tree``: a, b, weight over
    vertices; ``vertices``: id, first row, m, core and coordinates."""

    labels: DataFrame
    clusters: DataFrame
    tree: DataFrame
    vertices: DataFrame


def hdbscan(points: DataFrame, cols: Sequence[str], min_cluster_size: int = 5, min_samples: int | None = None,
            epsilon: float = 0.0, id_col: str = "row_id", cell_rows: int = TREE_ROWS,
            band_edges: int = BAND_EDGES) -> DensityClusters:
    """HDBSCAN* (excess of mass) over all rows.

    min_samples counts the point itself and defaults to min_cluster_size; edges
    of equal weight are merged in the order of their ends; distance 0 counts as
    the least positive edge weight when it is turned into a density. Clusters
    are numbered from 0 by their smallest row id; the root is never a cluster.
    Rows with a null, NaN or infinite coordinate are noise; fewer rows than
    min_cluster_size, and an empty table, give no cluster."""
    from constella.operators.hierarchy import core_distances

    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    cols = list(cols)
    pts = settle(_finite(points, cols, id_col))
    core = core_distances(pts, cols, min_samples or min_cluster_size, id_col)
    grouped = (pts.join(core, id_col, "left").groupBy(*[_q(c) for c in cols])
               .agg(F.min(id_col).alias("first_row"), F.count(F.lit(1)).alias("m"), F.max("core_distance").alias("core")))
    vertices = global_row_number(grouped.withColumn("core", F.coalesce("core", F.lit(0.0))), ["first_row"], "__n")
    vertices = settle(vertices.withColumn("id", F.col("__n") - 1).drop("__n"))
    tree = spanning_tree(vertices, cols, cell_rows)
    fell, clusters = condensed_tree(vertices, tree, min_cluster_size, band_edges)
    clusters = settle(clusters)
    if epsilon > 0:
        clusters = settle(_raised(clusters, epsilon))
    fell = settle(fell.join(_topmost(clusters, "chosen"), "cluster", "left"))
    death = clusters.select(F.col("cluster").alias("top"), "death")
    member = fell.where(F.col("top").isNotNull()).join(death, "top").select(
        F.col("vertex").alias("id"), "top", (F.least("lam", "death") / F.col("death")).alias("probability"))
    at = settle(vertices.join(member, "id", "left"))
    sizes = at.where(F.col("top").isNotNull()).groupBy("top").agg(F.min("first_row").alias("first_row"), F.sum("m").alias("rows"))
    number = global_row_number(sizes, ["first_row"], "__n").withColumn("number", (F.col("__n") - 1).cast("int"))
    number = settle(number.select("top", "number", "rows"))
    spot = at.join(number, "top", "left").select(*[_q(c) for c in cols], F.coalesce("number", F.lit(-1)).alias("cluster"),
                                                 F.coalesce("probability", F.lit(0.0)).alias("probability"))
    found = pts.join(spot, cols).select(id_col, "cluster", "probability")
    labels = points.select(_q(id_col)).join(found, id_col, "left").select(
        id_col, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
    densest = fell.agg(F.max("lam")).first()[0] or 1.0
    table = clusters.join(number, F.col("cluster") == F.col("top")).select(
        F.col("number").alias("cluster"), F.col("rows").alias("size"), "stability",
        (F.col("stability") / (F.col("rows") * F.lit(float(densest)))).alias("persistence"), (F.lit(1.0) / F.col("birth")).alias("birth_distance"))
    return DensityClusters(labels, table, tree, vertices)
