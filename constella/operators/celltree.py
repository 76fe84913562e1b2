"""Cell tree: bounded groups of near rows for exact neighbour work.

The space is cut by medians into at most ``max_cells`` cells. The cuts come from
a bounded sample of the rows (they decide the balance of the work, never a
result); every row is then counted, and a cell with far more rows than wanted is
cut again from a sample of its own. A cell has a *region* (unbounded on the
outside, so the regions fill the space) and a tight *box* around its rows. A far
point only stretches its own cell.

A task gets the rows of one cell. What lies in other cells is reached by a
second pass: a query goes to each cell whose box is nearer than the distance it
already has, so results are exact after two passes, without rounds.

The driver holds the cuts and boxes: a few numbers per cell, at most
``max_cells`` of them, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 200_000
MAX_CELLS = 8192
CELL_ROWS = 20_000
LEAF = 256


def _q(c: str):
    return F.col(f"`{c}`")


def _cut(points: np.ndarray, wanted: int, region: tuple, leaves: list) -> tuple | int:
    """A nested tree of median cuts: (column, value, left, right), or the
    number of a leaf; ``leaves`` collects the regions."""
    lo, hi = region
    if wanted > 1 and len(points) > 1:
        spread = points.max(0) - points.min(0)
        for c in np.argsort(-spread, kind="stable"):
            if spread[c] <= 0:
                break
            at = (wanted // 2) / wanted
            value = float(np.quantile(points[:, c], at, method="inverted_cdf"))
            left = points[:, c] <= value
            if left.all():  # equal values at the top: cut below them
                value = float(points[points[:, c] < value, c].max())
                left = points[:, c] <= value
            hi_left, lo_right = hi.copy(), lo.copy()
            hi_left[c], lo_right[c] = value, value
            return (int(c), value, _cut(points[left], wanted // 2, (lo, hi_left), leaves),
                    _cut(points[~left], wanted - wanted // 2, (lo_right, hi), leaves))
    leaves.append((lo, hi))
    return len(leaves) - 1


def _place(tree, points: np.ndarray) -> np.ndarray:
    """The leaf of every point."""
    out = np.empty(len(points), np.int32)
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, tuple):
            left = points[rows, node[0]] <= node[1]
            todo += [(node[2], rows[left]), (node[3], rows[~left])]
        else:
            out[rows] = node
    return out


@dataclass
class CellTree:
    cols: list[str]
    tree: tuple | int
    low: np.ndarray      # regions
    high: np.ndarray
    box_low: np.ndarray  # boxes around the rows
    box_high: np.ndarray
    rows: np.ndarray

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Distance from points to every box (points x cells); infinite for
        cells without rows."""
        d2 = np.zeros((len(points), len(self.rows)))
        for i in range(len(self.cols)):
            x = points[:, i, None]
            d2 += np.maximum(np.maximum(self.box_low[None, :, i] - x, x - self.box_high[None, :, i]), 0.0) ** 2
        return np.sqrt(d2)

    def within(self, points: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each point surely has k + 1 rows (all rows
        of a box are nearer than its farthest corner)."""
        full = self.rows > 0
        d2 = np.zeros((len(points), int(full.sum())))
        for i in range(len(self.cols)):
            x = points[:, i, None]
            d2 += np.maximum(np.abs(x - self.box_low[None, full, i]), np.abs(self.box_high[None, full, i] - x)) ** 2
        order = np.argsort(d2, axis=1)
        enough = np.cumsum(self.rows[full][order], axis=1) > k
        at = np.where(enough.any(1), enough.argmax(1), d2.shape[1] - 1)
        return np.sqrt(np.take_along_axis(d2, np.take_along_axis(order, at[:, None], 1), 1)[:, 0])


def build(points: DataFrame, cols: Sequence[str], cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS,
          sample: int = SAMPLE) -> tuple[DataFrame, CellTree]:
    """``points`` with the column ``cell``, and the tree. Points must hold no
    nulls."""
    cols = list(cols)
    n = points.count()
    wanted = int(min(max(1, -(-n // cell_rows)), max_cells, max(1, sample // 16)))
    everywhere = (np.full(len(cols), -np.inf), np.full(len(cols), np.inf))
    leaves: list[tuple] = []
    if wanted == 1:
        tree: tuple | int = 0
        leaves.append(everywhere)
    else:
        tree = _cut(_sample(points, cols, n, sample), wanted, everywhere, leaves)
    placed = _assign(points, cols, tree)
    size = _sizes(placed)
    limit = 4 * max(cell_rows, n // max_cells)
    while len(leaves) < max_cells:
        large = {c: m for c, m in size.items() if m > limit}
        if not large:
            break
        more = _sample(placed.where(F.col("cell").isin(list(large))), cols, sum(large.values()), sample)
        where = _place(tree, more)
        grown: dict[int, tuple] = {}
        for c, m in large.items():
            inside = more[where == c]
            if len(inside) and (inside.max(0) > inside.min(0)).any():
                grown[c] = (inside, min(-(-m // cell_rows), max_cells - len(leaves)))
        if not grown:
            break
        regions, leaves = leaves, []

        def again(node):
            if isinstance(node, tuple):
                return (node[0], node[1], again(node[2]), again(node[3]))
            if node in grown:
                return _cut(*grown[node], regions[node], leaves)
            leaves.append(regions[node])
            return len(leaves) - 1

        before = len(regions)
        tree = again(tree)
        placed = _assign(points, cols, tree)
        size = _sizes(placed)
        if len(leaves) == before:
            break
    stats = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(_q(c)).alias(f"a{i}") for i, c in enumerate(cols)],
        *[F.max(_q(c)).alias(f"b{i}") for i, c in enumerate(cols)]).collect()
    box_low, box_high = np.full((len(leaves), len(cols)), np.inf), np.full((len(leaves), len(cols)), -np.inf)
    rows = np.zeros(len(leaves), np.int64)
    for r in stats:
        rows[r["cell"]] = r["n"]
        box_low[r["cell"]] = [r[f"a{i}"] for i in range(len(cols))]
        box_high[r["cell"]] = [r[f"b{i}"] for i in range(len(cols))]
    return placed, CellTree(cols, tree, np.array([x[0] for x in leaves]), np.array([x[1] for x in leaves]),
                            box_low, box_high, rows)


def _sample(points, cols, n, bound) -> np.ndarray:
    share = min(1.0, bound / max(n, 1))
    part = points if share >= 1.0 else points.sample(False, share, 11)
    return part.select(*[_q(c) for c in cols]).limit(2 * bound).toPandas().to_numpy(float)


def _assign(points: DataFrame, cols: list[str], tree) -> DataFrame:
    if not isinstance(tree, tuple):
        return points.withColumn("cell", F.lit(0))
    held = points.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def cell(*values: pd.Series) -> pd.Series:
        return pd.Series(_place(held.value, np.column_stack([v.to_numpy(float) for v in values])))

    return points.withColumn("cell", cell(*[_q(c) for c in cols]))


def _sizes(placed: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


# ------------------------------------------------------------ inside one task
class Leaves:
    """The rows of one cell in leaves of at most ``LEAF`` rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order, self.slices = [], []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) > leaf:
                p = points[rows]
                c = int(np.argmax(p.max(0) - p.min(0)))
                half = len(rows) // 2
                by = np.argpartition(p[:, c], half)
                todo += [rows[by[half:]], rows[by[:half]]]
            elif len(rows):
                self.slices.append((len(order), len(order) + len(rows)))
                order.extend(rows.tolist())
        self.order = np.array(order, np.int64)
        self.points = points[self.order]
        self.low = np.array([self.points[a:b].min(0) for a, b in self.slices]).reshape(len(self.slices), -1)
        self.high = np.array([self.points[a:b].max(0) for a, b in self.slices]).reshape(len(self.slices), -1)

    def gaps(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Distance from a box to every leaf."""
        return np.sqrt((np.maximum(np.maximum(self.low - high, low - self.high), 0.0) ** 2).sum(1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d2 += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(d2)


def nearest(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int,
            bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest points of each query, itself (equal
    id) left out, ties by id; -1 and infinity where there are fewer, or none
    within ``bound``."""
    out_id = np.full((len(queries), k), -1, np.int64)
    out_d = np.full((len(queries), k), np.inf)
    if not len(queries) or not len(points) or not k:
        return out_id, out_d
    data, probe = Leaves(points), Leaves(queries)
    ids = ids[data.order]
    probe_ids = query_ids[probe.order]
    for a, b in probe.slices:
        q, mine = probe.points[a:b], probe_ids[a:b]
        best_d = np.full((b - a, k), np.inf)
        best_i = np.full((b - a, k), np.iinfo(np.int64).max)
        reach = np.full(b - a, np.inf) if bound is None else bound[probe.order[a:b]]
        gaps = data.gaps(q.min(0), q.max(0))
        for leaf in np.argsort(gaps, kind="stable"):
            if gaps[leaf] > reach.max():
                break
            x, y = data.slices[leaf]
            near = np.sqrt((np.maximum(np.maximum(data.low[leaf] - q, q - data.high[leaf]), 0.0) ** 2).sum(1)) <= reach
            rows = np.flatnonzero(near)
            if not len(rows):
                continue
            d = distances(q[rows], data.points[x:y])
            d[mine[rows, None] == ids[None, x:y]] = np.inf
            d[d > reach[rows, None]] = np.inf
            all_d = np.concatenate([best_d[rows], d], 1)
            all_i = np.concatenate([best_i[rows], np.broadcast_to(ids[None, x:y], d.shape)], 1)
            part = np.argpartition(all_d, k - 1, axis=1)
            kth = np.take_along_axis(all_d, part[:, k - 1:k], 1)
            keep = int((all_d <= kth).sum(1).max())
            if keep > k:  # every row that ties with the k-th stays in the running
                part = np.argpartition(all_d, keep - 1, axis=1)[:, :keep] if keep < all_d.shape[1] else part
                part = np.take_along_axis(part, np.lexsort((np.take_along_axis(all_i, part, 1),
                                                            np.take_along_axis(all_d, part, 1)), axis=1), 1)
            best_d[rows] = np.take_along_axis(all_d, part[:, :k], 1)
            best_i[rows] = np.take_along_axis(all_i, part[:, :k], 1)
            reach[rows] = np.minimum(reach[rows], kth[:, 0])
        first = np.lexsort((best_i, best_d), axis=1)  # once, not a leaf: only ties need the order before
        best_d, best_i = np.take_along_axis(best_d, first, 1), np.take_along_axis(best_i, first, 1)
        out_d[probe.order[a:b]] = best_d
        out_id[probe.order[a:b]] = np.where(np.isfinite(best_d), best_i, -1)
    return out_id, out_d


def knn(points: DataFrame, cols: Sequence[str], k: int, id_col: str = "row_id", queries: DataFrame | None = None,
        weight: float = 1.0, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS) -> DataFrame:
    """Exact k nearest rows of ``points`` for every row of ``queries`` (default:
    the points), equal ids left out, ties by id: id_col, neighbor_id, rank,
    distance (times the root of ``weight``). First every query is answered in
    the cell it falls in, then it goes to the cells whose box is nearer than its
    k-th distance; the two answers are merged."""
    cols = list(cols)
    placed, tree = build(points, cols, cell_rows, max_cells)
    asked = placed if queries is None else _assign(queries, cols, tree.tree)
    both = (placed.select(_q(id_col).cast("long").alias("id"), "cell", *[_q(c).cast("double").alias(c) for c in cols],
                          F.lit(True).alias("data"), F.lit(queries is None).alias("asks"), F.lit(float("inf")).alias("bound")))
    if queries is not None:
        both = both.unionByName(asked.select(
            _q(id_col).cast("long").alias("id"), "cell", *[_q(c).cast("double").alias(c) for c in cols],
            F.lit(False).alias("data"), F.lit(True).alias("asks"), F.lit(float("inf")).alias("bound")))

    def answer(frame: pd.DataFrame):
        data, ask = frame[frame["data"]], frame[frame["asks"]]
        found, far = nearest(ask[cols].to_numpy(float), ask["id"].to_numpy(), data[cols].to_numpy(float),
                             data["id"].to_numpy(), k, ask["bound"].to_numpy(float))
        return ask, found, far

    def objects(rows, index):  # also for no rows
        return pd.Series(list(rows), index=index, dtype=object)

    named = "id long, neighbors array<long>, distances array<double>"
    coords = ", ".join(f"`{c}` double" for c in cols)

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        ask, found, far = answer(frame)
        out = ask[["id", *cols, "cell"]].copy()
        out["neighbors"], out["distances"] = objects(found, out.index), objects(far, out.index)
        return out

    one = both.groupBy("cell").applyInPandas(first, f"id long, {coords}, cell int, neighbors array<long>, distances array<double>")
    if len(tree.rows) == 1:
        answers = one.select("id", "neighbors", "distances")
    else:
        from constella.session import settle

        one = settle(one)
        held = points.sparkSession.sparkContext.broadcast(tree)

        def send(frames):
            boxes = held.value
            for frame in frames:
                for k0 in range(0, len(frame), 2000):
                    f = frame.iloc[k0:k0 + 2000]
                    at = f[cols].to_numpy(float)
                    bound = np.array([d[-1] for d in f["distances"]], float)
                    short = np.isinf(bound)
                    if short.any():  # a cell with fewer than k other rows
                        bound[short] = boxes.within(at[short], k) * (1 + 1e-9)
                    reach = boxes.gaps(at) <= bound[:, None]
                    reach[np.arange(len(f)), f["cell"].to_numpy()] = False
                    r, c = np.nonzero(reach)
                    out = f.iloc[r][["id", *cols]].copy()
                    out["cell"], out["bound"] = c.astype(np.int32), bound[r]
                    yield out

        visits = one.select("id", *[_q(c) for c in cols], "cell", "distances").mapInPandas(
            send, f"id long, {coords}, cell int, bound double")
        # a cell may get many visitors: they are dealt over tasks, the cell's rows copied to each
        visits = settle(visits)
        many = {r["cell"]: -(-r["n"] // (4 * cell_rows)) for r in
                visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        share = points.sparkSession.createDataFrame(sorted(many.items()) or [(0, 1)], "cell int, shares long")
        share = F.broadcast(share)  # one row a cell
        spread = visits.join(share, "cell").select(
            "*", F.pmod(F.xxhash64("id"), F.col("shares")).alias("share"), F.lit(False).alias("data"),
            F.lit(True).alias("asks")).drop("shares")
        copies = both.where("data").withColumn("asks", F.lit(False)).join(share, "cell").withColumn(
            "share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")

        def second(frame: pd.DataFrame) -> pd.DataFrame:
            ask, found, far = answer(frame)
            return pd.DataFrame({"id": ask["id"], "neighbors": objects(found, ask.index), "distances": objects(far, ask.index)})

        two = spread.unionByName(copies).groupBy("cell", "share").applyInPandas(second, named)
        answers = one.select("id", "neighbors", "distances").unionByName(two)
    # the k best of a query's answers, at most k from each cell it visited
    entry = F.transform(F.arrays_zip("neighbors", "distances"),
                        lambda p: F.struct(p["distances"].alias("d"), p["neighbors"].alias("n")))
    found = answers.select("id", F.filter(entry, lambda p: p["d"] < float("inf")).alias("p"))
    if len(tree.rows) > 1:
        found = found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
    return found.select(F.col("id").alias(id_col), F.posexplode("p").alias("r", "p")).select(
        id_col, F.col("p.n").alias("neighbor_id"), (F.col("r") + 1).cast("int").alias("rank"),
        (F.col("p.d") * float(np.sqrt(weight))).alias("distance"))


# ------------------------------------------------- density on a grid, in a task
PAIRS = 2_000_000  # row pairs that are compared at once


class grid_cells:
    """Weighted points on a grid of side eps / sqrt(d): points of one grid cell
    are all within eps of each other. A cell with ``least`` rows is core without
    a comparison; only rows of the others count their neighbours. Two cells are
    compared until one pair of core rows links them."""

    def __init__(self, points: np.ndarray, weight: np.ndarray, eps: float, least: int):
        self.points, self.weight, self.eps, self.least = points, weight, eps, least
        n, d = points.shape
        side = eps / np.sqrt(d) * (1 - 1e-9)
        keys = np.floor((points - points.min(0)) / side) if eps > 0 else points
        cells, self.cell = np.unique(keys, axis=0, return_inverse=True)
        self.cell = self.cell.ravel()
        self.order = np.argsort(self.cell, kind="stable")
        self.start = np.searchsorted(self.cell[self.order], np.arange(len(cells) + 1))
        self.size = np.bincount(self.cell, weight, len(cells))
        self.pairs = self._near(cells, d) if eps > 0 else np.zeros((0, 2), np.int64)

    def _near(self, cells: np.ndarray, d: int) -> np.ndarray:
        """Pairs (a < b) of cells that can hold points within eps."""
        tree = Leaves(cells, 64)
        out, limit = [], np.sqrt(d) * (1 + 1e-6)
        for a, b in tree.slices:
            x = tree.points[a:b]
            # distance of two cells counts the steps between their near sides
            gap = np.maximum(np.maximum(tree.low - x.max(0), x.min(0) - tree.high) - 1, 0)
            for leaf in np.flatnonzero(np.sqrt((gap ** 2).sum(1)) <= limit):
                u, v = tree.slices[leaf]
                y = tree.points[u:v]
                d2 = np.zeros((b - a, v - u))
                for i in range(d):
                    d2 += np.maximum(np.abs(x[:, None, i] - y[None, :, i]) - 1, 0) ** 2
                p, q = np.nonzero(d2 <= limit * limit)
                p, q = tree.order[a + p], tree.order[u + q]
                out.append(np.stack([p[p < q], q[p < q]], 1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def rows(self, cell: int) -> np.ndarray:
        return self.order[self.start[cell]:self.start[cell + 1]]

    def _row_pairs(self, a: np.ndarray, b: np.ndarray, left: np.ndarray):
        """(row of a, row of b) within eps for pairs of cells, rows of a only
        where ``left``; in parts of about PAIRS."""
        count = np.diff(self.start)
        work = np.cumsum(count[a] * count[b])
        done = 0
        while done < len(a):
            upto = max(done + 1, int(np.searchsorted(work, (work[done - 1] if done else 0) + PAIRS, "right")))
            na, nb = count[a[done:upto]], count[b[done:upto]]
            which = np.repeat(np.arange(upto - done), na * nb)
            at = np.arange(len(which)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            p = self.order[self.start[a[done:upto]][which] + at // nb[which]]
            q = self.order[self.start[b[done:upto]][which] + at % nb[which]]
            ok = left[p]
            p, q = p[ok], q[ok]
            d2 = np.zeros(len(p))
            for i in range(self.points.shape[1]):
                d2 += (self.points[p, i] - self.points[q, i]) ** 2
            ok = np.sqrt(d2) <= self.eps
            yield p[ok], q[ok]
            done = upto

    def core(self) -> np.ndarray:
        dense = self.size >= self.least
        out = dense[self.cell].copy()
        count = self.size[self.cell].astype(float)
        a, b = self.pairs[:, 0], self.pairs[:, 1]
        sides = [(a, b), (b, a)]
        for x, y in sides:
            open_ = ~dense[x]
            for p, q in self._row_pairs(x[open_], y[open_], ~out):
                np.add.at(count, p, self.weight[q])
        return out | (count >= self.least)

    def components(self, core: np.ndarray) -> np.ndarray:
        """For every core row a number that core rows of its component share."""
        has = np.zeros(len(self.size), bool)
        has[self.cell[core]] = True
        up = np.arange(len(self.size))

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        first = np.full(len(self.size), -1)
        at = np.flatnonzero(core)
        first[self.cell[at][::-1]] = at[::-1]
        pairs = self.pairs[has[self.pairs[:, 0]] & has[self.pairs[:, 1]]] if len(self.pairs) else self.pairs
        # one core row of each cell first: most links show there
        d2 = ((self.points[first[pairs[:, 0]]] - self.points[first[pairs[:, 1]]]) ** 2).sum(1)
        quick = np.sqrt(d2) <= self.eps
        for a, b in pairs[quick].tolist():
            up[find(a)] = find(b)
        for a, b in pairs[~quick].tolist():
            a_, b_ = find(a), find(b)
            if a_ == b_:
                continue
            p, q = self.rows(a), self.rows(b)
            p, q = p[core[p]], q[core[q]]
            for k in range(0, len(p), 256):
                if (distances(self.points[p[k:k + 256]], self.points[q]) <= self.eps).any():
                    up[a_] = b_
                    break
        return np.array([find(c) for c in range(len(up))])[self.cell]

    def touching(self, core: np.ndarray, group: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, component) for asked rows and the components with a core row
        within eps of them."""
        rows, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        hit = np.zeros(len(self.size), bool)
        hit[self.cell[core]] = True
        own = np.flatnonzero(asked & hit[self.cell])
        first = np.full(len(self.size), -1)
        at = np.flatnonzero(core)
        first[self.cell[at]] = at
        rows.append(own)
        groups.append(group[first[self.cell[own]]])
        wanted = np.zeros(len(self.size), bool)
        wanted[self.cell[asked]] = True
        a, b = (self.pairs[:, 0], self.pairs[:, 1])
        for x, y in ((a, b), (b, a)):
            use = wanted[x] & hit[y]
            for p, q in self._row_pairs(x[use], y[use], asked):
                p, q = p[core[q]], q[core[q]]
                rows.append(p)
                groups.append(group[q])
        rows, groups = np.concatenate(rows), np.concatenate(groups)
        both = np.unique(np.stack([rows, groups], 1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        return both[:, 0], both[:, 1]
