"""Exact quantiles without gathering a column into one task.

Spark's exact ``percentile`` aggregate keeps every distinct value of a group in
one buffer; for a global statistic that is one task holding the whole column.
Here each pass is an ordinary distributed aggregate (a histogram of at most
``buckets`` rows per open interval); the driver only walks the histogram and
narrows the interval that holds the wanted rank. Values are exact and
interpolated linearly between the two neighbouring order statistics (the same
rule as numpy ``linear``, Spark ``percentile`` and DuckDB ``quantile_cont``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
FINAL_GATHER = 65536  # distinct values gathered once an interval is this small


def _col(c: str):
    return F.col(f"`{c}`").cast("double")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Iterable[float],
                    counts: dict | None = None) -> dict[tuple[str, float], float | None]:
    """Return {(column, p): value}; nulls and NaN are ignored; empty → None."""
    from constella.session import ensure_parallelism

    probs = list(probs)
    cols = list(cols)
    src = df.select(*[F.when(F.isnan(_col(c)), None).otherwise(_col(c)).alias(c) for c in cols])
    # a few passes read the same d columns: cache them (spread over the
    # cluster when the input came in too few splits), release at the end
    src = ensure_parallelism(src).persist()
    try:
        return _exact_quantiles(src, cols, probs, counts)
    finally:
        src.unpersist()


def _exact_quantiles(src: DataFrame, cols, probs, counts):
    if counts is None:
        row = src.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols]).first()
        counts = {c: row[c] for c in cols}
    # ranks[(col, rank)] -> value, filled as they resolve
    wanted: set[tuple[str, int]] = set()
    for c in cols:
        n = counts[c]
        for p in probs:
            if n:
                h = (n - 1) * p
                lo = int(math.floor(h))
                wanted.add((c, lo))
                if lo + 1 < n and h > lo:
                    wanted.add((c, lo + 1))
    resolved = _order_statistics(src, sorted(wanted), counts)
    out: dict[tuple[str, float], float | None] = {}
    for c in cols:
        n = counts[c]
        for p in probs:
            if not n:
                out[(c, p)] = None
                continue
            h = (n - 1) * p
            lo = int(math.floor(h))
            a = resolved[(c, lo)]
            if lo + 1 < n and h > lo:
                b = resolved[(c, lo + 1)]
                out[(c, p)] = a if a == b else a + (h - lo) * (b - a)
            else:
                out[(c, p)] = a
    return out


def order_statistic(df: DataFrame, col: str, rank: int) -> float | None:
    """The rank-th smallest non-null value (0-based), exactly."""
    src = df.select(F.when(F.isnan(_col(col)), None).otherwise(_col(col)).alias(col))
    n = src.agg(F.count(F.col(f"`{col}`"))).first()[0]
    if not n or rank >= n or rank < 0:
        return None
    return _order_statistics(src, [(col, rank)], {col: n})[(col, rank)]


def _order_statistics(src: DataFrame, wanted, counts) -> dict[tuple[str, int], float]:
    """k-th smallest values (0-based ranks) by iterative histogram narrowing."""
    if not wanted:
        return {}
    cols = sorted({c for c, _ in wanted})
    # infinite values are counted as the first and last ranks; intervals hold
    # finite values only
    inside = {c: F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`")) for c in cols}
    mm = src.agg(*[F.min(inside[c]).alias(f"mn{i}") for i, c in enumerate(cols)],
                 *[F.max(inside[c]).alias(f"mx{i}") for i, c in enumerate(cols)],
                 *[F.count_if(F.col(f"`{c}`") == float("-inf")).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.count(inside[c]).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    # state per target: [lo, hi, below, n_in]
    state = {}
    done: dict[tuple[str, int], float] = {}
    for c, r in wanted:
        i = cols.index(c)
        if r < mm[f"lo{i}"]:
            done[(c, r)] = float("-inf")
        elif r >= mm[f"lo{i}"] + mm[f"n{i}"]:
            done[(c, r)] = float("inf")
        else:
            state[(c, r)] = [mm[f"mn{i}"], mm[f"mx{i}"], mm[f"lo{i}"], mm[f"n{i}"]]
    for _ in range(64):
        open_t = {}
        for key, (lo, hi, below, n_in) in state.items():
            if key in done:
                continue
            if lo == hi:
                done[key] = lo
                continue
            open_t[key] = (lo, hi, below, n_in)
        if not open_t:
            break
        # distinct intervals (several ranks often share one)
        intervals = sorted({(k[0], v[0], v[1], v[3]) for k, v in open_t.items()})
        small = [iv for iv in intervals if iv[3] <= FINAL_GATHER]
        large = [iv for iv in intervals if iv[3] > FINAL_GATHER]
        if small:
            _gather(src, small, open_t, done)
        if large:
            _histogram(src, large, open_t, state)
    return done


def _interval_members(src, intervals, payload):
    parts = []
    for iid, (c, lo, hi, _) in enumerate(intervals):
        v = F.col(f"`{c}`")
        parts.append(F.when(v.between(F.lit(lo), F.lit(hi)), payload(iid, v, lo, hi)))
    return src.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("s"))


def _histogram(src, intervals, open_t, state):
    def payload(iid, v, lo, hi):
        b = F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * BUCKETS), F.lit(BUCKETS - 1))
        return F.struct(F.lit(iid).alias("i"), b.cast("int").alias("b"), v.alias("v"))

    rows = (_interval_members(src, intervals, payload)
            .groupBy("s.i", "s.b")
            .agg(F.count("*").alias("n"), F.min("s.v").alias("mn"), F.max("s.v").alias("mx"))
            .collect())
    hist: dict[int, list] = {}
    for r in rows:
        hist.setdefault(r["i"], []).append((r["b"], r["n"], r["mn"], r["mx"]))
    for key, (lo, hi, below, n_in) in open_t.items():
        iid = next((j for j, iv in enumerate(intervals) if iv[0] == key[0] and iv[1] == lo and iv[2] == hi), None)
        if iid is None:
            continue
        target = key[1] - below
        acc = 0
        for b, n, mn, mx in sorted(hist.get(iid, [])):
            if acc + n > target:
                state[key] = [mn, mx, below + acc, n]
                break
            acc += n


def _gather(src, intervals, open_t, done):
    def payload(iid, v, lo, hi):
        return F.struct(F.lit(iid).alias("i"), v.alias("v"))

    rows = (_interval_members(src, intervals, payload)
            .groupBy("s.i", "s.v").agg(F.count("*").alias("n")).collect())
    vals: dict[int, list] = {}
    for r in rows:
        vals.setdefault(r["i"], []).append((r["v"], r["n"]))
    for key, (lo, hi, below, n_in) in open_t.items():
        iid = next((j for j, iv in enumerate(intervals) if iv[0] == key[0] and iv[1] == lo and iv[2] == hi), None)
        if iid is None:
            continue
        target = key[1] - below
        acc = 0
        for v, n in sorted(vals.get(iid, [])):
            if acc + n > target:
                done[key] = v
                break
            acc += n
