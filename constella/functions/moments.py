"""Sums over all rows of numbers that numpy makes from blocks of rows.

Fits on many columns (Gram matrices, mixtures, robust covariances) need
thousands of sums. Written as aggregate columns they make plans that grow with
the square of the columns; here every task adds up its own blocks, the tasks'
totals are added in a few groups, and the driver gets ``GROUPS`` arrays whose
length depends on columns and parameters only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = 8
BLOCK = 65_536  # numbers of one array that travel together


def sum_over(df: DataFrame, cols: Sequence[str], measure: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``measure(rows x columns)`` over blocks of all rows. Rows with a
    null or NaN must be gone. ``measure`` of no rows gives the zeros."""
    cols = list(cols)

    def add(batches):
        total = measure(np.zeros((0, len(cols))))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for k in range(0, batch.num_rows, 4096):
                total = total + measure(np.column_stack([c[k:k + 4096] for c in columns]))
        context = TaskContext.get()
        part = (context.partitionId() if context else 0) % GROUPS
        pieces = [total[k:k + BLOCK].tobytes() for k in range(0, len(total), BLOCK)]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(range(len(pieces)), pa.int32()), "part": pa.array([part] * len(pieces), pa.int32()),
            "numbers": pa.array(pieces, pa.binary())})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in frame["numbers"])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "numbers": [total.tobytes()]})

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    sums = (rows.mapInArrow(add, "block int, part int, numbers binary").groupBy("block", "part")
            .applyInPandas(merge, "block int, numbers binary").collect())
    if not sums:
        return measure(np.zeros((0, len(cols))))
    blocks: dict[int, np.ndarray] = {}
    for r in sums:
        blocks[r["block"]] = blocks.get(r["block"], 0.0) + np.frombuffer(r["numbers"])
    return np.concatenate([blocks[b] for b in sorted(blocks)])


def moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean vector and centred sum of squares and products, on any number
    of columns. A first pass gives the means that the second is centred on."""
    cols = list(cols)
    d = len(cols)
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)]).first()
    n = first["n"]
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(d)])
    if not n:
        return 0, mean, np.zeros((d, d))

    def products(x):
        x = x - mean
        return np.concatenate([x.sum(0), (x.T @ x).ravel()])

    total = sum_over(df, cols, products)
    drift, squares = total[:d], total[d:].reshape(d, d)
    return n, mean + drift / n, squares - np.outer(drift, drift) / n


# ------------------------------------------------------- chi-square quantiles
def _gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    import math

    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    low = 1e-300  # continued fraction of the upper part
    b = x + 1 - a
    c, d = 1 / low, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / max(step * d + b, low)
        c = max(b + step / c, low)
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_quantile(share: float, freedom: int) -> float:
    """Value below which ``share`` of a chi-square variable lies."""
    low, high = 0.0, max(10.0, 4.0 * freedom)
    while _gamma_share(freedom / 2, high / 2) < share:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if _gamma_share(freedom / 2, mid / 2) < share:
            low = mid
        else:
            high = mid
    return (low + high) / 2
