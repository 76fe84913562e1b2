"""Numeric helpers shared by operators and oracle SQL.

Float sums differ in the last bit between engines (and between partitionings
of the same engine). Rounding a value that sits on a decimal tie then flips
either way. ``round_to`` first rounds to three more digits (absorbing the
last-bit noise) and then rounds half up, with the same arithmetic in Spark
and in SQL, so both sides land on the same double. ``round_sig`` does the
same at a number of significant digits, for values of large magnitude.
NaN, infinities and values too large to hold such digits stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    rounded = F.floor(F.round(c * F.lit(scale), 3) + F.lit(0.5)) / F.lit(scale)
    # floor gives a long: only where that is exact
    return F.when(F.abs(c * F.lit(scale)) < F.lit(2.0 ** 52), rounded).otherwise(c).cast("double")


def round_sql(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"CAST(floor(round(({expr}) * {scale}, 3) + 0.5) / {scale} AS DOUBLE)"


def round_sig(c: Column | str, sig: int = 10) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    e = F.lit(sig - 1) - F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), e)
    rounded = F.floor(F.round(c * scale, 3) + F.lit(0.5)) / scale
    finite = F.abs(c) < F.lit(float("inf"))
    return F.when(c == 0, F.lit(0.0)).when(finite, rounded).otherwise(c).cast("double")


def round_sig_sql(expr: str, sig: int = 10) -> str:
    scale = f"pow(10.0, {sig - 1} - floor(log10(abs({expr}))))"
    return (f"CASE WHEN ({expr}) = 0 THEN CAST(0.0 AS DOUBLE) ELSE "
            f"CAST(floor(round(({expr}) * {scale}, 3) + 0.5) / {scale} AS DOUBLE) END")
