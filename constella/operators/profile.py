"""Profiling (P1-P10): shape, head, column types, per-column statistics.

All per-column work runs as one unpivot + one grouped aggregate (partial
aggregation map-side, so a column never lands whole in one task); medians use
the histogram-narrowing exact quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from constella.functions.numeric import round_to
from constella.functions.quantiles import exact_quantiles


def _q(c: str):
    return F.col(f"`{c}`")


def is_numeric(dtype) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _map_lit(d: dict):
    """A small driver dict as a map literal (bounded by the number of columns)."""
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v).cast("double")]
    return F.create_map(*items) if items else F.create_map().cast("map<string,double>")


# P1
def shape(df: DataFrame) -> DataFrame:
    cols = df.columns
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(cols)).cast("int").alias("n_cols"),
        F.lit(",".join(cols)).alias("columns"))


# P2
def head(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


# P3
def column_types(df: DataFrame, order_by: Sequence[str], first: int = 100) -> DataFrame:
    """numeric iff every non-null value among the first rows parses as a
    float; unknown when all are null; categorical otherwise."""
    top = df.orderBy(*order_by).limit(first)
    aggs = []
    for c in df.columns:
        s = _q(c).cast("string")
        aggs.append(F.count(_q(c)).alias(f"n__{c}"))
        aggs.append(F.count_if(_q(c).isNotNull() & F.expr(f"try_cast(CAST(`{c}` AS STRING) AS DOUBLE)").isNull())
                    .alias(f"bad__{c}"))
    row = top.agg(*aggs)
    kinds = [F.struct(F.lit(c).alias("column_name"),
                      F.when(F.col(f"n__{c}") == 0, "unknown")
                       .when(F.col(f"bad__{c}") > 0, "categorical")
                       .otherwise("numeric").alias("column_type"))
             for c in df.columns]
    return row.select(F.inline(F.array(*kinds)))


def _unpivot_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _q(c).cast("double").alias("value")) for c in cols])))


# P4
def numeric_stats(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """count, null_count, unique_count, min, max, mean, median and sample std
    (0 when one value) per numeric column."""
    cols = list(cols or numeric_columns(df))
    long = _unpivot_double(df, cols)
    agg = long.groupBy("column_name").agg(
        F.count("value").alias("count"),
        F.count_if(F.col("value").isNull()).alias("null_count"),
        F.countDistinct("value").alias("unique_count"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"))
    med = exact_quantiles(df, cols, [0.5])
    medians = _map_lit({c: med[(c, 0.5)] for c in cols})
    return agg.select(
        "column_name", "count", "null_count", "unique_count", "min", "max",
        round_to("mean", digits).alias("mean"),
        round_to(medians[F.col("column_name")], digits).alias("median"),
        round_to(F.when(F.col("count") == 1, F.lit(0.0)).otherwise(F.col("std")), digits).alias("std"))


# P5
def categorical_stats(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Top-k values per column by count; ties by value (the reference keeps
    first-seen order, which a distributed scan does not have)."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("value")) for c in cols])))
    counts = long.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("value_count"))
    w = Window.partitionBy("column_name").orderBy(F.desc("value_count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# P6
def profile(df: DataFrame, order_by: Sequence[str], digits: int = 6) -> DataFrame:
    """One row per column: type (P3 rule), counts, numeric stats or top value."""
    cols = df.columns
    types = column_types(df, order_by)
    num = [c for c in cols if is_numeric(df.schema[c].dataType)]
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("text"),
                 (_q(c).cast("double") if c in num else F.lit(None).cast("double")).alias("value"))
        for c in cols])))
    base = long.groupBy("column_name").agg(
        F.count("text").alias("count"),
        F.count_if(F.col("text").isNull()).alias("null_count"),
        F.countDistinct("text").alias("unique_count"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    top = categorical_stats(df.select(*[c for c in cols if c not in num]), [c for c in cols if c not in num], 1) \
        .select("column_name", F.col("value").alias("top_value"), F.col("value_count").alias("top_count"))
    med = exact_quantiles(df, num, [0.5]) if num else {}
    medians = _map_lit({c: med[(c, 0.5)] for c in num})
    return (base.join(types, "column_name").join(top, "column_name", "left")
            .select("column_name", "column_type", "count", "null_count", "unique_count", "min", "max",
                    round_to("mean", digits).alias("mean"),
                    round_to(medians[F.col("column_name")], digits).alias("median"),
                    round_to(F.when(F.col("count") == 1, F.lit(0.0)).otherwise(F.col("std")), digits).alias("std"),
                    "top_value", "top_count"))


# P7
def overview(df: DataFrame) -> DataFrame:
    """rows, columns, numeric/text columns holding a value, nulls including
    empty strings, completeness % to one decimal."""
    cols = df.columns
    fields = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in cols if is_numeric(fields[c])]
    text = [c for c in cols if isinstance(fields[c], T.StringType)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(numeric):
        aggs.append(F.max(F.when(_q(c).isNotNull() & ~F.isnan(_q(c).cast("double")), 1).otherwise(0)).alias(f"n{i}"))
    for i, c in enumerate(text):
        aggs.append(F.max(F.when(_q(c).isNotNull(), 1).otherwise(0)).alias(f"t{i}"))
    missing = [F.count_if(_q(c).isNull() | (_q(c) == "") if c in text else _q(c).isNull()) for c in cols]
    aggs.append(sum(missing[1:], missing[0]).alias("null_values"))
    r = df.agg(*aggs)
    ncols = F.lit(len(cols)).cast("bigint")
    n_num = sum([F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in range(len(numeric))], F.lit(0))
    n_txt = sum([F.coalesce(F.col(f"t{i}"), F.lit(0)) for i in range(len(text))], F.lit(0))
    cells = F.col("rows") * ncols
    return r.select(
        "rows", ncols.alias("columns"), n_num.cast("bigint").alias("numeric_columns"),
        n_txt.cast("bigint").alias("text_columns"), "null_values",
        F.when(cells == 0, F.lit(None).cast("double"))
         .otherwise(F.round((cells - F.col("null_values")) / cells * 100, 1)).alias("completeness_pct"))


# P8
def column_preview(df: DataFrame, order_by: Sequence[str], n_rows: int = 3, n_cols: int = 10) -> DataFrame:
    """NUM/TEXT tag and two example values from the first rows, first columns."""
    cols = df.columns[:n_cols]
    first = df.orderBy(*order_by).limit(n_rows)
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                      F.lit("NUM" if is_numeric(fields[c]) else "TEXT").alias("kind"),
                      _q(c).cast("string").alias("value"), F.col("__o").alias("o"))
             for i, c in enumerate(cols)]
    w = Window.orderBy(*order_by)
    long = first.withColumn("__o", F.row_number().over(w)).select(F.inline(F.array(*parts)))
    long = long.where(F.col("value").isNotNull())
    g = long.groupBy("position", "column_name", "kind").agg(
        F.sort_array(F.collect_list(F.struct("o", "value"))).alias("vals"))
    return g.select("position", "column_name",
                    # a column with no value among the first rows cannot be NUM
                    "kind",
                    F.array_join(F.transform(F.slice("vals", 1, 2), lambda s: s["value"]), ", ").alias("examples"))


# P9
def extended_profile(df: DataFrame) -> DataFrame:
    """Declared-type kind per column (numeric, categorical, datetime, boolean),
    min/max for numeric, unique and null counts, plus dataset duplicate rows
    and missing values."""
    fields = {f.name: f.dataType for f in df.schema.fields}

    def kind(dt):
        if isinstance(dt, T.BooleanType):
            return "boolean"
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "datetime"
        if is_numeric(dt):
            return "numeric"
        return "categorical"

    cols = df.columns
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(kind(fields[c])).alias("kind"),
                 F.lit(fields[c].simpleString()).alias("data_type"),
                 _q(c).cast("string").alias("text"),
                 (_q(c).cast("double") if is_numeric(fields[c]) else F.lit(None).cast("double")).alias("value"))
        for c in cols])))
    per_col = long.groupBy("column_name", "kind", "data_type").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.countDistinct("text").alias("unique_count"),
        F.count_if(F.col("text").isNull()).alias("null_count"))
    total = df.count()
    distinct = df.distinct().count()
    return per_col.select("*", F.lit(total - distinct).cast("bigint").alias("duplicate_rows"),
                          F.sum("null_count").over(Window.partitionBy()).alias("missing_values"))
