"""Registered profiling queries (P1-P9) and their DuckDB oracles."""

from __future__ import annotations

from constella.operators import profile as P
from constella.functions.numeric import round_sql as R
from constella.plans.registry import register
from constella.tables import NUMERIC_FEATURES, features, load, with_fixtures

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDERS_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]
CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_NUMERIC = ["c_custkey", "c_nationkey", "c_acctbal"]


def _union(parts):
    return " UNION ALL ".join(parts)


# ------------------------------------------------------------------------ P1
@register("p1_shape", f"SELECT count(*) AS n_rows, CAST({len(LINEITEM_COLS)} AS INTEGER) AS n_cols, "
                      f"'{','.join(LINEITEM_COLS)}' AS columns FROM lineitem")
def p1_shape(spark, sf):
    return P.shape(load(spark, sf, "lineitem"))


# ------------------------------------------------------------------------ P2
@register("p2_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def p2_head(spark, sf):
    return P.head(load(spark, sf, "orders"), ["o_orderkey"], 5)


# ------------------------------------------------------------------------ P3
def _p3_sql():
    parts = []
    for c in ORDERS_COLS:
        parts.append(
            f"SELECT '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 'unknown' "
            f"WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) > 0 "
            f"THEN 'categorical' ELSE 'numeric' END AS column_type FROM first_rows")
    return f"WITH first_rows AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100) {_union(parts)}"


@register("p3_column_types", _p3_sql())
def p3_column_types(spark, sf):
    return P.column_types(load(spark, sf, "orders"), ["o_orderkey"])


# ------------------------------------------------------------------------ P4
def _p4_sql():
    long = _union([f"SELECT '{c}' AS column_name, {c} AS value FROM features" for c in NUMERIC_FEATURES])
    return with_fixtures(
        f"WITH long AS ({long}) SELECT column_name, count(value) AS count, "
        "count(*) FILTER (WHERE value IS NULL) AS null_count, count(DISTINCT value) AS unique_count, "
        f"min(value) AS min, max(value) AS max, {R('avg(value)')} AS mean, {R('median(value)')} AS median, "
        f"{R('CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END')} AS std "
        "FROM long GROUP BY column_name", "features")


@register("p4_numeric_stats", _p4_sql())
def p4_numeric_stats(spark, sf):
    return P.numeric_stats(features(spark, sf), NUMERIC_FEATURES)


# ------------------------------------------------------------------------ P5
P5_COLS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


def _p5_sql():
    long = _union([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM orders" for c in P5_COLS])
    return (f"WITH long AS ({long}), counts AS (SELECT column_name, value, count(*) AS value_count FROM long "
            "WHERE value IS NOT NULL GROUP BY column_name, value), ranked AS (SELECT *, row_number() OVER "
            "(PARTITION BY column_name ORDER BY value_count DESC, value ASC) AS rank FROM counts) "
            "SELECT column_name, value, value_count, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")


@register("p5_categorical_stats", _p5_sql())
def p5_categorical_stats(spark, sf):
    return P.categorical_stats(load(spark, sf, "orders"), P5_COLS, 5)


# ------------------------------------------------------------------------ P6
def _p6_sql():
    types = []
    for c in CUSTOMER_COLS:
        types.append(
            f"SELECT '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 'unknown' "
            f"WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) > 0 "
            f"THEN 'categorical' ELSE 'numeric' END AS column_type FROM first_rows")
    long = _union([
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS text, "
        f"{('CAST(' + c + ' AS DOUBLE)') if c in CUSTOMER_NUMERIC else 'CAST(NULL AS DOUBLE)'} AS value FROM customer"
        for c in CUSTOMER_COLS])
    return (
        "WITH first_rows AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 100), "
        f"types AS ({_union(types)}), long AS ({long}), "
        "base AS (SELECT column_name, count(text) AS count, count(*) FILTER (WHERE text IS NULL) AS null_count, "
        "count(DISTINCT text) AS unique_count, min(value) AS min, max(value) AS max, avg(value) AS mean, "
        "median(value) AS median, stddev_samp(value) AS std FROM long GROUP BY column_name), "
        "cnt AS (SELECT column_name, text, count(*) AS n FROM long WHERE text IS NOT NULL AND column_name IN "
        f"({', '.join(repr(c) for c in CUSTOMER_COLS if c not in CUSTOMER_NUMERIC)}) GROUP BY column_name, text), "
        "top AS (SELECT column_name, text AS top_value, n AS top_count FROM (SELECT *, row_number() OVER "
        "(PARTITION BY column_name ORDER BY n DESC, text) AS r FROM cnt) WHERE r = 1) "
        "SELECT b.column_name, t.column_type, b.count, b.null_count, b.unique_count, b.min, b.max, "
        f"{R('b.mean')} AS mean, {R('b.median')} AS median, "
        f"{R('CASE WHEN b.count = 1 THEN 0.0 ELSE b.std END')} AS std, p.top_value, p.top_count "
        "FROM base b JOIN types t USING (column_name) LEFT JOIN top p USING (column_name)")


@register("p6_profile", _p6_sql())
def p6_profile(spark, sf):
    return P.profile(load(spark, sf, "customer"), ["c_custkey"])


# ------------------------------------------------------------------------ P7
def _p7_sql():
    numeric = ["o_orderkey", "o_custkey", "o_totalprice"]
    text = ["o_orderstatus", "o_orderpriority"]
    num_present = " + ".join(f"max(CASE WHEN {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)) THEN 1 ELSE 0 END)"
                             for c in numeric)
    txt_present = " + ".join(f"max(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in text)
    nulls = " + ".join(
        f"count(*) FILTER (WHERE {c} IS NULL{' OR ' + c + ' = ' + chr(39) * 2 if c in text else ''})"
        for c in ORDERS_COLS)
    n = len(ORDERS_COLS)
    return (f"WITH s AS (SELECT count(*) AS rows, CAST({num_present} AS BIGINT) AS numeric_columns, "
            f"CAST({txt_present} AS BIGINT) AS text_columns, CAST({nulls} AS BIGINT) AS null_values FROM orders) "
            f"SELECT rows, CAST({n} AS BIGINT) AS columns, numeric_columns, text_columns, null_values, "
            f"CASE WHEN rows = 0 THEN NULL ELSE round((rows * {n} - null_values) / (rows * {n}) * 100, 1) END "
            "AS completeness_pct FROM s")


@register("p7_overview", _p7_sql())
def p7_overview(spark, sf):
    return P.overview(load(spark, sf, "orders"))


# ------------------------------------------------------------------------ P8
def _p8_sql():
    parts = [f"SELECT {i} AS position, '{c}' AS column_name, "
             f"'{'NUM' if c in ORDERS_NUMERIC else 'TEXT'}' AS kind, CAST({c} AS VARCHAR) AS value, o FROM first_rows"
             for i, c in enumerate(ORDERS_COLS)]
    return ("WITH first_rows AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS o FROM "
            f"(SELECT * FROM orders ORDER BY o_orderkey LIMIT 3)), long AS ({_union(parts)}), "
            "nn AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY o) AS k FROM long "
            "WHERE value IS NOT NULL) "
            "SELECT CAST(position AS INTEGER) AS position, column_name, kind, "
            "string_agg(value, ', ' ORDER BY o) FILTER (WHERE k <= 2) AS examples "
            "FROM nn GROUP BY position, column_name, kind")


@register("p8_column_preview", _p8_sql())
def p8_column_preview(spark, sf):
    return P.column_preview(load(spark, sf, "orders"), ["o_orderkey"])


# ------------------------------------------------------------------------ P9
def _p9_sql():
    kinds = {"o_orderkey": ("numeric", "bigint"), "o_custkey": ("numeric", "bigint"),
             "o_orderstatus": ("categorical", "string"), "o_totalprice": ("numeric", "double"),
             "o_orderdate": ("datetime", "timestamp_ntz"), "o_orderpriority": ("categorical", "string")}
    parts = []
    for c, (k, t) in kinds.items():
        v = f"CAST({c} AS DOUBLE)" if k == "numeric" else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS column_name, '{k}' AS kind, '{t}' AS data_type, min({v}) AS min, "
                     f"max({v}) AS max, count(DISTINCT {c}) AS unique_count, "
                     f"count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM orders")
    return (f"WITH per_col AS ({_union(parts)}), "
            "dup AS (SELECT (SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS d) "
            "SELECT per_col.*, CAST((SELECT d FROM dup) AS BIGINT) AS duplicate_rows, "
            "CAST(sum(null_count) OVER () AS BIGINT) AS missing_values FROM per_col")


@register("p9_extended_profile", _p9_sql())
def p9_extended_profile(spark, sf):
    return P.extended_profile(load(spark, sf, "orders"))
