"""Loading the given tables and the fixtures Spark derives from them.

Every derived fixture has a DataFrame builder and an SQL twin (``*_SQL``) so a
DuckDB oracle can rebuild exactly the same rows from the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.session import prepare, table_path

NUMERIC_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(table_path(sf_dir, name))


# ---------------------------------------------------------------- lineitem ids
# Whole lineitem rows are distinct while (orderkey, linenumber) is not, so the
# row id is an md5 over every column (doubles fixed to 4 decimals, timestamps
# as ISO text). 128 bits: no collisions at 10^12 rows.
def lineitem_row_id() -> F.Column:
    parts = [F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
             F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")]
    parts += [F.col(c).cast("decimal(18,4)").cast("string") for c in NUMERIC_FEATURES]
    parts += [F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_shipdate").cast("string")]
    return F.md5(F.concat_ws("|", *parts))


LINEITEM_ROW_ID_SQL = (
    "md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), "
    "CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
    "CAST(CAST(l_quantity AS DECIMAL(18,4)) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS VARCHAR), "
    "CAST(CAST(l_discount AS DECIMAL(18,4)) AS VARCHAR), CAST(CAST(l_tax AS DECIMAL(18,4)) AS VARCHAR), "
    "l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR)))"
)


def lineitem_rows(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "lineitem").withColumn("row_id", lineitem_row_id())


# ------------------------------------------------------------- feature fixture
# Nulls by rule (FIXTURES.md "derived edge fixtures"): quantity is missing on
# every order key divisible by 7, discount on line number 3.
def features(spark, sf_dir, with_nulls: bool = True, extra: tuple = ()) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    d = F.col("l_discount")
    if with_nulls:
        q = F.when(F.col("l_orderkey") % 7 == 0, F.lit(None).cast("double")).otherwise(q)
        d = F.when(F.col("l_linenumber") == 3, F.lit(None).cast("double")).otherwise(d)
    return li.select(lineitem_row_id().alias("row_id"), q.alias("l_quantity"),
                     F.col("l_extendedprice"), d.alias("l_discount"), F.col("l_tax"),
                     F.col("l_returnflag"), *extra)


def features_sql(with_nulls: bool = True, extra: tuple = ()) -> str:
    q = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END" if with_nulls else "l_quantity"
    d = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END" if with_nulls else "l_discount"
    more = "".join(f", {c}" for c in extra)
    return (f"SELECT {LINEITEM_ROW_ID_SQL} AS row_id, {q} AS l_quantity, l_extendedprice, "
            f"{d} AS l_discount, l_tax, l_returnflag{more} FROM lineitem")


# ----------------------------------------------------------- 3-D point cloud
# The first three embedding coordinates form a continuous 3-D cloud with a
# ten-class label: the input of the neighbour, density and geometry operators.
def points3d(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"),
                    F.element_at("embedding", 1).cast("double").alias("x"),
                    F.element_at("embedding", 2).cast("double").alias("y"),
                    F.element_at("embedding", 3).cast("double").alias("z"),
                    F.col("label"))


POINTS3D_SQL = ("SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, "
                "CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings")


#: every embedding coordinate as a column
WIDE = [f"e{i}" for i in range(1, 65)]


def embedding_points(spark, sf_dir) -> DataFrame:
    """All 64 coordinates of every embedding."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), *[F.element_at("embedding", i + 1).cast("double").alias(c)
                                                       for i, c in enumerate(WIDE)], "label")


# ------------------------------------------------------------ catalogue tables
# The test data has no catalogue; users, datasets, sessions and visualisations
# are derived from customer, orders, events and lineitem by fixed rules.
def users(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.org")).alias("email"),
        F.concat(F.lit("First"), (F.col("c_custkey") % 97).cast("string")).alias("first_name"),
        F.when(F.col("c_nationkey") % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Last"), F.col("c_nationkey").cast("string"))).alias("last_name"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_admin"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation_key"))


USERS_SQL = (
    "SELECT c_custkey AS user_id, lower(replace(c_name, '#', '.')) || '@example.org' AS email, "
    "'First' || CAST(c_custkey % 97 AS VARCHAR) AS first_name, "
    "CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 'Last' || CAST(c_nationkey AS VARCHAR) END AS last_name, "
    "c_acctbal > 0 AS is_active, c_mktsegment = 'BUILDING' AS is_admin, c_mktsegment AS segment, "
    "c_nationkey AS nation_key FROM customer")


def datasets(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "processed")
              .when(F.col("o_orderstatus") == "O", "uploaded").otherwise("error"))
    return o.select(
        F.col("o_orderkey").alias("dataset_id"),
        F.concat(F.lit("dataset "), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_public"),
        F.concat_ws(",", F.substring("o_orderpriority", 3, 20), F.col("o_orderstatus")).alias("tags"),
        (F.col("o_totalprice") * 10).cast("bigint").alias("size_bytes"),
        (F.col("o_totalprice") / 100).cast("bigint").alias("row_count"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("o_orderkey") - 1).alias("parent_id"),
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("version"))


DATASETS_SQL = (
    "SELECT o_orderkey AS dataset_id, 'dataset ' || CAST(o_orderkey AS VARCHAR) AS name, o_custkey AS user_id, "
    "CASE WHEN o_orderstatus = 'F' THEN 'processed' WHEN o_orderstatus = 'O' THEN 'uploaded' ELSE 'error' END AS status, "
    "o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_public, "
    "concat_ws(',', substring(o_orderpriority, 3, 20), o_orderstatus) AS tags, "
    "CAST(trunc(o_totalprice * 10) AS BIGINT) AS size_bytes, CAST(trunc(o_totalprice / 100) AS BIGINT) AS row_count, "
    "o_orderdate AS created_at, "
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey - 1 END AS parent_id, "
    "CAST(o_orderkey % 4 + 1 AS INTEGER) AS version FROM orders")


def sessions(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("session_id"),
        F.col("user_id"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 16).cast("string"), F.lit("."),
                 (F.col("event_id") % 3).cast("string")).alias("ip_address"),
        F.when(F.col("event_type") == "click", "Firefox").when(F.col("event_type") == "view", "Chrome")
         .otherwise("Safari").alias("user_agent"),
        F.when(F.col("event_type").isin("signup", "purchase"),
               F.concat(F.lit("fp"), (F.col("user_id") % 40).cast("string"))).alias("device_fingerprint"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("INTERVAL 1 HOURS") * F.col("value").cast("int")).alias("last_used_at"),
        (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
        (F.col("event_type") != "error").alias("is_active"))


SESSIONS_SQL = (
    "SELECT event_id AS session_id, user_id, "
    "'10.0.' || CAST(user_id % 16 AS VARCHAR) || '.' || CAST(event_id % 3 AS VARCHAR) AS ip_address, "
    "CASE WHEN event_type = 'click' THEN 'Firefox' WHEN event_type = 'view' THEN 'Chrome' ELSE 'Safari' END AS user_agent, "
    "CASE WHEN event_type IN ('signup', 'purchase') THEN 'fp' || CAST(user_id % 40 AS VARCHAR) END AS device_fingerprint, "
    "ts AS created_at, ts + INTERVAL 1 HOUR * CAST(trunc(value) AS INTEGER) AS last_used_at, "
    "ts + INTERVAL 7 DAY AS expires_at, event_type <> 'error' AS is_active FROM events")


def visualizations(spark, sf_dir) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return (li.where(F.col("l_linenumber") == 1)
            .select(F.col("l_orderkey").alias("dataset_id"),
                    F.col("l_partkey").alias("viz_id"),
                    F.col("l_suppkey").alias("owner_id"),
                    F.col("l_shipdate").alias("created_at"),
                    F.col("l_quantity").cast("bigint").alias("view_count")))


VISUALIZATIONS_SQL = (
    "SELECT l_orderkey AS dataset_id, l_partkey AS viz_id, l_suppkey AS owner_id, l_shipdate AS created_at, "
    "CAST(l_quantity AS BIGINT) AS view_count FROM lineitem WHERE l_linenumber = 1")


# ------------------------------------------------------ labelled point fixtures
# Deterministic cluster labels for the metric / assembly / explanation
# operators: the ten embedding labels with label 9 as noise (-1), and the
# lineitem return flag as a three-way clustering.
def labelled_points(spark, sf_dir) -> DataFrame:
    return points3d(spark, sf_dir).withColumn(
        "cluster", F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).cast("int"))


LABELLED_POINTS_SQL = (f"SELECT *, CAST(CASE WHEN label = 9 THEN -1 ELSE label END AS INTEGER) AS cluster "
                       f"FROM ({POINTS3D_SQL})")


def labelled_rows(spark, sf_dir) -> DataFrame:
    return features(spark, sf_dir, extra=("l_linestatus",)).withColumn(
        "cluster", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
        .otherwise(2).cast("int"))


LABELLED_ROWS_SQL = (
    "SELECT *, CAST(CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 "
    f"ELSE 2 END AS INTEGER) AS cluster FROM ({features_sql(True, extra=('l_linestatus',))})")


FIXTURE_SQL = {
    "labelled_points": LABELLED_POINTS_SQL,
    "labelled_rows": LABELLED_ROWS_SQL,
    "features": features_sql(True),
    "points3d": POINTS3D_SQL,
    "users": USERS_SQL,
    "datasets": DATASETS_SQL,
    "sessions": SESSIONS_SQL,
    "visualizations": VISUALIZATIONS_SQL,
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle query with the fixture CTEs it uses (merging a WITH)."""
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in names)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
