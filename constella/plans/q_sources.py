"""Registered source/sink queries (S1-S8). Files are written by Spark from
the given tables into the shared checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from constella.plans.registry import register
from constella.session import shared_dir, table_path
from constella.sources import io as S
from constella.tables import datasets, load, with_fixtures


@register("s1_read_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, "
                         "c_mktsegment FROM customer")
def s1_read_csv(spark, sf):
    path = shared_dir(spark, "csv-customer")
    load(spark, sf, "customer").write.option("header", True).csv(path)
    return S.read_csv(spark, path)


@register("s2_read_json", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def s2_read_json(spark, sf):
    path = shared_dir(spark, "json-orders")
    load(spark, sf, "orders").drop("o_orderdate").write.json(path)
    return S.read_json(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                           "o_orderpriority")


@register("s3_read_table", "SELECT * FROM nation")
def s3_read_table(spark, sf):
    return S.read_table(spark, table_path(sf, "nation"))


@register("s4_require_rows", "SELECT count(*) AS n_rows FROM lineitem")
def s4_require_rows(spark, sf):
    li = S.require_rows(load(spark, sf, "lineitem"), 10)
    return li.agg(F.count(F.lit(1)).alias("n_rows"))


@register("s5_file_intake")
def s5_file_intake(spark, sf):
    """Rows-only: intake verdicts for every file of the table folder (parquet
    is not an upload type, so each is rejected with the reason)."""
    return S.file_intake(spark, sf)


@register("s6_write_dataset", "SELECT 'lineitem upload' AS name, count(*) AS row_count, CAST(11 AS INTEGER) AS "
                              "column_count, 'uploaded' AS status, CAST(1 AS INTEGER) AS version FROM lineitem")
def s6_write_dataset(spark, sf):
    row = S.write_dataset(load(spark, sf, "lineitem"), "lineitem upload", tags=["tpch", " lines "])
    return row.select("name", "row_count", "column_count", "status", "version")


@register("s7_write_result",
          "SELECT 'points' AS table_name, count(*) AS rows, 'processed' AS status FROM embeddings UNION ALL "
          "SELECT 'clusters', count(DISTINCT label) FILTER (WHERE label <> 9), 'processed' FROM embeddings")
def s7_write_result(spark, sf):
    from constella.operators.assemble import cluster_summary
    from constella.tables import labelled_points

    pts = labelled_points(spark, sf)
    return S.write_result({"points": pts, "clusters": cluster_summary(pts)}, "r1")


@register("s8_create_version", with_fixtures(
    "SELECT name || ' v' || CAST(version + 1 AS VARCHAR) AS name, 'Version ' || CAST(version + 1 AS VARCHAR) || "
    "' of ' || name AS description, user_id, dataset_id AS parent_id, CAST(version + 1 AS INTEGER) AS version, "
    "is_public, tags, name || '_v' || CAST(version + 1 AS VARCHAR) AS filename FROM datasets", "datasets"))
def s8_create_version(spark, sf):
    return S.create_version(datasets(spark, sf))
