"""Registered clustering queries (K1, K3, K10-K13) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from constella.functions.numeric import round_sql as R
from constella.functions.numeric import round_to
from constella.operators import cluster as K
from constella.operators import metrics as M
from constella.plans.registry import register
from constella.tables import labelled_points, points3d, with_fixtures

XYZ = ["x", "y", "z"]


@register("k1_kmeans_assign", with_fixtures(
    "WITH c AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS cid, avg(x) AS cx, avg(y) AS cy, "
    "avg(z) AS cz FROM points3d GROUP BY label), d AS (SELECT p.row_id, c.cid, (p.x - c.cx) * (p.x - c.cx) + "
    "(p.y - c.cy) * (p.y - c.cy) + (p.z - c.cz) * (p.z - c.cz) AS d2 FROM points3d p, c) "
    f"SELECT row_id, CAST(arg_min(cid, d2) AS INTEGER) AS cluster, {R('min(d2)')} AS sq_distance FROM d "
    "GROUP BY row_id", "points3d"))
def k1_kmeans_assign(spark, sf):
    """Assignment and per-row inertia given centres (the per-label means)."""
    pts = points3d(spark, sf)
    _, centres = K.centres_from_labels(pts, XYZ, "label")
    model = K.CentresModel(XYZ, centres)
    return model.assign(pts, "cluster", "sq_distance").select(
        "row_id", "cluster", round_to("sq_distance").alias("sq_distance"))


@register("k1_kmeans")
def k1_kmeans(spark, sf):
    """Rows-only: Spark ML k-means (k = 5) on the 3-D cloud, ids by centre order."""
    pts = points3d(spark, sf)
    model = K.kmeans(pts, XYZ, k=5, n_init=2, seed=42)
    return model.assign(pts, "cluster").select("row_id", "cluster")


def _elbow_scores(spark, sf):
    """Inertia of the 3-D cloud grouped by label % k, for k = 2..10 (a
    deterministic score table derived from the data)."""
    pts = points3d(spark, sf)
    ex = pts.select(F.explode(F.sequence(F.lit(2), F.lit(10))).alias("k"), "label", *XYZ)
    g = ex.groupBy("k", (F.col("label") % F.col("k")).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in XYZ],
        F.sum(sum([F.col(c) * F.col(c) for c in XYZ])).alias("q"))
    within = F.col("q") - sum([F.col(f"s{c}") * F.col(f"s{c}") for c in XYZ]) / F.col("n")
    return g.groupBy("k").agg(F.sum(within).alias("inertia"))


@register("k3_elbow", with_fixtures(
    "WITH ks AS (SELECT range AS k FROM range(2, 11)), ex AS (SELECT ks.k, p.label % ks.k AS g, p.x, p.y, p.z "
    "FROM points3d p, ks), g AS (SELECT k, g, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, "
    "sum(x * x + y * y + z * z) AS q FROM ex GROUP BY k, g), sc AS (SELECT k, sum(q - (sx * sx + sy * sy + sz * sz) "
    "/ n) AS inertia FROM g GROUP BY k), d AS (SELECT k, lag(inertia) OVER (ORDER BY k) - 2 * inertia + "
    "lead(inertia) OVER (ORDER BY k) AS sd FROM sc) SELECT CAST(CASE WHEN (SELECT count(*) FROM sc) < 3 THEN "
    "(SELECT min(k) FROM sc) ELSE (SELECT k FROM d WHERE sd IS NOT NULL ORDER BY sd DESC, k ASC LIMIT 1) END "
    "AS INTEGER) AS best_k", "points3d"))
def k3_elbow(spark, sf):
    return K.elbow(_elbow_scores(spark, sf).withColumn("k", F.col("k").cast("int")))


@register("k10_cluster_sizes", with_fixtures(
    "WITH s AS (SELECT cluster, count(*) AS size FROM labelled_points GROUP BY cluster) SELECT "
    "count(*) FILTER (WHERE cluster <> -1) AS n_clusters, min(size) FILTER (WHERE cluster <> -1) AS min_size, "
    "max(size) FILTER (WHERE cluster <> -1) AS max_size, "
    f"{R('avg(size) FILTER (WHERE cluster <> -1)')} AS mean_size, "
    f"{R('stddev_pop(size) FILTER (WHERE cluster <> -1)')} AS std_size, "
    "CAST(coalesce(sum(size) FILTER (WHERE cluster = -1), 0) AS BIGINT) AS noise_count, "
    f"{R('coalesce(sum(size) FILTER (WHERE cluster = -1), 0) / sum(size)')} AS noise_ratio FROM s",
    "labelled_points"))
def k10_cluster_sizes(spark, sf):
    s = M.cluster_sizes(labelled_points(spark, sf))
    return s.select("n_clusters", "min_size", "max_size", round_to("mean_size").alias("mean_size"),
                    round_to("std_size").alias("std_size"), "noise_count", round_to("noise_ratio").alias("noise_ratio"))


_CLUSTER_CTE = (
    "pts AS (SELECT * FROM labelled_points WHERE cluster <> -1), "
    "cs AS (SELECT cluster, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, "
    "sum(x * x + y * y + z * z) AS q FROM pts GROUP BY cluster)")


@register("k11_silhouette_sq", with_fixtures(
    f"WITH {_CLUSTER_CTE}, t AS (SELECT p.row_id, p.cluster AS own, c.cluster, c.n, "
    "c.n * (p.x * p.x + p.y * p.y + p.z * p.z) - 2 * (p.x * c.sx + p.y * c.sy + p.z * c.sz) + c.q AS tot "
    "FROM pts p, cs c), r AS (SELECT row_id, max(CASE WHEN cluster = own THEN n END) AS own_n, "
    "max(CASE WHEN cluster = own THEN tot / greatest(n - 1, 1) END) AS a, "
    "min(CASE WHEN cluster <> own THEN tot / n END) AS b FROM t GROUP BY row_id) "
    f"SELECT {R('avg(CASE WHEN own_n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM r",
    "labelled_points"))
def k11_silhouette_sq(spark, sf):
    s = M.silhouette_sq(labelled_points(spark, sf), XYZ)
    return s.select(round_to("silhouette").alias("silhouette"))


@register("k12_calinski_harabasz", with_fixtures(
    f"WITH {_CLUSTER_CTE}, tot AS (SELECT sum(n) AS N, sum(sx) / sum(n) AS mx, sum(sy) / sum(n) AS my, "
    "sum(sz) / sum(n) AS mz, count(*) AS k FROM cs), bw AS (SELECT sum(c.n * ((c.sx / c.n - t.mx) * "
    "(c.sx / c.n - t.mx) + (c.sy / c.n - t.my) * (c.sy / c.n - t.my) + (c.sz / c.n - t.mz) * (c.sz / c.n - t.mz))) "
    "AS between_ss, sum(c.q - (c.sx * c.sx + c.sy * c.sy + c.sz * c.sz) / c.n) AS within_ss FROM cs c, tot t) "
    f"SELECT {R('(between_ss / (k - 1)) / (within_ss / (N - k))', 4)} AS calinski_harabasz FROM bw, tot",
    "labelled_points"))
def k12_calinski_harabasz(spark, sf):
    return M.calinski_harabasz(labelled_points(spark, sf), XYZ).select(
        round_to("calinski_harabasz", 4).alias("calinski_harabasz"))


@register("k13_davies_bouldin", with_fixtures(
    f"WITH {_CLUSTER_CTE}, mu AS (SELECT cluster, sx / n AS cx, sy / n AS cy, sz / n AS cz FROM cs), "
    "sp AS (SELECT p.cluster, avg(sqrt((p.x - m.cx) * (p.x - m.cx) + (p.y - m.cy) * (p.y - m.cy) + "
    "(p.z - m.cz) * (p.z - m.cz))) AS s FROM pts p JOIN mu m USING (cluster) GROUP BY p.cluster), "
    "pairs AS (SELECT a.cluster, max((sa.s + sb.s) / sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * "
    "(a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz))) AS worst FROM mu a JOIN mu b ON a.cluster <> b.cluster "
    "JOIN sp sa ON sa.cluster = a.cluster JOIN sp sb ON sb.cluster = b.cluster GROUP BY a.cluster) "
    f"SELECT {R('avg(worst)')} AS davies_bouldin FROM pairs", "labelled_points"))
def k13_davies_bouldin(spark, sf):
    return M.davies_bouldin(labelled_points(spark, sf), XYZ).select(
        round_to("davies_bouldin").alias("davies_bouldin"))

