"""Registered neighbour queries (N3, K4, K5, A4) on the 3-D cloud."""

from __future__ import annotations

from pyspark.sql import functions as F

from constella.functions.numeric import round_sql as R
from constella.functions.numeric import round_to
from constella.operators import anomaly as A
from constella.operators import neighbors as N
from constella.plans.registry import register
from constella.tables import points3d, with_fixtures

XYZ = ["x", "y", "z"]
# eps on the scale of the cloud (coordinate std ~0.125; the K5 base is ~0.08-0.11)
EPS, MIN_SAMPLES, K_LOF = 0.08, 5, 20

_PAIRS = ("pairs AS (SELECT a.row_id, b.row_id AS neighbor_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * "
          "(a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance FROM points3d a, points3d b "
          "WHERE a.row_id <> b.row_id)")


def _knn_sql(k: int) -> str:
    return (f"{_PAIRS}, knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, "
            f"neighbor_id) AS rank FROM pairs) WHERE rank <= {k})")


@register("n3_knn_join", with_fixtures(
    f"WITH {_knn_sql(5)} SELECT row_id, neighbor_id, CAST(rank AS INTEGER) AS rank, {R('distance')} AS distance "
    "FROM knn", "points3d"))
def n3_knn_join(spark, sf):
    nb = N.knn_join(points3d(spark, sf), XYZ, 5)
    return nb.select("row_id", "neighbor_id", "rank", round_to("distance").alias("distance"))


@register("k4_dbscan", with_fixtures(
    f"WITH RECURSIVE pr AS (SELECT a.row_id AS q, b.row_id AS p FROM points3d a, points3d b WHERE "
    f"sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= {EPS}), "
    f"core AS (SELECT q AS id FROM pr GROUP BY q HAVING count(*) >= {MIN_SAMPLES}), "
    "edges AS (SELECT q AS src, p AS dst FROM pr WHERE q <> p AND q IN (SELECT id FROM core) AND p IN (SELECT id "
    "FROM core)), cc(id, comp) AS (SELECT id, id FROM core UNION SELECT e.dst, cc.comp FROM cc JOIN edges e ON "
    "e.src = cc.id), comp AS (SELECT id, min(comp) AS comp FROM cc GROUP BY id), num AS (SELECT comp, "
    "CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT comp FROM comp)), "
    "core_lab AS (SELECT c.id, n.cluster FROM comp c JOIN num n USING (comp)), border AS (SELECT pr.q AS id, "
    "min(cl.cluster) AS cluster FROM pr JOIN core_lab cl ON cl.id = pr.p WHERE pr.q NOT IN (SELECT id FROM core) "
    "GROUP BY pr.q) SELECT p.row_id, CAST(coalesce(cl.cluster, b.cluster, -1) AS INTEGER) AS cluster, "
    "cl.id IS NOT NULL AS is_core FROM points3d p LEFT JOIN core_lab cl ON cl.id = p.row_id LEFT JOIN border b "
    "ON b.id = p.row_id", "points3d"))
def k4_dbscan(spark, sf):
    return N.dbscan(points3d(spark, sf), XYZ, EPS, MIN_SAMPLES)


@register("k5_eps_candidates", with_fixtures(
    f"WITH {_knn_sql(4)}, kd AS (SELECT row_id, max(distance) AS kd FROM knn GROUP BY row_id), "
    "q AS (SELECT kd AS base FROM kd ORDER BY kd LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.95) AS BIGINT) "
    "FROM points3d)), m AS (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5]) AS "
    f"factor) SELECT CAST(factor AS DOUBLE) AS factor, {R('base * factor')} AS eps FROM q, m", "points3d"))
def k5_eps_candidates(spark, sf):
    """K5's deterministic part: eps candidates from the k-distance (k = 5
    counting the point itself) at sorted position floor(0.95 n)."""
    base = N.eps_base(points3d(spark, sf), XYZ)
    rows = [(f, base * f) for f in (0.5, 0.75, 1.0, 1.25, 1.5)]
    return spark.createDataFrame(rows, "factor double, eps double").select("factor", round_to("eps").alias("eps"))


@register("k5_dbscan_auto")
def k5_dbscan_auto(spark, sf):
    """Rows-only: the (eps, min_samples) score table of the automatic DBSCAN
    search and which candidate won."""
    best, table = N.dbscan_auto(points3d(spark, sf), XYZ)
    if best is None:
        return table.withColumn("chosen", F.lit(False))
    return table.withColumn("chosen", (F.col("eps") == F.lit(float(best[1]))) & (F.col("min_samples") == best[2]))


@register("a4_lof", with_fixtures(
    f"WITH {_knn_sql(K_LOF)}, kd AS (SELECT row_id AS o, max(distance) AS kdist FROM knn GROUP BY row_id), "
    "reach AS (SELECT k.row_id AS p, greatest(k.distance, kd.kdist) AS reach FROM knn k JOIN kd ON kd.o = "
    "k.neighbor_id), lrd AS (SELECT p, 1.0 / (avg(reach) + 1e-10) AS lrd FROM reach GROUP BY p), "
    "lf AS (SELECT k.row_id, avg(l2.lrd) / max(l1.lrd) AS score FROM knn k JOIN lrd l2 ON l2.p = k.neighbor_id "
    "JOIN lrd l1 ON l1.p = k.row_id GROUP BY k.row_id), th AS (SELECT quantile_cont(score, 0.9) AS t FROM lf) "
    f"SELECT row_id, {R('score')} AS score, score > t AS is_anomaly FROM lf, th", "points3d"))
def a4_lof(spark, sf):
    scored = N.lof(points3d(spark, sf), XYZ, K_LOF)
    flagged, _ = A.threshold_flags(scored, 0.1)
    return flagged.select("row_id", round_to("score").alias("score"), "is_anomaly")



@register("n3_knn_wide")
def n3_knn_wide(spark, sf):
    """Five nearest neighbours on all 64 embedding columns by random-projection
    trees (recall is measured in tests/test_wide_neighbors.py)."""
    from constella.operators import wide_neighbors as W
    from constella.tables import WIDE, embedding_points

    nb = W.knn_forest(embedding_points(spark, sf), WIDE, 5)
    return nb.select("row_id", "neighbor_id", "rank", round_to("distance").alias("distance"))


@register("n3_recall_wide")
def n3_recall_wide(spark, sf):
    """Recall of n3_knn_wide for the ids divisible by 50, against all rows."""
    from constella.operators import wide_neighbors as W
    from constella.tables import WIDE, embedding_points

    pts = embedding_points(spark, sf)
    return W.recall(pts, WIDE, W.knn_forest(pts, WIDE, 5), 5)
