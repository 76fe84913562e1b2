"""Registered anomaly queries (A1, A2, A7) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from constella.functions.numeric import round_sql as R
from constella.functions.numeric import round_to
from constella.operators import anomaly as A
from constella.operators import clean as C
from constella.plans.registry import register
from constella.tables import NUMERIC_FEATURES as FEATS
from constella.tables import features, load, points3d, with_fixtures


@register("a1_isolation_forest")
def a1_isolation_forest(spark, sf):
    """Rows-only: 100-tree isolation forest on the mean-imputed features,
    contamination 0.1 (pytest checks the flagged share and separation)."""
    df = C.impute_mean(features(spark, sf).drop("l_returnflag"), FEATS)
    flagged, _ = A.isolation_forest(df, FEATS, contamination=0.1, n_trees=100, seed=42)
    return flagged.select("row_id", "score", "is_anomaly")


def _a2_sql() -> str:
    q = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in FEATS)
    out = " OR ".join(f"coalesce({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}), "
                      "false)" for c in FEATS)
    return with_fixtures(
        f"WITH st AS (SELECT {q} FROM features), sh AS (SELECT avg(CASE WHEN {out} THEN 1.0 ELSE 0.0 END) AS s "
        f"FROM features, st) SELECT {R('s')} AS outlier_share, {R('least(greatest(s, 0.01), 0.3)')} "
        "AS contamination FROM sh", "features")


@register("a2_estimate_contamination", _a2_sql())
def a2_estimate_contamination(spark, sf):
    e = A.estimate_contamination(features(spark, sf), FEATS)
    return e.select(round_to("outlier_share").alias("outlier_share"), round_to("contamination").alias("contamination"))


_MAHA_XY = ("mst AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS a, covar_pop(x, y) AS b, "
            "covar_pop(y, y) AS c FROM points3d), mh AS (SELECT row_id, (c * (x - mx) * (x - mx) - 2 * b * (x - mx) * "
            "(y - my) + a * (y - my) * (y - my)) / (a * c - b * b) AS score FROM points3d, mst)")


@register("a5_mahalanobis", with_fixtures(
    f"WITH {_MAHA_XY} SELECT row_id, {R('score')} AS score FROM mh", "points3d"))
def a5_mahalanobis(spark, sf):
    """Squared Mahalanobis distance under the classical (maximum-likelihood)
    fit of (x, y): the distance the robust envelope applies."""
    pts = points3d(spark, sf)
    mean, cov, _ = A._moments(pts, ["x", "y"])
    return pts.select("row_id", round_to(A.mahalanobis_expr(["x", "y"], mean, cov)).alias("score"))


@register("a5_elliptic_envelope")
def a5_elliptic_envelope(spark, sf):
    """Rows-only: robust covariance (concentration steps) on the 3-D cloud."""
    flagged, _ = A.elliptic_envelope(points3d(spark, sf), ["x", "y", "z"], contamination=0.1)
    return flagged


def _ensemble_parts(spark, sf):
    from constella.operators import neighbors as N

    pts = points3d(spark, sf)
    lof, _ = A.threshold_flags(N.lof(pts, ["x", "y", "z"], 20), 0.1)
    r = pts.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    z, _ = A.threshold_flags(pts.select("row_id", (F.abs(F.col("x") - F.lit(r["m"])) / F.lit(r["s"])).alias("score")),
                             0.1)
    mean, cov, _ = A._moments(pts, ["x", "y"])
    mh, _ = A.threshold_flags(pts.select("row_id", A.mahalanobis_expr(["x", "y"], mean, cov).alias("score")), 0.1)
    return {"lof": lof, "zscore": z, "mahalanobis": mh}


def _a6_sql() -> str:
    from constella.plans.q_neighbors import _knn_sql

    return with_fixtures(
        f"WITH {_knn_sql(20)}, kd AS (SELECT row_id AS o, max(distance) AS kdist FROM knn GROUP BY row_id), "
        "reach AS (SELECT k.row_id AS p, greatest(k.distance, kd.kdist) AS reach FROM knn k JOIN kd ON kd.o = "
        "k.neighbor_id), lrd AS (SELECT p, 1.0 / (avg(reach) + 1e-10) AS lrd FROM reach GROUP BY p), "
        "lf AS (SELECT k.row_id, avg(l2.lrd) / max(l1.lrd) AS score FROM knn k JOIN lrd l2 ON l2.p = k.neighbor_id "
        "JOIN lrd l1 ON l1.p = k.row_id GROUP BY k.row_id), "
        "zs AS (SELECT row_id, abs(x - (SELECT avg(x) FROM points3d)) / (SELECT stddev_pop(x) FROM points3d) AS score "
        f"FROM points3d), {_MAHA_XY}, "
        "u AS (SELECT 'lof' AS det, * FROM lf UNION ALL SELECT 'zscore', * FROM zs UNION ALL SELECT 'mahalanobis', * "
        "FROM mh), fl AS (SELECT u.*, u.score > quantile_cont(u.score, 0.9) OVER (PARTITION BY det) AS flag, "
        "min(u.score) OVER (PARTITION BY det) AS lo, max(u.score) OVER (PARTITION BY det) AS hi FROM u), "
        "per AS (SELECT row_id, sum((score - lo) / (hi - lo + 1e-8) * (1.0 / 3)) AS ens, sum(CAST(flag AS INTEGER)) "
        "AS votes FROM fl GROUP BY row_id), th AS (SELECT quantile_cont(ens, 0.9) AS t FROM per) "
        f"SELECT row_id, {R('ens')} AS ensemble_score, CAST(votes AS INTEGER) AS votes, votes >= 1.5 OR ens >= t "
        f"AS is_anomaly, {R('votes / 3.0')} AS agreement FROM per, th", "points3d")


@register("a6_ensemble", _a6_sql())
def a6_ensemble(spark, sf):
    """LOF, |z| of x and Mahalanobis of (x, y), each flagged at its 90th
    percentile, combined with equal weights."""
    e = A.ensemble(_ensemble_parts(spark, sf))
    return e.select("row_id", round_to("ensemble_score").alias("ensemble_score"), "votes", "is_anomaly",
                    round_to("agreement").alias("agreement"))


@register("a7_score_summary",
          "WITH st AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders), "
          "sc AS (SELECT abs((o_totalprice - m) / s) AS score FROM orders, st), "
          "th AS (SELECT quantile_cont(score, 0.9) AS t FROM sc), fl AS (SELECT score, score > t AS a, t FROM sc, th) "
          f"SELECT count(*) FILTER (WHERE a) AS n_anomalies, {R('count(*) FILTER (WHERE a) / count(*)')} "
          f"AS anomaly_ratio, {R('avg(score) FILTER (WHERE a)')} AS mean_score_anomalous, "
          f"{R('avg(score) FILTER (WHERE NOT a)')} AS mean_score_normal, {R('min(score)')} AS min_score, "
          f"{R('max(score)')} AS max_score, {R('max(t)')} AS threshold FROM fl")
def a7_score_summary(spark, sf):
    """Summary of a z-score detector on order totals flagged at its 90th
    percentile (a deterministic score table)."""
    o = load(spark, sf, "orders")
    r = o.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s")).first()
    scored = o.select(F.abs((F.col("o_totalprice") - F.lit(r["m"])) / F.lit(r["s"])).alias("score"))
    flagged, thr = A.threshold_flags(scored, 0.1)
    s = A.score_summary(flagged, threshold=thr)
    return s.select("n_anomalies", *[round_to(c).alias(c) for c in s.columns if c != "n_anomalies"])
