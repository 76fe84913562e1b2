"""Registered assembly and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from constella.functions.numeric import round_sql as R
from constella.operators import assemble as X
from constella.operators import clean as C
from constella.plans.registry import register
from constella.tables import NUMERIC_FEATURES as FEATS
from constella.tables import features, labelled_points, labelled_rows, load, with_fixtures

PAL_SQL = "[" + ", ".join(f"'{c}'" for c in X.PALETTE) + "]"


def _points(spark, sf):
    """R1 inputs: coordinates, labels, anomalies (x beyond 2 population std)
    and the source rows (embeddings) as separate frames joined on row_id."""
    lp = labelled_points(spark, sf)
    coords = lp.select("row_id", "x", "y", "z")
    labels = lp.select("row_id", "cluster")
    anomalies = C.sigma_outliers(lp.select("row_id", "x"), "x", 2.0).where("is_outlier").select("row_id")
    source = load(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"),
                                                  (F.col("label") * 40).alias("weight"))
    return X.points(coords, labels, anomalies, source, size_column="weight")


_POINTS_SQL = (
    "WITH st AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM labelled_points), "
    "an AS (SELECT row_id FROM labelled_points, st WHERE abs(x - m) > 2 * s), "
    "pts AS (SELECT p.row_id AS point_id, p.x, p.y, p.z, p.cluster, an.row_id IS NOT NULL AS is_anomaly, "
    "e.label * 40 AS weight FROM labelled_points p LEFT JOIN an ON an.row_id = p.row_id "
    "LEFT JOIN embeddings e ON e.vec_id = p.row_id), "
    "dec AS (SELECT *, CASE WHEN is_anomaly THEN '#FF0000' WHEN cluster IS NULL OR cluster = -1 THEN '#808080' "
    f"ELSE {PAL_SQL}[((cluster % 15) + 15) % 15 + 1] END AS color, "
    "coalesce(least(greatest(TRY_CAST(CAST(weight AS VARCHAR) AS DOUBLE) / 100.0, 0.5), 2.0), 1.0) AS size "
    "FROM pts)")


@register("r1_points", with_fixtures(
    _POINTS_SQL + " SELECT point_id, x, y, z, cluster, is_anomaly, color, size, weight AS original_weight FROM dec",
    "labelled_points"))
def r1_points(spark, sf):
    p = _points(spark, sf)
    return p.select("point_id", "x", "y", "z", "cluster", "is_anomaly", "color", "size",
                    F.col("original").getField("weight").alias("original_weight"))


@register("r2_point_color", with_fixtures(_POINTS_SQL + " SELECT point_id, color FROM dec", "labelled_points"))
def r2_point_color(spark, sf):
    return _points(spark, sf).select("point_id", "color")


@register("r3_point_size", with_fixtures(_POINTS_SQL + " SELECT point_id, size FROM dec", "labelled_points"))
def r3_point_size(spark, sf):
    return _points(spark, sf).select("point_id", "size")


@register("r4_cluster_summary", with_fixtures(
    _POINTS_SQL + " SELECT cluster AS cluster_id, count(*) AS count, "
    f"{R('avg(x)')} AS center_x, {R('avg(y)')} AS center_y, {R('avg(z)')} AS center_z, "
    f"{PAL_SQL}[((cluster % 15) + 15) % 15 + 1] AS color, 'Cluster ' || CAST(cluster AS VARCHAR) AS label "
    "FROM dec WHERE cluster <> -1 GROUP BY cluster", "labelled_points"))
def r4_cluster_summary(spark, sf):
    return X.cluster_summary(_points(spark, sf))


@register("r5_run_metadata", with_fixtures(
    "SELECT count(*) AS total_points, 'pca' AS reduction_method, 'labels' AS clustering_method, "
    "'x,y,z' AS features_used, 'Selected 3 features' AS preprocessing_steps FROM labelled_points",
    "labelled_points"))
def r5_run_metadata(spark, sf):
    return X.run_metadata(_points(spark, sf), "pca", "labels", ["x", "y", "z"], ["Selected 3 features"])


@register("r6_run_analysis")
def r6_run_analysis(spark, sf):
    """Rows-only: the whole flow on lineitem features (mean impute, standard
    scale, PCA, k-means k=3, isolation forest 0.1)."""
    from constella.plans.flow import AnalysisConfig, run_analysis

    df = features(spark, sf).drop("l_returnflag")
    res = run_analysis(df, FEATS, AnalysisConfig())
    return res.points.select("row_id", "x", "y", "z", "cluster", "score", "is_anomaly", "color", "size")


@register("r6_run_analysis_umap_dbscan")
def r6_run_analysis_umap_dbscan(spark, sf):
    """Rows-only: the whole flow with UMAP and DBSCAN on the 3-D cloud of
    the embeddings table (median imputation, robust scaling)."""
    from constella.plans.flow import AnalysisConfig, run_analysis
    from constella.tables import points3d

    cfg = AnalysisConfig(reduction="umap", clustering="dbscan", missing="median", scaling="robust",
                         extra={"n_neighbors": 15, "iterations": 10, "eps": 0.5, "min_samples": 5})
    res = run_analysis(points3d(spark, sf), ["x", "y", "z"], cfg)
    return res.points.select("row_id", "x", "y", "z", "cluster", "score", "is_anomaly", "color")


# ---------------------------------------------------------------- X1-X7
def _x1_sql() -> str:
    num = " UNION ALL ".join(f"SELECT cluster, {i} AS pos, '{c}' AS feature, {c} AS v FROM src" for i, c in
                             enumerate(FEATS))
    f2 = lambda e: f"printf('%.2f', {R(e, 2)})"
    return with_fixtures(
        "WITH src AS (SELECT * FROM labelled_rows WHERE cluster <> -1), "
        f"num AS ({num}), st AS (SELECT cluster, pos, feature, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s "
        "FROM num WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY cluster, pos, feature HAVING count(*) > 1), "
        "txt AS (SELECT cluster, pos * 2 AS key, CASE WHEN s < m * 0.1 THEN 'Valeurs ' || feature || "
        f"' homogènes (moyenne: ' || {f2('m')} || ')' WHEN s > m * 0.5 THEN 'Valeurs ' || feature || "
        f"' variables (écart-type: ' || {f2('s')} || ')' END AS text FROM st UNION ALL "
        "SELECT cluster, pos * 2 + 1, CASE WHEN m > 0 THEN 'Tendance ' || feature || ' élevée' WHEN m < 0 THEN "
        "'Tendance ' || feature || ' faible' END FROM st UNION ALL "
        "SELECT cluster, 1000, 'Majorité l_linestatus: ' || v FROM (SELECT cluster, l_linestatus AS v, count(*) AS n, "
        "sum(count(*)) OVER (PARTITION BY cluster) AS tot, row_number() OVER (PARTITION BY cluster ORDER BY "
        "count(*) DESC, l_linestatus) AS r FROM src WHERE l_linestatus IS NOT NULL GROUP BY cluster, l_linestatus) "
        "WHERE r = 1 AND n > tot * 0.7), ranked AS (SELECT cluster, text, row_number() OVER (PARTITION BY cluster "
        "ORDER BY key) AS rank FROM txt WHERE text IS NOT NULL) SELECT CAST(cluster AS INTEGER) AS cluster, "
        "CAST(rank AS INTEGER) AS rank, text AS characteristic FROM ranked WHERE rank <= 5", "labelled_rows")


@register("x1_cluster_characteristics", _x1_sql())
def x1_cluster_characteristics(spark, sf):
    return X.cluster_characteristics(labelled_rows(spark, sf), FEATS, ["l_linestatus"])


def _x2_sql() -> str:
    long = " UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, {c} AS v FROM labelled_rows" for c in FEATS)
    return with_fixtures(
        f"WITH long AS ({long}), g AS (SELECT feature, avg(v) AS gm, stddev_pop(v) AS gs FROM long GROUP BY feature), "
        "p AS (SELECT cluster, feature, avg(v) AS cm FROM long WHERE cluster <> -1 GROUP BY cluster, feature), "
        "sc AS (SELECT p.cluster, p.feature, CASE WHEN gs > 0 THEN abs(cm - gm) / gs ELSE 0.0 END AS score "
        "FROM p JOIN g USING (feature)), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, "
        "feature) AS rank FROM sc) SELECT CAST(cluster AS INTEGER) AS cluster, CAST(rank AS INTEGER) AS rank, "
        f"feature, {R('score')} AS score FROM r WHERE rank <= 5", "labelled_rows")


@register("x2_key_features", _x2_sql())
def x2_key_features(spark, sf):
    return X.key_features(labelled_rows(spark, sf), FEATS)


@register("x3_representatives", with_fixtures(
    "SELECT CAST(cluster AS INTEGER) AS cluster, CAST(rank AS INTEGER) AS rank, row_id FROM (SELECT cluster, "
    "row_id, row_number() OVER (PARTITION BY cluster ORDER BY row_id) AS rank FROM labelled_rows "
    "WHERE cluster <> -1) WHERE rank <= 3", "labelled_rows"))
def x3_representatives(spark, sf):
    return X.representatives(labelled_rows(spark, sf), n=3)


@register("x4_cluster_context", with_fixtures(
    "WITH tot AS (SELECT count(*) AS total_points FROM labelled_rows), s AS (SELECT cluster, count(*) AS "
    "cluster_size FROM labelled_rows WHERE cluster <> -1 GROUP BY cluster), reps AS (SELECT cluster, "
    "string_agg(row_id, ',' ORDER BY row_id) AS sample_ids FROM (SELECT cluster, row_id, row_number() OVER "
    "(PARTITION BY cluster ORDER BY row_id) AS r FROM labelled_rows WHERE cluster <> -1) WHERE r <= 5 GROUP BY "
    "cluster) SELECT CAST(s.cluster AS INTEGER) AS cluster_id, s.cluster_size, tot.total_points, "
    f"{R('s.cluster_size / tot.total_points * 100', 1)} AS cluster_percentage, reps.sample_ids, "
    "'l_quantity,l_extendedprice,l_discount,l_tax' AS features_used, 'pca' AS reduction_method, "
    "'return flag' AS clustering_method FROM s, tot LEFT JOIN reps ON reps.cluster = s.cluster", "labelled_rows"))
def x4_cluster_context(spark, sf):
    return X.cluster_context(labelled_rows(spark, sf), FEATS, "pca", "return flag")


def _summary_sql() -> str:
    return ("SELECT cluster AS cluster_id, count(*) AS count FROM labelled_rows WHERE cluster <> -1 "
            "GROUP BY cluster")


@register("x5_cluster_text", with_fixtures(
    f"SELECT cluster_id, printf('{X.CLUSTER_TEXT['en']}', cluster_id, count) AS explanation FROM "
    f"({_summary_sql()})", "labelled_rows"))
def x5_cluster_text(spark, sf):
    summary = labelled_rows(spark, sf).where("cluster <> -1").groupBy(F.col("cluster").alias("cluster_id")) \
        .agg(F.count(F.lit(1)).alias("count"))
    return X.cluster_text(summary, "en")


@register("x5_cluster_text_fr", with_fixtures(
    "SELECT cluster_id, printf('" + X.CLUSTER_TEXT["fr"].replace("'", "''") + "', cluster_id, count) AS explanation "
    f"FROM ({_summary_sql()})", "labelled_rows"))
def x5_cluster_text_fr(spark, sf):
    summary = labelled_rows(spark, sf).where("cluster <> -1").groupBy(F.col("cluster").alias("cluster_id")) \
        .agg(F.count(F.lit(1)).alias("count"))
    return X.cluster_text(summary, "fr")


def _flagged(spark, sf):
    return C.sigma_outliers(labelled_rows(spark, sf), "l_extendedprice", 2.0).withColumnRenamed(
        "is_outlier", "is_anomaly")


_FLAG_SQL = ("flagged AS (SELECT *, coalesce(abs(l_extendedprice - m) > 2 * s, false) AS is_anomaly FROM "
             "labelled_rows, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM labelled_rows))")


@register("x6_anomaly_text", with_fixtures(
    f"WITH {_FLAG_SQL}, a AS (SELECT count(*) FILTER (WHERE is_anomaly) AS n, count(*) AS total FROM flagged) "
    f"SELECT CASE WHEN n = 0 THEN '{X.NO_ANOMALY_TEXT['en']}' ELSE printf('{X.ANOMALY_TEXT['en'].replace('%%', '%%')}', "
    f"n, CAST({R('n / total * 100', 1)} AS VARCHAR)) END AS text FROM a", "labelled_rows"))
def x6_anomaly_text(spark, sf):
    return X.anomaly_text(_flagged(spark, sf), "en")


@register("x7_dataset_summary", with_fixtures(
    f"WITH {_FLAG_SQL}, a AS (SELECT count(*) AS total, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) "
    "AS k, count(*) FILTER (WHERE is_anomaly) AS n_anom FROM flagged) SELECT printf('Analysis of %d data points "
    "revealing %d distinct groups', total, k) || CASE WHEN n_anom > 0 THEN printf(' and %d anomalies', n_anom) "
    "ELSE '' END || '. Processing completed in 0.0 seconds using PCA and RETURN FLAG.' AS summary FROM a",
    "labelled_rows"))
def x7_dataset_summary(spark, sf):
    # the processing time is a run property, not a data result: fixed at 0.0 here
    return X.dataset_summary(_flagged(spark, sf), "pca", "return flag", 0.0, "en")
