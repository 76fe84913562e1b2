"""Registered reduction queries (D1-D3, D8) and their DuckDB oracles.

The oracles for PCA use the closed-form eigen-decomposition of a 2 x 2
covariance (x, y of the 3-D cloud): same centring, same sign rule."""

from __future__ import annotations


from constella.functions.numeric import round_sql as R
from constella.functions.numeric import round_sig, round_to
from constella.functions.numeric import round_sig_sql as RS
from constella.operators import reduce as D
from constella.plans.registry import register
from constella.tables import NUMERIC_FEATURES as FEATS
from constella.tables import features, points3d, with_fixtures


def _cov_sql() -> str:
    parts = []
    for i, a in enumerate(FEATS):
        for j, b in enumerate(FEATS):
            parts.append(f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, '{a}' AS feature_i, "
                         f"'{b}' AS feature_j, {RS(f'covar_samp({a}, {b})')} AS covariance FROM clean")
    nn = " AND ".join(f"{c} IS NOT NULL" for c in FEATS)
    return with_fixtures(f"WITH clean AS (SELECT * FROM features WHERE {nn}) " + " UNION ALL ".join(parts),
                         "features")


@register("d1_pca_covariance", _cov_sql())
def d1_pca_covariance(spark, sf):
    _, cov, _ = D.covariance(features(spark, sf), FEATS)
    rows = [(i, j, a, b, float(cov[i, j])) for i, a in enumerate(FEATS) for j, b in enumerate(FEATS)]
    df = spark.createDataFrame(rows, "i int, j int, feature_i string, feature_j string, covariance double")
    return df.withColumn("covariance", round_sig("covariance"))


# Closed-form PCA of (x, y): eigenvalues l1 >= l2 of [[a, b], [b, c]], first
# axis (l1 - c, b) or (b, l1 - a), normalised, largest |loading| positive.
_EIG = (
    "st AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b, "
    "count(*) AS n FROM pts), "
    "ev AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1, "
    "(a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2 FROM st), "
    "raw AS (SELECT *, CASE WHEN b = 0 THEN (CASE WHEN a >= c THEN 1.0 ELSE 0.0 END) WHEN a >= c THEN l1 - c ELSE b END "
    "AS ux, CASE WHEN b = 0 THEN (CASE WHEN a >= c THEN 0.0 ELSE 1.0 END) WHEN a >= c THEN b ELSE l1 - a END AS uy "
    "FROM ev), "
    "nrm AS (SELECT *, ux / sqrt(ux * ux + uy * uy) AS vx, uy / sqrt(ux * ux + uy * uy) AS vy FROM raw), "
    "sg AS (SELECT *, CASE WHEN (CASE WHEN abs(vx) >= abs(vy) THEN vx ELSE vy END) < 0 THEN -1 ELSE 1 END AS s1, "
    "CASE WHEN (CASE WHEN abs(vy) >= abs(vx) THEN -vy ELSE vx END) < 0 THEN -1 ELSE 1 END AS s2 FROM nrm), "
    "ax AS (SELECT *, s1 * vx AS p1x, s1 * vy AS p1y, s2 * -vy AS p2x, s2 * vx AS p2y FROM sg)")


@register("d1_pca_2d", with_fixtures(
    f"WITH pts AS (SELECT row_id, x, y FROM points3d), {_EIG} SELECT row_id, "
    f"{R('(x - mx) * p1x + (y - my) * p1y')} AS x, {R('(x - mx) * p2x + (y - my) * p2y')} AS y, "
    "CAST(0.0 AS DOUBLE) AS z FROM pts, ax", "points3d"))
def d1_pca_2d(spark, sf):
    pts = points3d(spark, sf)
    coords, _ = D.pca(pts, ["x", "y"], n_components=2)
    return coords.select("row_id", round_to("x").alias("x"), round_to("y").alias("y"), "z")


@register("d1_pca_explained", with_fixtures(
    f"WITH pts AS (SELECT row_id, x, y FROM points3d), {_EIG} "
    f"SELECT CAST(1 AS INTEGER) AS component, {R('l1 / (a + c)')} AS explained_ratio, "
    f"{R('sqrt(l1 * (n - 1))')} AS singular_value FROM ax UNION ALL "
    f"SELECT CAST(2 AS INTEGER), {R('l2 / (a + c)')}, {R('sqrt(greatest(l2, 0) * (n - 1))')} FROM ax", "points3d"))
def d1_pca_explained(spark, sf):
    m = D.fit_pca(points3d(spark, sf), ["x", "y"], 2)
    rows = [(k + 1, float(m.explained_variance_ratio[k]), float(m.singular_values[k])) for k in range(2)]
    df = spark.createDataFrame(rows, "component int, explained_ratio double, singular_value double")
    return df.select("component", round_to("explained_ratio").alias("explained_ratio"),
                     round_to("singular_value").alias("singular_value"))


@register("d2_pca_importance", with_fixtures(
    f"WITH pts AS (SELECT row_id, x, y FROM points3d), {_EIG} "
    f"SELECT 'x' AS feature, {R('abs(p1x)')} AS importance FROM ax UNION ALL "
    f"SELECT 'y', {R('abs(p1y)')} FROM ax", "points3d"))
def d2_pca_importance(spark, sf):
    m = D.fit_pca(points3d(spark, sf), ["x", "y"], 1)
    df = spark.createDataFrame(list(m.feature_importance().items()), "feature string, importance double")
    return df.withColumn("importance", round_to("importance"))


@register("d3_pad3", with_fixtures(
    f"WITH pts AS (SELECT row_id, x, y FROM points3d), {_EIG} SELECT row_id, "
    f"{R('(x - mx) * p1x + (y - my) * p1y')} AS x, CAST(0.0 AS DOUBLE) AS y, CAST(0.0 AS DOUBLE) AS z "
    "FROM pts, ax", "points3d"))
def d3_pad3(spark, sf):
    coords, _ = D.pca(points3d(spark, sf), ["x", "y"], n_components=1)
    return coords.select("row_id", round_to("x").alias("x"), "y", "z")


@register("d8_embedding_variance", with_fixtures(
    f"SELECT {R('var_pop(x)')} AS var_x, {R('var_pop(y)')} AS var_y, {R('var_pop(z)')} AS var_z, "
    f"{R('var_pop(x) + var_pop(y) + var_pop(z)')} AS var_total FROM points3d", "points3d"))
def d8_embedding_variance(spark, sf):
    v = D.embedding_variance(points3d(spark, sf))
    return v.select(*[round_to(c).alias(c) for c in v.columns])


@register("d1_pca_lineitem")
def d1_pca_lineitem(spark, sf):
    """Rows-only: centred PCA of the four scaled lineitem features."""
    from constella.operators import clean as C

    df = C.impute_mean(features(spark, sf).drop("l_returnflag"), FEATS)
    df = C.fit_standard(df, FEATS).transform(df)
    coords, _ = D.pca(df, FEATS, 3)
    return coords



@register("d1_covariance_wide",
          "WITH v AS (SELECT embedding AS e FROM embeddings), p AS (SELECT i, j FROM range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j) "
          "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, "
          f"{R('covar_samp(CAST(e[i] AS DOUBLE), CAST(e[j] AS DOUBLE))')} AS covariance FROM v, p GROUP BY i, j")
def d1_covariance_wide(spark, sf):
    """Covariance of all 64 embedding coordinates, from block sums."""
    from constella.tables import WIDE, embedding_points

    _, cov, _ = D.covariance(embedding_points(spark, sf), WIDE)
    rows = [(i + 1, j + 1, float(cov[i, j])) for i in range(64) for j in range(i, 64)]
    df = spark.createDataFrame(rows, "i int, j int, covariance double")
    return df.withColumn("covariance", round_to("covariance"))
