"""Registered queries for auto-k, mixtures, hierarchy and tuning (K2, K6-K9,
O1-O8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from constella.functions.numeric import round_sql as R
from constella.functions.numeric import round_to
from constella.operators import density as DN
from constella.operators import hierarchy as H
from constella.operators import mixture as MX
from constella.operators import tune as O
from constella.plans.registry import register
from constella.tables import NUMERIC_FEATURES as FEATS
from constella.tables import WIDE, embedding_points, features, load, points3d, with_fixtures

XYZ = ["x", "y", "z"]


@register("k2_auto_k")
def k2_auto_k(spark, sf):
    """Rows-only: the k-means score table (inertia, squared-distance
    silhouette) for k = 2..6 and the chosen k."""
    best, scores = O.auto_k(points3d(spark, sf), XYZ, 2, 6)
    return scores.withColumn("chosen", F.col("k") == F.lit(best))


@register("k6_core_distance", with_fixtures(
    "WITH pairs AS (SELECT a.row_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * "
    "(a.z - b.z)) AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - "
    "b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), b.row_id) AS r FROM points3d a, points3d b WHERE a.row_id <> "
    f"b.row_id) SELECT row_id, {R('max(d)')} AS core_distance FROM pairs WHERE r <= 4 GROUP BY row_id", "points3d"))
def k6_core_distance(spark, sf):
    c = H.core_distances(points3d(spark, sf), XYZ, min_samples=5)
    return c.select("row_id", round_to("core_distance").alias("core_distance"))


@register("k6_mutual_reachability", with_fixtures(
    "WITH pairs AS (SELECT a.row_id AS a, b.row_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + "
    "(a.z - b.z) * (a.z - b.z)) AS d FROM points3d a, points3d b WHERE a.row_id <> b.row_id), rk AS (SELECT *, "
    "row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM pairs), core AS (SELECT a, max(d) AS c FROM rk "
    "WHERE r <= 4 GROUP BY a) SELECT rk.a, rk.b, "
    f"{R('greatest(ca.c, cb.c, rk.d)')} AS mutual_reachability FROM rk JOIN core ca ON ca.a = rk.a JOIN core cb "
    "ON cb.a = rk.b WHERE rk.r <= 5", "points3d"))
def k6_mutual_reachability(spark, sf):
    m = H.mutual_reachability(points3d(spark, sf), XYZ, k=5, min_samples=5)
    return m.select("a", "b", round_to("mutual_reachability").alias("mutual_reachability"))


@register("k6_spanning_tree", with_fixtures(
    "WITH RECURSIVE dist AS (SELECT a.row_id AS i, b.row_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + "
    "(a.z - b.z) * (a.z - b.z)) AS d FROM points3d a JOIN points3d b ON a.row_id <> b.row_id), "
    "core AS (SELECT i, max(d) AS c FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM dist) WHERE r <= 4 GROUP BY i), "
    "w AS (SELECT dist.i, dist.j, greatest(d, a.c, b.c) AS w FROM dist JOIN core a ON a.i = dist.i JOIN core b ON b.i = dist.j), "
    "prim AS (SELECT 1 AS step, j AS node, w AS best FROM w WHERE i = (SELECT min(row_id) FROM points3d) UNION ALL "
    "SELECT p.step + 1, p.node, least(p.best, w.w) FROM (SELECT *, first_value(node) OVER (ORDER BY best, node) AS pick FROM prim) p "
    "JOIN w ON w.i = p.pick AND w.j = p.node WHERE p.node <> p.pick), "
    "tree AS (SELECT step, min(best) AS weight FROM prim GROUP BY step) "
    f"SELECT row_number() OVER (ORDER BY weight) AS position, {R('weight')} AS weight FROM tree", "points3d"))
def k6_spanning_tree(spark, sf):
    """Weights of the exact spanning tree of mutual reachability, ascending."""
    from constella.functions.ordering import global_row_number

    pts = points3d(spark, sf)
    core = H.core_distances(pts, XYZ, min_samples=5)
    vertices = pts.join(core, "row_id").select(F.col("row_id").alias("id"), *XYZ, F.col("core_distance").alias("core"))
    tree = DN.spanning_tree(vertices, XYZ)
    return global_row_number(tree, ["weight", "a", "b"], "position").select("position", round_to("weight").alias("weight"))


@register("k6_hdbscan")
def k6_hdbscan(spark, sf):
    """Labels, probabilities and persistence on the three leading axes of all
    embedding coordinates (equal to a plain version in tests/test_density.py)."""
    from constella.operators import reduce as D

    coords, _ = D.pca(embedding_points(spark, sf), WIDE, 3)
    out = DN.hdbscan(coords, XYZ, min_cluster_size=15, min_samples=5)
    return out.labels.join(out.clusters.select("cluster", "size", "persistence"), "cluster", "left").select(
        "row_id", "cluster", round_to("probability").alias("probability"), "size", round_to("persistence").alias("persistence"))


@register("k7_single_linkage", with_fixtures(
    "WITH RECURSIVE e AS (SELECT a.row_id AS src, b.row_id AS dst FROM points3d a, points3d b WHERE a.row_id <> "
    "b.row_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.05), "
    "cc(id, comp) AS (SELECT row_id, row_id FROM points3d UNION SELECT e.dst, cc.comp FROM cc JOIN e ON e.src = "
    "cc.id), comp AS (SELECT id, min(comp) AS comp FROM cc GROUP BY id) SELECT id AS row_id, CAST(dense_rank() "
    "OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM comp", "points3d"))
def k7_single_linkage(spark, sf):
    """Single linkage cut at distance 0.05 (the threshold variant; the
    cloud's coordinate std is ~0.125)."""
    return H.single_linkage_threshold(points3d(spark, sf), XYZ, 0.05)


@register("k7_agglomerative")
def k7_agglomerative(spark, sf):
    """Rows-only: Ward linkage into 5 clusters over grid micro-clusters."""
    return H.agglomerative(points3d(spark, sf), XYZ, k=5, linkage="ward")


@register("k8_gaussian_mixture")
def k8_gaussian_mixture(spark, sf):
    """Rows-only: diagonal EM with 4 components; per-row cluster and
    membership probability."""
    pts = points3d(spark, sf)
    mix = MX.gaussian_mixture(pts, XYZ, k=4, covariance="diag", max_iter=50)
    return mix.e_step(pts).select("row_id", "cluster", "max_prob")


def _estep_sql() -> str:
    comps = ("c AS (SELECT label, count(*) / (SELECT count(*) FROM points3d) AS w, avg(x) AS mx, avg(y) AS my, "
             "avg(z) AS mz, var_pop(x) AS vx, var_pop(y) AS vy, var_pop(z) AS vz FROM points3d GROUP BY label)")
    ld = ("ln(c.w) - 0.5 * (3 * ln(2 * pi()) + ln(c.vx) + ln(c.vy) + ln(c.vz)) - 0.5 * ((p.x - c.mx) * (p.x - c.mx) / "
          "c.vx + (p.y - c.my) * (p.y - c.my) / c.vy + (p.z - c.mz) * (p.z - c.mz) / c.vz)")
    return (f"{comps}, l AS (SELECT p.row_id, c.label, {ld} AS ld FROM points3d p, c), "
            "m AS (SELECT row_id, max(ld) AS mx FROM l GROUP BY row_id), "
            "s AS (SELECT l.row_id, m.mx + ln(sum(exp(l.ld - m.mx))) AS ll FROM l JOIN m USING (row_id) GROUP BY "
            "l.row_id, m.mx), pr AS (SELECT l.row_id, l.label, exp(l.ld - s.ll) AS p, s.ll FROM l JOIN s USING "
            "(row_id)), best AS (SELECT row_id, CAST(arg_max(label, p) AS INTEGER) AS cluster, max(p) AS max_prob, "
            "max(ll) AS ll FROM pr GROUP BY row_id)")


@register("k9_mixture_estep", with_fixtures(
    f"WITH {_estep_sql()} SELECT row_id, cluster, {R('max_prob')} AS max_prob, {R('ll')} AS log_likelihood "
    "FROM best", "points3d"))
def k9_mixture_estep(spark, sf):
    """One E-step with the label groups as components (weights, means and
    population variances per label)."""
    pts = points3d(spark, sf)
    mix = MX.from_labels(pts, XYZ, "label")
    e = mix.e_step(pts)
    return e.select("row_id", "cluster", round_to("max_prob").alias("max_prob"),
                    round_to("log_likelihood").alias("log_likelihood"))


@register("k9_mixture_criteria", with_fixtures(
    f"WITH {_estep_sql()} SELECT {R('sum(ll)', 4)} AS log_likelihood, "
    f"{R('2.0 * (9 + 10 * 3 + 10 * 3) - 2 * sum(ll)', 4)} AS aic, "
    f"{R('(9 + 10 * 3 + 10 * 3) * ln(count(*)) - 2 * sum(ll)', 4)} AS bic, {R('avg(max_prob)')} AS mean_max_prob, "
    f"{R('min(max_prob)')} AS min_max_prob FROM best", "points3d"))
def k9_mixture_criteria(spark, sf):
    pts = points3d(spark, sf)
    c = MX.criteria(pts, MX.from_labels(pts, XYZ, "label"))
    return c.select(round_to("log_likelihood", 4).alias("log_likelihood"), round_to("aic", 4).alias("aic"),
                    round_to("bic", 4).alias("bic"), round_to("mean_max_prob").alias("mean_max_prob"),
                    round_to("min_max_prob").alias("min_max_prob"))


@register("k8_gaussian_mixture_full")
def k8_gaussian_mixture_full(spark, sf):
    """EM with full covariances, 4 components (compared with a plain version in
    tests/test_moments.py)."""
    pts = points3d(spark, sf)
    mix = MX.gaussian_mixture(pts, XYZ, k=4, covariance="full", max_iter=50)
    return mix.e_step(pts).select("row_id", "cluster", "max_prob")


@register("k9_full_criteria", with_fixtures(
    "WITH c AS (SELECT label, count(*) / (SELECT count(*) FROM points3d) AS w, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, "
    "covar_pop(x, y) AS b, var_pop(y) AS c FROM points3d GROUP BY label), "
    "l AS (SELECT p.row_id, ln(c.w) - ln(2 * pi()) - 0.5 * ln(c.a * c.c - c.b * c.b) - 0.5 * (c.c * (p.x - c.mx) * (p.x - c.mx) - "
    "2 * c.b * (p.x - c.mx) * (p.y - c.my) + c.a * (p.y - c.my) * (p.y - c.my)) / (c.a * c.c - c.b * c.b) AS ld FROM points3d p, c), "
    "m AS (SELECT row_id, max(ld) AS mx FROM l GROUP BY row_id), "
    "r AS (SELECT l.row_id, max(m.mx) + ln(sum(exp(l.ld - m.mx))) AS ll, 1 / sum(exp(l.ld - m.mx)) AS p FROM l JOIN m USING (row_id) "
    "GROUP BY l.row_id) "
    f"SELECT {R('sum(ll)', 4)} AS log_likelihood, {R('2.0 * (9 + 10 * 2 + 10 * 3) - 2 * sum(ll)', 4)} AS aic, "
    f"{R('(9 + 10 * 2 + 10 * 3) * ln(count(*)) - 2 * sum(ll)', 4)} AS bic, {R('avg(p)')} AS mean_max_prob, "
    f"{R('min(p)')} AS min_max_prob FROM r", "points3d"))
def k9_full_criteria(spark, sf):
    """Criteria of the full-covariance mixture of the label groups on x and y."""
    pts = points3d(spark, sf)
    c = MX.criteria(pts, MX.from_labels(pts, ["x", "y"], "label", "full"))
    return c.select(round_to("log_likelihood", 4).alias("log_likelihood"), round_to("aic", 4).alias("aic"),
                    round_to("bic", 4).alias("bic"), round_to("mean_max_prob").alias("mean_max_prob"),
                    round_to("min_max_prob").alias("min_max_prob"))


# ------------------------------------------------------------------ O1-O8
def _kmeans_grid(spark, sf):
    n = points3d(spark, sf).count()
    space = O.adjust_space(O.DEFAULT_SPACES["kmeans"], "kmeans", n)
    return [(g["n_clusters"], g["init"], g["algorithm"]) for g in O.param_grid(space)]


_GRID_SQL = ("WITH n AS (SELECT count(*) AS n FROM embeddings), g AS (SELECT CAST(k AS INTEGER) AS n_clusters, "
             "i AS init, a AS algorithm FROM range(2, 11) t(k), unnest(['k-means++', 'random']) u(i), "
             "unnest(['lloyd', 'elkan']) v(a), n WHERE k <= least(n.n - 1, 10))")


@register("o1_param_grid", _GRID_SQL + " SELECT * FROM g")
def o1_param_grid(spark, sf):
    return spark.createDataFrame(_kmeans_grid(spark, sf), "n_clusters int, init string, algorithm string")


@register("o2_param_sample", _GRID_SQL + " SELECT * FROM g ORDER BY md5('42:' || CAST(n_clusters AS VARCHAR) || '|' || "
                                         "init || '|' || algorithm), CAST(n_clusters AS VARCHAR) || '|' || init || "
                                         "'|' || algorithm LIMIT 8")
def o2_param_sample(spark, sf):
    grid = [{"n_clusters": k, "init": i, "algorithm": a} for k, i, a in _kmeans_grid(spark, sf)]
    picked = O.param_sample(grid, 8, 42)
    return spark.createDataFrame([(p["n_clusters"], p["init"], p["algorithm"]) for p in picked],
                                 "n_clusters int, init string, algorithm string")


@register("o3_adjust_space",
          "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT 'dbscan' AS algorithm, 'min_samples' AS param, "
          "CAST(v AS DOUBLE) AS value FROM unnest([3, 5, 7, 10, 15]) t(v), n WHERE v <= greatest(2, n.n // 10) "
          "UNION ALL SELECT 'tsne', 'perplexity', CAST(v AS DOUBLE) FROM unnest([5, 10, 15, 30, 50]) t(v), n "
          "WHERE v < (n.n - 1) // 3 UNION ALL SELECT 'umap', 'n_neighbors', CAST(v AS DOUBLE) FROM "
          "unnest([5, 10, 15, 20, 30, 50]) t(v), n WHERE v < n.n - 1")
def o3_adjust_space(spark, sf):
    n = load(spark, sf, "embeddings").count()
    rows = []
    for algo, param in (("dbscan", "min_samples"), ("tsne", "perplexity"), ("umap", "n_neighbors")):
        adj = O.adjust_space(O.DEFAULT_SPACES[algo], algo, n)
        rows += [(algo, param, float(v)) for v in adj[param]]
    return spark.createDataFrame(rows, "algorithm string, param string, value double")


@register("o4_tune_clustering")
def o4_tune_clustering(spark, sf):
    """Rows-only: k-means candidates (k, init) on the 3-D cloud scored by
    Calinski-Harabasz."""
    space = {"n_clusters": [2, 3, 4, 5, 6], "init": ["k-means++", "random"], "algorithm": ["lloyd"]}
    return O.tune_clustering(points3d(spark, sf), XYZ, "kmeans", "calinski_harabasz", space)


@register("o5_tune_reduction")
def o5_tune_reduction(spark, sf):
    from constella.operators import clean as C

    df = C.impute_mean(features(spark, sf), FEATS)
    return O.tune_reduction(C.scale(df, FEATS, "standard"), FEATS)


@register("o6_auto_select")
def o6_auto_select(spark, sf):
    """Rows-only: best algorithm over k-means and DBSCAN candidates by
    silhouette, with the selection confidence."""
    pts = points3d(spark, sf)
    km = O.tune_clustering(pts, XYZ, "kmeans", "silhouette",
                           {"n_clusters": [3, 5], "init": ["k-means++"], "algorithm": ["lloyd"]})
    db = O.tune_clustering(pts, XYZ, "dbscan", "silhouette",
                           {"eps": [0.3, 0.5], "min_samples": [5], "metric": ["euclidean"]})
    best = km.unionByName(db).groupBy("algorithm").agg(F.max("score").alias("score"))
    return O.confidence_frame(best)


@register("o7_confidence",
          "WITH s AS (SELECT event_type AS algorithm, avg(value) AS score FROM events GROUP BY event_type), "
          "r AS (SELECT *, row_number() OVER (ORDER BY score DESC, algorithm) AS rk FROM s) "
          "SELECT (SELECT algorithm FROM r WHERE rk = 1) AS best_algorithm, "
          f"{R('(SELECT score FROM r WHERE rk = 1)')} AS best_score, {R('CASE WHEN (SELECT count(*) FROM r) < 2 OR (SELECT score FROM r WHERE rk = 2) <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, ((SELECT score FROM r WHERE rk = 1) - (SELECT score FROM r WHERE rk = 2)) / (SELECT score FROM r WHERE rk = 1))) END')} AS confidence")
def o7_confidence(spark, sf):
    """Confidence of the best of a score table (mean event value per event
    type standing in for per-algorithm scores)."""
    s = load(spark, sf, "events").groupBy(F.col("event_type").alias("algorithm")).agg(F.avg("value").alias("score"))
    c = O.confidence_frame(s)
    return c.select("best_algorithm", round_to("best_score").alias("best_score"),
                    round_to("confidence").alias("confidence"))


@register("o8_recommend", with_fixtures(
    "SELECT count(*) AS n_samples, CAST(4 AS INTEGER) AS n_features, count(*) / 4.0 AS sample_to_feature_ratio, "
    "CASE WHEN count(*) < 100 THEN 'small' WHEN count(*) < 1000 THEN 'medium' ELSE 'large' END AS sample_size, "
    "CASE WHEN count(*) < 100 THEN 'kmeans,agglomerative' WHEN count(*) < 1000 THEN 'kmeans,dbscan' ELSE "
    "'kmeans,dbscan,hdbscan' END AS suggested_algorithms, 'moderate' AS dimensionality, CASE WHEN count(*) * "
    "(CASE WHEN count(*) < 100 THEN 2 WHEN count(*) < 1000 THEN 2 ELSE 3 END) > 10000 THEN 'random_search' ELSE "
    "'grid_search' END AS optimization_strategy, CAST(CASE WHEN count(*) * (CASE WHEN count(*) < 100 THEN 2 WHEN "
    "count(*) < 1000 THEN 2 ELSE 3 END) > 10000 THEN 20 END AS INTEGER) AS n_trials FROM features", "features"))
def o8_recommend(spark, sf):
    return O.recommend(features(spark, sf), FEATS, "clustering")

