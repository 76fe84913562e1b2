"""Parameter search and algorithm choice.

Candidates are small driver-side lists (bounded by the search space, not by
the data). Each candidate fit is a set of Spark jobs over the cached feature
table; up to four candidates run at once from a driver thread pool (Spark's
scheduler interleaves their jobs), failures score -1.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The default search spaces of the reference.
DEFAULT_SPACES = {
    "tsne": {"perplexity": [5, 10, 15, 30, 50], "learning_rate": ["auto", 10, 50, 100, 200],
             "n_iter": [250, 500, 1000, 1500]},
    "umap": {"n_neighbors": [5, 10, 15, 20, 30, 50], "min_dist": [0.01, 0.05, 0.1, 0.3, 0.5],
             "metric": ["euclidean", "manhattan", "cosine"]},
    "pca": {"whiten": [True, False]},
    "kmeans": {"n_clusters": list(range(2, 11)), "init": ["k-means++", "random"], "algorithm": ["lloyd", "elkan"]},
    "dbscan": {"eps": [0.1, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0], "min_samples": [3, 5, 7, 10, 15],
               "metric": ["euclidean", "manhattan", "cosine"]},
    "hdbscan": {"min_cluster_size": [3, 5, 10, 15, 25], "cluster_selection_epsilon": [0.0, 0.1, 0.5],
                "alpha": [0.5, 1.0, 1.5]},
    "isolation_forest": {"n_estimators": [50, 100, 200], "contamination": [0.05, 0.1, 0.15, 0.2],
                         "max_features": [0.5, 0.75, 1.0]},
}
# The algorithms suggested for small, medium and large inputs.
SUGGESTED = {
    "clustering": (["kmeans", "agglomerative"], ["kmeans", "dbscan"], ["kmeans", "dbscan", "hdbscan"]),
    "dimensionality_reduction": (["pca"], ["tsne", "pca"], ["umap", "tsne"]),
    "anomaly_detection": (["elliptic_envelope"], ["isolation_forest", "local_outlier_factor"], ["isolation_forest"]),
}
# ---------------------------------------------------------------------------


def param_grid(space: dict) -> list[dict]:
    """O1: the cartesian product of a space, keys in their given order."""
    keys = list(space)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]


def param_key(params: dict) -> str:
    return "|".join(str(params[k]) for k in params)


def param_sample(grid: list[dict], n: int, seed: int = 42) -> list[dict]:
    """O2: a repeatable subset of n candidates (md5 order of seed and key)."""
    if len(grid) <= n:
        return list(grid)
    ranked = sorted(grid, key=lambda p: (hashlib.md5(f"{seed}:{param_key(p)}".encode()).hexdigest(), param_key(p)))
    return ranked[:n]


#: (algorithm, parameter) -> first value that n rows cannot support.
VALUE_LIMITS = {
    ("tsne", "perplexity"): lambda n: (n - 1) // 3,
    ("umap", "n_neighbors"): lambda n: n - 1,
    ("kmeans", "n_clusters"): lambda n: min(n, 11),
    ("dbscan", "min_samples"): lambda n: max(3, n // 10 + 1),
}


def adjust_space(space: dict, algorithm: str, n_samples: int) -> dict:
    """O3: the space without values that n rows cannot support. Perplexity
    always keeps one value, the smaller of 5 and its limit."""
    def fits(name, value) -> bool:
        limit = VALUE_LIMITS.get((algorithm, name))
        return limit is None or value < limit(n_samples)

    out = {name: [v for v in values if fits(name, v)] for name, values in space.items()}
    if algorithm == "tsne" and out.get("perplexity") == []:
        out["perplexity"] = [min(5, VALUE_LIMITS["tsne", "perplexity"](n_samples))]
    return out


def confidence(scores: Sequence[float]) -> float:
    """(best - second) / best clamped to [0, 1]; 1 with fewer than two
    scores or a non-positive second best."""
    if len(scores) < 2:
        return 1.0
    s = sorted(scores, reverse=True)
    if s[1] <= 0:
        return 1.0
    return min(1.0, max(0.0, (s[0] - s[1]) / s[0]))


def confidence_frame(scores: DataFrame, name: str = "algorithm", score: str = "score") -> DataFrame:
    """O7 over a score table: top two by score (a window limited to 2)."""
    from pyspark.sql import Window

    w = Window.orderBy(F.desc(score), F.asc(name))
    top = scores.withColumn("__r", F.row_number().over(w)).where("__r <= 2")
    a = top.agg(F.count(F.lit(1)).alias("n"), F.max_by(name, F.struct(F.col(score), F.lit(0) - F.col("__r")))
                .alias("best"), F.max(F.when(F.col("__r") == 1, F.col(score))).alias("s1"),
                F.max(F.when(F.col("__r") == 2, F.col(score))).alias("s2"))
    conf = F.when((F.col("n") < 2) | (F.col("s2") <= 0), F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s1") - F.col("s2")) / F.col("s1"))))
    return a.select(F.col("best").alias("best_algorithm"), F.col("s1").alias("best_score"),
                    conf.alias("confidence"))


def _score_clustering(df: DataFrame, cols: Sequence[str], labels: DataFrame, scoring: str) -> float:
    from constella.operators import metrics as M

    j = labels
    if scoring == "silhouette":
        v = M.silhouette_sq(j, cols).first()[0]
    elif scoring == "calinski_harabasz":
        v = M.calinski_harabasz(j, cols).first()[0]
    else:
        db = M.davies_bouldin(j, cols).first()[0]
        v = None if db is None else -db
    return -1.0 if v is None else float(v)


def fit_clustering(df: DataFrame, cols: Sequence[str], algorithm: str, params: dict,
                   id_col: str = "row_id") -> DataFrame:
    """(id, features, cluster) for one candidate."""
    from constella.operators import cluster as K
    from constella.operators import neighbors as N

    if algorithm == "kmeans":
        m = K.kmeans(df, cols, k=int(params["n_clusters"]), init=params.get("init", "k-means++"), n_init=1)
        return m.assign(df.select(id_col, *cols))
    if algorithm == "dbscan":
        if params.get("metric", "euclidean") != "euclidean":
            raise ValueError("only the euclidean metric is supported")
        lab = N.dbscan(df, cols, float(params["eps"]), int(params["min_samples"]), id_col)
        return df.select(id_col, *cols).join(lab.select(id_col, "cluster"), id_col)
    if algorithm == "hdbscan":
        from constella.operators import density as DN

        # alpha scales all distances alike, so it divides the selection distance
        alpha = float(params.get("alpha", 1.0))
        lab = DN.hdbscan(df, cols, int(params["min_cluster_size"]), None,
                         float(params.get("cluster_selection_epsilon", 0.0)) * alpha, id_col).labels
        return df.select(id_col, *cols).join(lab.select(id_col, "cluster"), id_col)
    raise ValueError(f"no tuner for {algorithm}")


def tune_clustering(df: DataFrame, cols: Sequence[str], algorithm: str = "kmeans", scoring: str = "silhouette",
                    space: dict | None = None, max_candidates: int | None = None, workers: int = 4,
                    seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Fit and score every candidate; one row per candidate."""
    data = df.select(id_col, *cols).persist()
    n = data.count()
    space = adjust_space(space or DEFAULT_SPACES[algorithm], algorithm, n)
    grid = param_grid(space)
    if algorithm == "kmeans":  # init variants differ, solver variants do not on Spark
        grid = [g for g in grid if g.get("algorithm", "lloyd") == "lloyd"]
    if algorithm == "dbscan":
        grid = [g for g in grid if g.get("metric", "euclidean") == "euclidean"]
    if max_candidates:
        grid = param_sample(grid, max_candidates, seed)

    def run(p):
        try:
            return json.dumps(p, sort_keys=True), _score_clustering(data, cols, fit_clustering(data, cols, algorithm,
                                                                                                 p, id_col), scoring)
        except Exception:  # noqa: BLE001 - a failed candidate scores -1
            return json.dumps(p, sort_keys=True), -1.0

    with ThreadPoolExecutor(max_workers=workers) as pool:
        results = list(pool.map(run, grid))
    return df.sparkSession.createDataFrame([(algorithm, p, s) for p, s in results],
                                           "algorithm string, params string, score double")


def tune_reduction(df: DataFrame, cols: Sequence[str], space: dict | None = None) -> DataFrame:
    """O5 for PCA: score = 0.7 * explained variance ratio (total) + 0.3 *
    total variance of the embedding."""
    from constella.operators import reduce as D

    rows = []
    for p in param_grid(space or DEFAULT_SPACES["pca"]):
        m = D.fit_pca(df, cols, 3, whiten=bool(p["whiten"]))
        emb_var = float(len(m.variances)) if p["whiten"] else float(m.variances.sum())
        explained = float(m.explained_variance_ratio.sum())
        rows.append(("pca", json.dumps(p, sort_keys=True), explained * 0.7 + emb_var * 0.3))
    return df.sparkSession.createDataFrame(rows, "algorithm string, params string, score double")


def auto_k(df: DataFrame, cols: Sequence[str], k_min: int = 2, k_max: int = 10, seed: int = 42) -> tuple[int, DataFrame]:
    """K2: k-means for each k; silhouette arg-max when above 0.5, else the
    elbow of the inertia curve."""
    from constella.operators import cluster as K
    from constella.operators import metrics as M

    data = df.select(*cols).persist()
    rows = []
    for k in range(k_min, k_max + 1):
        m = K.kmeans(data, cols, k=k, n_init=3, seed=seed)
        lab = m.assign(data)
        sil = M.silhouette_sq(lab, cols).first()[0]
        rows.append((k, float(m.cost), float(sil) if sil is not None else -1.0))
    scores = df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")
    best_sil = max(rows, key=lambda r: (r[2], -r[0]))
    if best_sil[2] > 0.5:
        return best_sil[0], scores
    return K.elbow(scores).first()["best_k"], scores


def recommend(df: DataFrame, cols: Sequence[str], task: str = "clustering") -> DataFrame:
    """Size class, suggested algorithms, dimensionality and search
    strategy from the row and feature counts."""
    d = len(cols)
    n = F.col("n_samples")

    def by_size(small, medium, large):
        return F.when(n < 100, small).when(n < 1000, medium).otherwise(large)

    size = by_size("small", "medium", "large")
    suggested = by_size(*(",".join(names) for names in SUGGESTED[task]))
    trials = n * by_size(*(len(names) for names in SUGGESTED[task]))
    strategy = F.when(trials > 10000, "random_search").otherwise("grid_search")
    return df.agg(F.count(F.lit(1)).alias("n_samples")).select(
        "n_samples", F.lit(d).cast("int").alias("n_features"), (n / F.lit(float(d))).alias("sample_to_feature_ratio"),
        size.alias("sample_size"), suggested.alias("suggested_algorithms"),
        F.lit("high" if d > 50 else "moderate").alias("dimensionality"), strategy.alias("optimization_strategy"),
        F.when(strategy == "random_search", F.lit(20)).cast("int").alias("n_trials"))
