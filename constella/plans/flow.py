"""The whole analysis (R6): preprocess -> reduce -> cluster -> anomalies ->
assemble, over a DataFrame with a ``row_id``.

Each fit is a distributed aggregate (or Spark ML / applyInPandas over bounded
samples); each apply is a column expression, so the point table is one narrow
projection of the source rows: coordinates, cluster and anomaly score are
computed side by side on the same row and never joined back by id.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constella.operators import anomaly as A
from constella.operators import assemble as R
from constella.operators import clean as C
from constella.operators import cluster as K
from constella.operators import reduce as D
from constella.session import ensure_parallelism


@dataclass(frozen=True)
class AnalysisConfig:
    reduction: str = "pca"
    clustering: str = "kmeans"
    n_clusters: int = 3
    detect_anomalies: bool = True
    contamination: float = 0.1
    missing: str = "mean"
    outliers: str | None = None
    scaling: str = "standard"
    max_samples: int | None = None
    size_column: str | None = None
    random_state: int = 42
    n_trees: int = 100
    kmeans_n_init: int = 1
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 2 <= self.n_clusters <= 20:
            raise ValueError("n_clusters must be in [2, 20]")
        if not 0.01 <= self.contamination <= 0.5:
            raise ValueError("contamination must be in [0.01, 0.5]")
        if self.missing not in ("drop", "mean", "median", "mode", "zero", "knn"):
            raise ValueError(f"unknown missing-value strategy {self.missing!r}")
        if self.max_samples is not None and self.max_samples < 100:
            raise ValueError("max_samples must be >= 100")


def preprocess(df: DataFrame, cols: Sequence[str], missing: str = "mean", outliers: str | None = None,
               scaling: str = "standard", max_samples: int | None = None, seed: int = 42,
               id_col: str = "row_id") -> tuple[DataFrame, list[str]]:
    """Sample -> select -> impute -> outliers -> scale, with a step log."""
    steps = []
    if max_samples:
        df = C.sample_n(df, max_samples, seed, id_col)
        steps.append(f"Sampled up to {max_samples} rows")
    df = C.select_features(df, cols, keep=(id_col,))
    steps.append(f"Selected {len(cols)} features")
    if missing == "mean" and outliers is None and scaling == "standard":
        # both fits from one aggregate; one projection fills and scales
        df = C.fit_mean_standard(df, cols).transform(df)
        steps += [f"Handled missing values ({missing})", f"Applied {scaling} scaling"]
        return df, steps
    df = C.impute(df, cols, missing)
    steps.append(f"Handled missing values ({missing})")
    if outliers == "iqr":
        df = C.clip_iqr(df, cols)
        steps.append("Clipped outliers using IQR method")
    elif outliers == "zscore":
        df = C.filter_zscore(df, cols, 3.0)
        steps.append("Removed outlier rows using Z-score (threshold=3)")
    df = C.fit_scaler(df, cols, scaling).transform(df)
    steps.append(f"Applied {scaling} scaling")
    return df, steps


@dataclass
class AnalysisResult:
    points: DataFrame
    clusters: DataFrame
    anomalies: DataFrame
    metadata: DataFrame
    pca: D.PCAModel | None
    centres: K.CentresModel | None
    threshold: float | None
    steps: list[str]
    seconds: float


def run_analysis(df: DataFrame, cols: Sequence[str], cfg: AnalysisConfig = AnalysisConfig(),
                 id_col: str = "row_id") -> AnalysisResult:
    """R6 for the built-in reducers/clusterers with a centre or axis model."""
    t0 = time.time()
    n = df.limit(10).count()
    if n < 10:
        raise ValueError("at least 10 rows are needed")
    source = df
    feats, steps = preprocess(df, cols, cfg.missing, cfg.outliers, cfg.scaling, cfg.max_samples,
                              cfg.random_state, id_col)
    # the scaled features are read by every fit below: cache them, spread
    # over the cluster when the input arrived in too few splits
    feats = ensure_parallelism(feats).persist()
    xyz = ["x", "y", "z"]
    pca = None
    opts = dict(cfg.extra)
    if cfg.reduction == "pca":
        pca = D.fit_pca(feats, cols, 3, whiten=bool(opts.get("whiten", False)))
        coords = pca.transform(feats, keep=[id_col, *cols])
    else:
        from constella.operators import embed as EM
        from constella.operators import layout as LY

        if cfg.reduction == "tsne":
            emb = LY.tsne(feats, cols, opts.get("perplexity", 30.0), iters=opts.get("iterations", 20), id_col=id_col)
        elif cfg.reduction == "umap":
            emb = LY.umap(feats, cols, opts.get("n_neighbors", 15), opts.get("min_dist", 0.1),
                          iters=opts.get("iterations", 20), id_col=id_col)
        elif cfg.reduction == "kernel_pca":
            emb, _ = EM.kernel_pca(feats, cols, 3, m=opts.get("landmarks", 100), id_col=id_col)
        elif cfg.reduction == "mds":
            emb, _ = EM.landmark_mds(feats, cols, 3, m=opts.get("landmarks", 200), id_col=id_col)
        else:
            raise ValueError(f"unsupported reduction method {cfg.reduction!r}")
        # the layout is keyed by row id: one equi-join brings the features back
        keep = feats.drop(*[c for c in xyz if c in feats.columns and c != id_col])
        coords = keep.join(emb.withColumnRenamed("row_id", id_col) if id_col != "row_id" else emb, id_col)
        coords = coords.persist()
    centres = None
    if cfg.clustering == "kmeans":
        k = cfg.n_clusters
        # with PCA the coordinates' variances are its eigenvalues: no extra pass
        mv = float(pca.variances.mean()) if pca is not None and len(pca.variances) else None
        centres = K.kmeans(coords, xyz, k=k, n_init=cfg.kmeans_n_init, seed=cfg.random_state, mean_variance=mv)
        coords = centres.assign(coords, "cluster")
    elif cfg.clustering in ("dbscan", "agglomerative", "gaussian_mixture", "hdbscan"):
        from constella.operators import hierarchy as H
        from constella.operators import mixture as MX
        from constella.operators import neighbors as N

        if cfg.clustering == "dbscan":
            lab = N.dbscan(coords, xyz, opts.get("eps", 0.5), opts.get("min_samples", 5), id_col)
        elif cfg.clustering == "agglomerative":
            lab = H.agglomerative(coords, xyz, cfg.n_clusters, opts.get("linkage", "ward"),
                                  opts.get("distance_threshold"), id_col=id_col)
        elif cfg.clustering == "gaussian_mixture":
            mix = MX.gaussian_mixture(coords, xyz, cfg.n_clusters, opts.get("covariance", "auto"))
            lab = mix.e_step(coords.select(id_col, *xyz)).select(id_col, "cluster")
        else:
            from constella.operators import density as DN

            found = DN.hdbscan(coords, xyz, opts.get("min_cluster_size", 5), opts.get("min_samples"),
                               opts.get("cluster_selection_epsilon", 0.0), id_col)
            lab = found.labels
        coords = coords.join(lab.select(id_col, "cluster"), id_col)
    else:
        raise ValueError(f"unsupported clustering method {cfg.clustering!r}")
    threshold = None
    if cfg.detect_anomalies:
        forest = A.fit_isolation_forest(feats, cols, cfg.n_trees, 256, cfg.random_state, id_col)
        scored = coords.withColumn("score", forest.score_column(df.sparkSession)).persist()
        pts, threshold = A.threshold_flags(scored, cfg.contamination)
    else:
        pts = coords.withColumn("score", F.lit(None).cast("double")).withColumn("is_anomaly", F.lit(False))
    if cfg.size_column:
        pts = pts.join(source.select(id_col, cfg.size_column), id_col, "left")
    pts = R.decorate(pts, "cluster", "is_anomaly", cfg.size_column)
    clusters = R.cluster_summary(pts)
    anomalies = pts.where("is_anomaly").select(id_col, "score")
    meta = R.run_metadata(pts, cfg.reduction, cfg.clustering, cols, steps)
    return AnalysisResult(pts, clusters, anomalies, meta, pca, centres, threshold, steps, time.time() - t0)


def stage_pipeline(df: DataFrame, cols: Sequence[str], stages: Sequence[tuple[str, str, dict]],
                   id_col: str = "row_id") -> dict:
    """User-chosen ordered stages (kind, algorithm, params). Only a
    reduction changes the coordinates the next stages see; clustering and
    anomaly stages add columns. Returns the point table and one metrics row
    per stage."""
    from constella.operators import embed as EM
    from constella.operators import hierarchy as H
    from constella.operators import metrics as M
    from constella.operators import neighbors as N

    spark = df.sparkSession
    cur = df.select(id_col, *cols)
    feats = list(cols)
    labels = None
    flags = None
    metrics = []
    for kind, algo, params in stages:
        t0 = time.time()
        if kind == "reduce":
            if algo == "pca":
                cur, _m = D.pca(cur, feats, params.get("n_components", 3))
            elif algo == "kernel_pca":
                cur, _m = EM.kernel_pca(cur, feats, 3, m=params.get("m", 100))
            elif algo == "mds":
                cur, _m = EM.landmark_mds(cur, feats, 3, m=params.get("m", 200))
            else:
                raise ValueError(f"unknown reducer {algo}")
            cur = cur.persist()
            feats = ["x", "y", "z"]
            metrics.append((kind, algo, "total_variance", float(sum(
                v or 0.0 for v in D.embedding_variance(cur).first()[:3]))))
        elif kind == "cluster":
            if algo == "kmeans":
                labels = K.kmeans(cur, feats, k=params.get("k", 3)).assign(cur.select(id_col, *feats))
            elif algo == "dbscan":
                lab = N.dbscan(cur, feats, params.get("eps", 0.5), params.get("min_samples", 5), id_col)
                labels = cur.join(lab.select(id_col, "cluster"), id_col)
            elif algo == "agglomerative":
                lab = H.agglomerative(cur, feats, params.get("k", 3), params.get("linkage", "ward"),
                                      params.get("distance_threshold"), id_col=id_col)
                labels = cur.join(lab, id_col)
            elif algo == "hdbscan":
                from constella.operators import density as DN

                lab = DN.hdbscan(cur, feats, params.get("min_cluster_size", 5), params.get("min_samples"),
                                 params.get("cluster_selection_epsilon", 0.0), id_col).labels
                labels = cur.join(lab, id_col)
            elif algo == "gaussian_mixture":
                from constella.operators import mixture as MX

                mix = MX.gaussian_mixture(cur, feats, params.get("k", 3), params.get("covariance", "auto"))
                labels = mix.e_step(cur.select(id_col, *feats))
            else:
                raise ValueError(f"unknown clusterer {algo}")
            labels = labels.select(id_col, "cluster").persist()
            sil = M.silhouette_sq(cur.join(labels, id_col), feats).first()[0]
            metrics.append((kind, algo, "silhouette_sq", float(sil) if sil is not None else None))
        elif kind == "anomaly":
            if algo == "lof":
                scored = N.lof(cur, feats, params.get("k", 20), id_col)
            elif algo == "isolation_forest":
                forest = A.fit_isolation_forest(cur, feats, params.get("n_trees", 100), 256, 42, id_col)
                scored = cur.select(id_col, forest.score_column(spark).alias("score"))
            elif algo == "elliptic_envelope":
                scored, _ = A.elliptic_envelope(cur, feats, params.get("contamination", 0.1), id_col=id_col)
                scored = scored.select(id_col, "score")
            else:
                raise ValueError(f"unknown detector {algo}")
            flags, _thr = A.threshold_flags(scored.persist(), params.get("contamination", 0.1))
            share = flags.agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
            metrics.append((kind, algo, "flagged_share", float(share)))
        else:
            raise ValueError(f"unknown stage kind {kind}")
        metrics[-1] = metrics[-1] + (time.time() - t0,)
    pts = cur
    if labels is not None:
        pts = pts.join(labels, id_col, "left")
    else:
        pts = pts.withColumn("cluster", F.lit(-1))
    if flags is not None:
        pts = pts.join(flags.select(id_col, "score", "is_anomaly"), id_col, "left")
    else:
        pts = pts.withColumn("score", F.lit(None).cast("double")).withColumn("is_anomaly", F.lit(False))
    pts = R.decorate(pts.withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False))), "cluster", "is_anomaly")
    mdf = spark.createDataFrame(metrics, "stage string, algorithm string, metric string, value double, "
                                         "seconds double")
    return {"points": pts, "metrics": mdf}


def flagship(spark, sf_dir: str) -> DataFrame:
    """entry(): lineitem features -> mean impute -> standard scale -> PCA ->
    k-means (k=3) -> isolation forest -> one row per cluster."""
    from constella.tables import NUMERIC_FEATURES, features

    df = features(spark, sf_dir).drop("l_returnflag")
    return run_analysis(df, NUMERIC_FEATURES, AnalysisConfig()).clusters
