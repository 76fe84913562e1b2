"""Registered kernel embeddings and kernel detector (D6, D7, A3) and the
user-staged analysis (R7); rows-checked, with pytest invariants."""

from __future__ import annotations

from constella.operators import embed as EM
from constella.plans.registry import register
from constella.tables import points3d

XYZ = ["x", "y", "z"]


@register("d6_kernel_pca")
def d6_kernel_pca(spark, sf):
    coords, _ = EM.kernel_pca(points3d(spark, sf), XYZ, 3, m=100)
    return coords


@register("d7_landmark_mds")
def d7_landmark_mds(spark, sf):
    coords, _ = EM.landmark_mds(points3d(spark, sf), XYZ, 3, m=200)
    return coords


@register("d4_tsne")
def d4_tsne(spark, sf):
    """Rows-only: t-SNE layout (perplexity 30, 20 batch iterations)."""
    from constella.operators.layout import tsne

    return tsne(points3d(spark, sf), XYZ, perplexity=30.0, iters=20)


@register("d5_umap")
def d5_umap(spark, sf):
    """Rows-only: UMAP layout (15 neighbours, min_dist 0.1, 20 iterations)."""
    from constella.operators.layout import umap

    return umap(points3d(spark, sf), XYZ, n_neighbors=15, min_dist=0.1, iters=20)


@register("a3_one_class_svm")
def a3_one_class_svm(spark, sf):
    flagged, _ = EM.one_class_svm(points3d(spark, sf), XYZ, nu=0.1, iters=40)
    return flagged.select("row_id", "score", "is_anomaly")


@register("r7_stage_pipeline")
def r7_stage_pipeline(spark, sf):
    """User-ordered stages: kernel PCA -> DBSCAN -> LOF; only the reduction
    feeds the next stage; per-stage metrics alongside."""
    from constella.plans.flow import stage_pipeline

    res = stage_pipeline(points3d(spark, sf), XYZ, [("reduce", "kernel_pca", {}), ("cluster", "dbscan", {"eps": 0.05}),
                                                     ("anomaly", "lof", {"k": 20, "contamination": 0.1})])
    return res["points"]
