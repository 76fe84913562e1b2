"""Result assembly (R1-R5) and template explanations.

Everything is keyed by ``row_id`` (the reference zipped rows by position and
lost the link after sampling). Colours, sizes, summaries and sentences are
column expressions and grouped aggregates; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constella.functions.numeric import round_to

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical output):
# cluster palette, anomaly colour, noise colour.
PALETTE = ["#FF6B6B", "#4ECDC4", "#45B7D1", "#96CEB4", "#FECA57",
           "#FF9FF3", "#54A0FF", "#5F27CD", "#00D2D3", "#FF9F43",
           "#FFC312", "#C4E538", "#12CBC4", "#FDA7DF", "#ED4C67"]
ANOMALY_COLOR = "#FF0000"
NOISE_COLOR = "#808080"
# Explanation templates (English and French), in the
# reference's wording.
CLUSTER_TEXT = {
    "en": "Cluster %d groups %d data points that exhibit similar characteristics in the reduced dimensional "
          "space. These points were identified as forming a coherent group by the clustering algorithm.",
    "fr": "Le cluster %d regroupe %d points de données qui présentent des caractéristiques similaires dans "
          "l'espace de réduction dimensionnelle. Ces points ont été identifiés comme formant un groupe cohérent "
          "par l'algorithme de clustering.",
}
ANOMALY_TEXT = {
    "en": "%d anomalies detected (%s%% of data). These points exhibit unusual characteristics that distinguish "
          "them from the main patterns in the dataset.",
    "fr": "%d anomalies détectées (%s%% des données). Ces points présentent des caractéristiques inhabituelles "
          "qui les distinguent des patterns principaux du dataset.",
}
NO_ANOMALY_TEXT = {"en": "No anomalies detected in this dataset.",
                   "fr": "Aucune anomalie détectée dans ce dataset."}
SUMMARY_HEAD = {"en": "Analysis of %d data points revealing %d distinct groups",
                "fr": "Analyse de %d points de données révélant %d groupes distincts"}
SUMMARY_ANOMALIES = {"en": " and %d anomalies", "fr": " et %d anomalies"}
SUMMARY_TAIL = {"en": ". Processing completed in %s seconds using %s and %s.",
                "fr": ". Traitement effectué en %s secondes avec %s et %s."}
CHARACTERISTIC_TEXT = {
    "homogeneous": "Valeurs %s homogènes (moyenne: %s)",
    "variable": "Valeurs %s variables (écart-type: %s)",
    "high": "Tendance %s élevée",
    "low": "Tendance %s faible",
    "majority": "Majorité %s: %s",
}
# ---------------------------------------------------------------------------


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def palette_color(cluster: Column) -> Column:
    pal = F.array(*[F.lit(c) for c in PALETTE])
    return F.element_at(pal, (F.pmod(cluster, F.lit(len(PALETTE))) + 1).cast("int"))


def point_color(cluster: Column, is_anomaly: Column) -> Column:
    """R2: anomaly red, noise grey (-1 or null), else palette[cluster % 15]."""
    return (F.when(F.coalesce(is_anomaly, F.lit(False)), F.lit(ANOMALY_COLOR))
            .when(cluster.isNull() | (cluster == -1), F.lit(NOISE_COLOR))
            .otherwise(palette_color(cluster)))


def point_size(value: Column | None) -> Column:
    """Value / 100 clamped to [0.5, 2]; missing or unparsable -> 1."""
    if value is None:
        return F.lit(1.0)
    v = value.cast("string").try_cast("double")
    return F.coalesce(F.least(F.greatest(v / 100.0, F.lit(0.5)), F.lit(2.0)), F.lit(1.0))


def decorate(df: DataFrame, cluster: str = "cluster", anomaly: str = "is_anomaly",
             size_column: str | None = None) -> DataFrame:
    """Add color and size to a frame that already holds coordinates, cluster
    and anomaly flag (the narrow path: no join needed)."""
    return df.withColumn("color", point_color(_q(cluster), _q(anomaly))) \
             .withColumn("size", point_size(_q(size_column) if size_column else None))


def points(coords: DataFrame, labels: DataFrame, anomalies: DataFrame | None, source: DataFrame | None = None,
           size_column: str | None = None, id_col: str = "row_id") -> DataFrame:
    """Coordinates join labels on row_id; anomaly flag by left semi-style
    join on the anomaly id list; the source row is carried as a struct."""
    p = coords.join(labels.select(id_col, "cluster"), id_col, "inner")
    if anomalies is not None:
        flags = anomalies.select(id_col).distinct().withColumn("is_anomaly", F.lit(True))
        p = p.join(flags, id_col, "left")
    p = p.withColumn("is_anomaly", F.coalesce(F.col("is_anomaly") if anomalies is not None else F.lit(False),
                                              F.lit(False)))
    if source is not None:
        src_cols = [c for c in source.columns if c != id_col]
        p = p.join(source.select(id_col, F.struct(*src_cols).alias("original")), id_col, "left")
    size = point_size(F.col("original").getField(size_column)) if (size_column and source is not None) else None
    p = p.withColumn("color", point_color(F.col("cluster"), F.col("is_anomaly"))).withColumn(
        "size", point_size(None) if size is None else size)
    return p.withColumnRenamed(id_col, "point_id")


def cluster_summary(pts: DataFrame, cluster: str = "cluster", digits: int = 6) -> DataFrame:
    """Per cluster (noise skipped) count, centre, colour, label."""
    g = pts.where(_q(cluster) != -1).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("count"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    return g.select(F.col(cluster).alias("cluster_id"), "count",
                    round_to("cx", digits).alias("center_x"), round_to("cy", digits).alias("center_y"),
                    round_to("cz", digits).alias("center_z"),
                    palette_color(F.col(cluster)).alias("color"),
                    F.concat(F.lit("Cluster "), F.col(cluster).cast("string")).alias("label"))


def run_metadata(pts: DataFrame, reduction: str, clustering: str, features: Sequence[str],
                 steps: Sequence[str]) -> DataFrame:
    """One row of run metadata (time kept out: it is not a data result)."""
    return pts.agg(F.count(F.lit(1)).alias("total_points")).select(
        "total_points", F.lit(reduction).alias("reduction_method"), F.lit(clustering).alias("clustering_method"),
        F.lit(",".join(features)).alias("features_used"), F.lit("; ".join(steps)).alias("preprocessing_steps"))


# ------------------------------------------------------------------ X1-X7
def _fmt2(c: Column) -> Column:
    return F.format_string("%.2f", round_to(c, 2))


def cluster_characteristics(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                            cluster: str = "cluster", keep: int = 5) -> DataFrame:
    """Per cluster, up to five sentences in column order: numeric
    homogeneous / variable (population std vs mean) and sign trend, then a
    categorical value above 70 %. Noise is skipped."""
    src = df.where(_q(cluster) != -1)
    num = src.select(_q(cluster).alias("cluster"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), _q(c).cast("double").alias("v"))
        for i, c in enumerate(numeric)]))).where(F.col("v").isNotNull() & ~F.isnan("v"))
    st = num.groupBy("cluster", "pos", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"),
                                                      F.stddev_pop("v").alias("s")).where("n > 1")
    t = CHARACTERISTIC_TEXT
    spread = (F.when(F.col("s") < F.col("m") * 0.1, F.format_string(t["homogeneous"], "feature", _fmt2(F.col("m"))))
              .when(F.col("s") > F.col("m") * 0.5, F.format_string(t["variable"], "feature", _fmt2(F.col("s")))))
    trend = (F.when(F.col("m") > 0, F.format_string(t["high"], "feature"))
             .when(F.col("m") < 0, F.format_string(t["low"], "feature")))
    num_rows = st.select("cluster", F.inline(F.array(
        F.struct((F.col("pos") * 2).alias("key"), spread.alias("text")),
        F.struct((F.col("pos") * 2 + 1).alias("key"), trend.alias("text")))))
    parts = [num_rows]
    if categorical:
        cat = src.select(_q(cluster).alias("cluster"), F.inline(F.array(*[
            F.struct(F.lit(1000 + i).alias("key"), F.lit(c).alias("feature"), _q(c).cast("string").alias("v"))
            for i, c in enumerate(categorical)]))).where(F.col("v").isNotNull())
        cnt = cat.groupBy("cluster", "key", "feature", "v").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("cluster", "key")
        top = cnt.withColumn("tot", F.sum("n").over(w)).withColumn(
            "r", F.row_number().over(w.orderBy(F.desc("n"), F.asc("v")))).where("r = 1")
        parts.append(top.where(F.col("n") > F.col("tot") * 0.7).select(
            "cluster", "key", F.format_string(t["majority"], "feature", "v").alias("text")))
    allrows = parts[0]
    for p in parts[1:]:
        allrows = allrows.unionByName(p)
    w2 = Window.partitionBy("cluster").orderBy("key")
    return (allrows.where(F.col("text").isNotNull()).withColumn("rank", F.row_number().over(w2))
            .where(F.col("rank") <= keep).select(F.col("cluster").cast("int").alias("cluster"),
                                                 F.col("rank").cast("int").alias("rank"),
                                                 F.col("text").alias("characteristic")))


def key_features(df: DataFrame, numeric: Sequence[str], cluster: str = "cluster", top: int = 5) -> DataFrame:
    """Features ranked by |cluster mean - global mean| / global std."""
    long = df.select(_q(cluster).alias("cluster"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), _q(c).cast("double").alias("v")) for c in numeric])))
    glob = long.groupBy("feature").agg(F.avg("v").alias("gm"), F.stddev_pop("v").alias("gs"))
    per = long.where(F.col("cluster") != -1).groupBy("cluster", "feature").agg(F.avg("v").alias("cm"))
    j = per.join(F.broadcast(glob), "feature")  # one row per feature: size bound = #features
    score = F.when(F.col("gs") > 0, F.abs(F.col("cm") - F.col("gm")) / F.col("gs")).otherwise(F.lit(0.0))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), F.asc("feature"))
    return (j.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select(F.col("cluster").cast("int").alias("cluster"), F.col("rank").cast("int").alias("rank"),
                    "feature", round_to("score").alias("score")))


def representatives(df: DataFrame, cluster: str = "cluster", n: int = 3, id_col: str = "row_id") -> DataFrame:
    """The first n points of each cluster in row-id order."""
    w = Window.partitionBy(cluster).orderBy(id_col)
    return (df.where(_q(cluster) != -1).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(F.col(cluster).cast("int").alias("cluster"), F.col("rank").cast("int").alias("rank"),
                    F.col(id_col).cast("string").alias("row_id")))


def cluster_context(df: DataFrame, features: Sequence[str], reduction: str, clustering: str,
                    cluster: str = "cluster", id_col: str = "row_id", samples: int = 5) -> DataFrame:
    """Size, share of all points (1 decimal), sample row ids, features
    and methods per cluster."""
    total = df.count()
    sizes = df.where(_q(cluster) != -1).groupBy(cluster).agg(F.count(F.lit(1)).alias("cluster_size"))
    reps = representatives(df, cluster, samples, id_col).groupBy("cluster").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "row_id"))),
                                 lambda s: s["row_id"]), ",").alias("sample_ids"))
    out = sizes.withColumn("total_points", F.lit(total).cast("bigint"))
    return (out.join(reps, out[cluster] == reps["cluster"], "left").select(
        out[cluster].cast("int").alias("cluster_id"), "cluster_size", "total_points",
        round_to(F.col("cluster_size") / F.col("total_points") * 100, 1).alias("cluster_percentage"),
        "sample_ids", F.lit(",".join(features)).alias("features_used"),
        F.lit(reduction).alias("reduction_method"), F.lit(clustering).alias("clustering_method")))


def cluster_text(summary: DataFrame, lang: str = "en") -> DataFrame:
    """The template sentence per cluster."""
    return summary.select(F.col("cluster_id"), F.format_string(CLUSTER_TEXT[lang], F.col("cluster_id"),
                                                               F.col("count")).alias("explanation"))


def anomaly_text(pts: DataFrame, lang: str = "en", flag: str = "is_anomaly") -> DataFrame:
    """Count and percent sentence, or the no-anomaly sentence."""
    a = pts.agg(F.count_if(_q(flag)).alias("n"), F.count(F.lit(1)).alias("total"))
    pct = round_to(F.col("n") / F.col("total") * 100, 1).cast("string")
    return a.select(F.when(F.col("n") == 0, F.lit(NO_ANOMALY_TEXT[lang]))
                    .otherwise(F.format_string(ANOMALY_TEXT[lang], F.col("n"), pct)).alias("text"))


def dataset_summary(pts: DataFrame, reduction: str, clustering: str, seconds: float, lang: str = "en",
                    cluster: str = "cluster", flag: str = "is_anomaly") -> DataFrame:
    """Totals, clusters, anomalies and methods in one sentence."""
    a = pts.agg(F.count(F.lit(1)).alias("total"),
                F.count_distinct(F.when(_q(cluster) != -1, _q(cluster))).alias("k"),
                F.count_if(_q(flag)).alias("n_anom"))
    head = F.format_string(SUMMARY_HEAD[lang], F.col("total"), F.col("k"))
    mid = F.when(F.col("n_anom") > 0, F.format_string(SUMMARY_ANOMALIES[lang], F.col("n_anom"))).otherwise(F.lit(""))
    tail = F.format_string(SUMMARY_TAIL[lang], F.lit(f"{seconds:.1f}"), F.lit(reduction.upper()),
                           F.lit(clustering.upper()))
    return a.select(F.concat(head, mid, tail).alias("summary"))
