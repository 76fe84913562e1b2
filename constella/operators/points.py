"""Point-cloud operators (G1-G13, N1, N2): the client's per-frame work
re-aimed as table operators over (point_id, x, y, z, size, color, cluster,
is_anomaly). Camera and viewport are small parameter objects turned into
literals; every operator is a projection, filter or grouped aggregate."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constella.functions.scalars import hsl_palette_color

FOCAL_LENGTH = 400.0  # fixed value of the client's perspective projection


@dataclass(frozen=True)
class Camera:
    position: tuple[float, float, float] = (0.0, 0.0, -10.0)
    rotation: tuple[float, float, float] = (0.0, 0.0, 0.0)
    zoom: float = 50.0


@dataclass(frozen=True)
class Viewport:
    width: float = 800.0
    height: float = 600.0


def _lit(v: float) -> Column:
    return F.lit(float(v))


def camera_distance(cam: Camera) -> Column:
    px, py, pz = cam.position
    return F.sqrt((F.col("x") - _lit(px)) ** 2 + (F.col("y") - _lit(py)) ** 2 + (F.col("z") - _lit(pz)) ** 2)


def project(points: DataFrame, cam: Camera, vp: Viewport) -> DataFrame:
    """Translate, rotate about Y, X, Z, perspective (focal 400), screen
    x/y and size max(1, size * perspective * zoom)."""
    px, py, pz = cam.position
    rx, ry, rz = cam.rotation
    cx, sx_, cy, sy_, cz, sz_ = (math.cos(rx), math.sin(rx), math.cos(ry), math.sin(ry), math.cos(rz),
                                 math.sin(rz))
    x = F.col("x") - _lit(px)
    y = F.col("y") - _lit(py)
    z = F.col("z") - _lit(pz)
    x1 = x * _lit(cy) - z * _lit(sy_)
    z1 = x * _lit(sy_) + z * _lit(cy)
    y2 = y * _lit(cx) - z1 * _lit(sx_)
    z2 = y * _lit(sx_) + z1 * _lit(cx)
    x3 = x1 * _lit(cz) - y2 * _lit(sz_)
    y3 = x1 * _lit(sz_) + y2 * _lit(cz)
    persp = _lit(FOCAL_LENGTH) / (_lit(FOCAL_LENGTH) + z2)
    size = F.coalesce(F.col("size"), F.lit(4.0)) if "size" in points.columns else F.lit(4.0)
    return points.select("*", (x3 * persp * _lit(cam.zoom) + _lit(vp.width / 2)).alias("screen_x"),
                         (-y3 * persp * _lit(cam.zoom) + _lit(vp.height / 2)).alias("screen_y"),
                         z2.alias("depth"),
                         F.greatest(F.lit(1.0), size * persp * _lit(cam.zoom)).alias("screen_size"))


def cull(projected: DataFrame, cam: Camera, vp: Viewport, margin: float = 50.0) -> DataFrame:
    """Within 1000 / zoom of the camera and within the screen +- margin."""
    near = camera_distance(cam) <= _lit(1000.0 / cam.zoom)
    on_screen = (F.col("screen_x").between(-margin, vp.width + margin)
                 & F.col("screen_y").between(-margin, vp.height + margin))
    return projected.where(near & on_screen)


def lod(points: DataFrame, cam: Camera, smooth: bool = False, max_distance: float = 1000.0) -> DataFrame:
    """Steps 1 / 0.5 / 0.25 at distances 100 and 300, or the smooth
    variant max(0.1, 1 - 0.9 * min(d / max, 1))."""
    d = camera_distance(cam)
    if smooth:
        level = F.greatest(F.lit(0.1), F.lit(1.0) - F.least(d / _lit(max_distance), F.lit(1.0)) * 0.9)
    else:
        level = F.when(d < 100, 1.0).when(d < 300, 0.5).otherwise(0.25)
    return points.withColumn("lod_level", level)


def render_table(points: DataFrame, cam: Camera, vp: Viewport) -> DataFrame:
    """Project, cull, LOD-scale sizes: the rows a frame would draw."""
    p = lod(cull(project(points, cam, vp), cam, vp), cam)
    return p.withColumn("screen_size", F.col("screen_size") * F.col("lod_level"))


def depth_order(projected: DataFrame) -> DataFrame:
    """Back to front (ascending depth), ties by point id."""
    return projected.orderBy("depth", "point_id")


def batches(projected: DataFrame) -> DataFrame:
    """Draw batches keyed by colour, rounded size and anomaly flag."""
    key = F.concat_ws("-", F.col("color"), F.floor(F.col("screen_size") + 0.5).cast("bigint").cast("string"),
                      F.when(F.col("is_anomaly"), "anomaly").otherwise("normal"))
    return projected.groupBy(key.alias("batch_key")).agg(F.count(F.lit(1)).alias("n_points"))


def cluster_links(projected: DataFrame, max_connections: int = 15, max_px: float = 150.0) -> DataFrame:
    """Within each cluster of >= 2 points (null and -1 are unclustered),
    the first ``max_connections`` points link to their min(2, floor(max /
    size)) nearest cluster members on screen when closer than 150 px.

    Clusters larger than ``max_connections`` get zero links per point, so they
    are dropped before the join: the pair join only touches clusters of at
    most 15 points (at most 15 x 15 pairs each), whatever the data size."""
    clustered = projected.where(F.col("cluster").isNotNull() & (F.col("cluster") != -1))
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    per_point = F.least(F.lit(2), F.floor(F.lit(max_connections) / F.col("n")))
    small = sizes.where((F.col("n") >= 2) & (per_point > 0)).select("cluster", per_point.alias("per_point"))
    members = clustered.join(small, "cluster", "left_semi")  # rows of small clusters only
    w = Window.partitionBy("cluster").orderBy("point_id")
    firsts = members.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max_connections)
    a = firsts.select("cluster", F.col("point_id").alias("src"), F.col("screen_x").alias("ax"),
                      F.col("screen_y").alias("ay"))
    b = members.select("cluster", F.col("point_id").alias("dst"), F.col("screen_x").alias("bx"),
                       F.col("screen_y").alias("by"))
    pairs = a.join(b, "cluster").where(F.col("src") != F.col("dst")).join(small, "cluster")
    dist = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    w2 = Window.partitionBy("cluster", "src").orderBy("distance", "dst")
    ranked = pairs.withColumn("distance", dist).withColumn("r", F.row_number().over(w2))
    return ranked.where((F.col("r") <= F.col("per_point")) & (F.col("distance") < max_px)).select(
        "cluster", "src", "dst", "distance")


def pick(points: DataFrame, cam: Camera, vp: Viewport, sx: float, sy: float, radius: float = 10.0) -> DataFrame:
    """The in-front point (depth <= 0) under the cursor with the smallest
    depth; the pick area grows with the point size."""
    p = project(points, cam, vp)
    d = F.sqrt((F.col("screen_x") - _lit(sx)) ** 2 + (F.col("screen_y") - _lit(sy)) ** 2)
    size = F.coalesce(F.col("size"), F.lit(4.0)) if "size" in points.columns else F.lit(4.0)
    eff = _lit(radius) + F.greatest(F.lit(4.0), size * _lit(cam.zoom))
    return p.where((F.col("depth") <= 0) & (d <= eff)).orderBy("depth", "point_id").limit(1)


def selection_info(selected: DataFrame) -> DataFrame:
    """Selected count and distinct clusters represented."""
    return selected.agg(F.count(F.lit(1)).alias("selected_count"),
                        F.countDistinct("cluster").alias("clusters_represented"))


def legend_stats(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per cluster points and anomalies (largest first) and totals;
    only null and -1 count as unclustered."""
    per = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("point_count"),
                                        F.count_if("is_anomaly").alias("anomaly_count"))
    totals = points.agg(F.count(F.lit(1)).alias("total_points"), F.count_if("is_anomaly").alias("total_anomalies"),
                        F.count_if(F.col("cluster").isNotNull() & (F.col("cluster") != -1)).alias("clustered_points"))
    return per.orderBy(F.desc("point_count"), F.asc("cluster")), totals


def top_clusters(points: DataFrame, k: int = 5) -> DataFrame:
    """The k largest clusters."""
    per = points.where(F.col("cluster").isNotNull() & (F.col("cluster") != -1)).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("point_count"))
    return per.orderBy(F.desc("point_count"), F.asc("cluster")).limit(k)


def minimap(points: DataFrame, pixels: int = 128, extent: float = 100.0) -> DataFrame:
    """X and z from [-extent, extent] to a pixels x pixels map, counted
    per pixel."""
    mx = (F.col("x") + extent) / (2 * extent) * pixels
    my = (F.col("z") + extent) / (2 * extent) * pixels
    return points.groupBy(F.floor(mx).alias("px"), F.floor(my).alias("py")).agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if("is_anomaly").alias("n_anomalies"))


def cluster_info(points: DataFrame) -> DataFrame:
    """Per cluster id i (0..k-1): label 'Cluster i+1', hsl colour of i
    among k, count, centroid; variance (mean squared distance to the
    centroid) and density (count / (1 + variance)) are computed here where the
    client left them 0."""
    pts = points.where(F.col("cluster").isNotNull() & (F.col("cluster") != -1))
    g = pts.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("count"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"),
        (F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("variance"))
    k = g.count()
    return g.select(F.col("cluster").alias("id"),
                    F.concat(F.lit("Cluster "), (F.col("cluster") + 1).cast("string")).alias("label"),
                    hsl_palette_color(F.col("cluster"), F.lit(k)).alias("color"), "count", "cx", "cy", "cz",
                    "variance", (F.col("count") / (1 + F.col("variance"))).alias("density"))


def bounding_box(points: DataFrame) -> DataFrame:
    """G1: min, max, centre and size per axis; an empty table gives zeros."""
    a = points.agg(*[F.min(c).alias(f"min_{c}") for c in "xyz"], *[F.max(c).alias(f"max_{c}") for c in "xyz"])
    cols = []
    for c in "xyz":
        lo, hi = F.coalesce(F.col(f"min_{c}"), F.lit(0.0)), F.coalesce(F.col(f"max_{c}"), F.lit(0.0))
        cols += [lo.alias(f"min_{c}"), hi.alias(f"max_{c}"), ((lo + hi) / 2).alias(f"center_{c}"),
                 (hi - lo).alias(f"size_{c}")]
    return a.select(*cols)


def distance3d(ax, ay, az, bx, by, bz) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt((ax - bx) ** 2 + (ay - by) ** 2 + (az - bz) ** 2)


def nearest(points: DataFrame, point_id, k: int = 5, max_distance: float = 100.0,
            id_col: str = "point_id") -> DataFrame:
    """The k nearest points within max_distance of one point, itself
    excluded (one filter + a top-k: linear, no join)."""
    me = points.where(F.col(id_col) == point_id).select("x", "y", "z").first()
    if me is None:
        return points.limit(0).withColumn("distance", F.lit(None).cast("double"))
    d = distance3d(F.col("x"), F.col("y"), F.col("z"), _lit(me["x"]), _lit(me["y"]), _lit(me["z"]))
    return (points.where(F.col(id_col) != point_id).withColumn("distance", d)
            .where(F.col("distance") <= max_distance).orderBy("distance", id_col).limit(k))
