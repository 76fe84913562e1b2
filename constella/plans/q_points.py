"""Registered point-cloud queries (G1-G13, N1, N2) and their oracles. The
input is the R1 point table (3-D cloud, labels, anomalies, colours, sizes)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from constella.functions.numeric import round_sql as R
from constella.functions.numeric import round_to
from constella.operators import points as G
from constella.plans.q_assemble import _POINTS_SQL, _points
from constella.plans.registry import register
from constella.tables import with_fixtures

CAM = G.Camera(position=(0.0, 0.0, -10.0), rotation=(0.3, 0.5, 0.1), zoom=50.0)
VP = G.Viewport(800.0, 600.0)


def _pts(spark, sf):
    return _points(spark, sf).select("point_id", "x", "y", "z", "cluster", "is_anomaly", "color", "size")


def _proj_sql(cam=CAM, vp=VP) -> str:
    px, py, pz = cam.position
    rx, ry, rz = cam.rotation
    c = {k: repr(v) for k, v in dict(cx=math.cos(rx), sx=math.sin(rx), cy=math.cos(ry), sy=math.sin(ry),
                                     cz=math.cos(rz), sz=math.sin(rz)).items()}
    return (
        f"t0 AS (SELECT *, x - ({px}) AS tx, y - ({py}) AS ty, z - ({pz}) AS tz FROM dec), "
        f"t1 AS (SELECT *, tx * {c['cy']} - tz * {c['sy']} AS x1, tx * {c['sy']} + tz * {c['cy']} AS z1 FROM t0), "
        f"t2 AS (SELECT *, ty * {c['cx']} - z1 * {c['sx']} AS y2, ty * {c['sx']} + z1 * {c['cx']} AS z2 FROM t1), "
        f"t3 AS (SELECT *, x1 * {c['cz']} - y2 * {c['sz']} AS x3, x1 * {c['sz']} + y2 * {c['cz']} AS y3, "
        f"400.0 / (400.0 + z2) AS persp FROM t2), "
        f"proj AS (SELECT point_id, x, y, z, cluster, is_anomaly, color, size, "
        f"x3 * persp * {cam.zoom} + {vp.width / 2} AS screen_x, -y3 * persp * {cam.zoom} + {vp.height / 2} AS screen_y, "
        f"z2 AS depth, greatest(1.0, coalesce(size, 4.0) * persp * {cam.zoom}) AS screen_size, "
        f"sqrt((x - ({px})) * (x - ({px})) + (y - ({py})) * (y - ({py})) + (z - ({pz})) * (z - ({pz}))) AS cam_d "
        "FROM t3)")


def _base(body: str, cam=CAM) -> str:
    return with_fixtures(_POINTS_SQL + ", " + _proj_sql(cam) + " " + body, "labelled_points")


# a camera behind the cloud looking back: points sit at depth <= 0 (in front)
CAM_PICK = G.Camera(position=(0.0, 0.0, 10.0), rotation=(0.0, 0.0, 0.0), zoom=50.0)


RP = ["screen_x", "screen_y", "depth", "screen_size"]


@register("g1_bounding_box", with_fixtures(
    _POINTS_SQL + " SELECT " + ", ".join(
        f"coalesce(min({c}), 0.0) AS min_{c}, coalesce(max({c}), 0.0) AS max_{c}, "
        f"{R(f'(coalesce(min({c}), 0.0) + coalesce(max({c}), 0.0)) / 2')} AS center_{c}, "
        f"{R(f'coalesce(max({c}), 0.0) - coalesce(min({c}), 0.0)')} AS size_{c}" for c in "xyz") + " FROM dec",
    "labelled_points"))
def g1_bounding_box(spark, sf):
    b = G.bounding_box(_pts(spark, sf))
    return b.select(*[(round_to(c).alias(c) if c.startswith(("center", "size")) else F.col(c)) for c in b.columns])


@register("g2_project", _base("SELECT point_id, " + ", ".join(f"{R(c)} AS {c}" for c in RP) + " FROM proj"))
def g2_project(spark, sf):
    p = G.project(_pts(spark, sf), CAM, VP)
    return p.select("point_id", *[round_to(c).alias(c) for c in RP])


@register("g3_cull", _base(f"SELECT point_id FROM proj WHERE cam_d <= {1000.0 / CAM.zoom} AND screen_x BETWEEN -50 "
                           f"AND {VP.width + 50} AND screen_y BETWEEN -50 AND {VP.height + 50}"))
def g3_cull(spark, sf):
    return G.cull(G.project(_pts(spark, sf), CAM, VP), CAM, VP).select("point_id")


@register("g4_lod", _base("SELECT point_id, CAST(CASE WHEN cam_d < 100 THEN 1.0 WHEN cam_d < 300 THEN 0.5 ELSE 0.25 "
                          f"END AS DOUBLE) AS lod_level, {R('greatest(0.1, 1.0 - least(cam_d / 12.0, 1.0) * 0.9)')} AS lod_smooth "
                          "FROM proj"))
def g4_lod(spark, sf):
    cam_near = G.Camera(CAM.position, CAM.rotation, CAM.zoom)
    p = G.lod(_pts(spark, sf), cam_near)
    s = G.lod(_pts(spark, sf), cam_near, smooth=True, max_distance=12.0).select(
        "point_id", F.col("lod_level").alias("lod_smooth"))
    return p.select("point_id", "lod_level").join(s, "point_id").select(
        "point_id", "lod_level", round_to("lod_smooth").alias("lod_smooth"))


@register("g5_depth_order", _base(f"SELECT point_id, {R('depth')} AS depth, CAST(row_number() OVER (ORDER BY depth, "
                                  "point_id) AS INTEGER) AS draw_order FROM proj"))
def g5_depth_order(spark, sf):
    from constella.functions.ordering import global_row_number

    p = G.project(_pts(spark, sf), CAM, VP)
    # the draw order as an exact global row number: range-partitioned on
    # (depth, point_id), numbered per partition plus the partition's offset
    o = global_row_number(p.select("point_id", "depth"), ["depth", "point_id"], "draw_order")
    return o.select("point_id", round_to("depth").alias("depth"), F.col("draw_order").cast("int").alias("draw_order"))


@register("g6_batches", _base(
    "SELECT color || '-' || CAST(CAST(floor(screen_size + 0.5) AS BIGINT) AS VARCHAR) || '-' || CASE WHEN is_anomaly "
    "THEN 'anomaly' ELSE 'normal' END AS batch_key, count(*) AS n_points FROM proj GROUP BY 1"))
def g6_batches(spark, sf):
    return G.batches(G.project(_pts(spark, sf), CAM, VP))


@register("g7_cluster_links", _base(
    ", p AS (SELECT point_id, row_id_mod AS cluster, screen_x, screen_y FROM (SELECT *, point_id % 97 AS row_id_mod "
    "FROM proj)), sz AS (SELECT cluster, count(*) AS n FROM p GROUP BY cluster), sm AS (SELECT cluster, "
    "least(2, floor(15 / n)) AS per_point FROM sz WHERE n >= 2 AND least(2, floor(15 / n)) > 0), "
    "f AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.cluster ORDER BY point_id) AS pos FROM p "
    "WHERE cluster IN (SELECT cluster FROM sm)) WHERE pos <= 15), pr AS (SELECT a.cluster, a.point_id AS src, "
    "b.point_id AS dst, sqrt((a.screen_x - b.screen_x) * (a.screen_x - b.screen_x) + (a.screen_y - b.screen_y) * "
    "(a.screen_y - b.screen_y)) AS distance, sm.per_point FROM f a JOIN p b ON a.cluster = b.cluster AND "
    "a.point_id <> b.point_id JOIN sm ON sm.cluster = a.cluster), rk AS (SELECT *, row_number() OVER (PARTITION BY "
    f"cluster, src ORDER BY distance, dst) AS r FROM pr) SELECT cluster, src, dst, {R('distance')} AS distance "
    "FROM rk WHERE r <= per_point AND distance < 150"))
def g7_cluster_links(spark, sf):
    p = G.project(_pts(spark, sf), CAM, VP).withColumn("cluster", (F.col("point_id") % 97).cast("int"))
    links = G.cluster_links(p)
    return links.select(F.col("cluster").cast("bigint").alias("cluster"), "src", "dst",
                        round_to("distance").alias("distance"))


@register("g8_pick", _base("SELECT point_id FROM proj WHERE depth <= 0 AND sqrt((screen_x - 400) * (screen_x - 400) + "
                           "(screen_y - 300) * (screen_y - 300)) <= 10 + greatest(4, coalesce(size, 4.0) * 50.0) "
                           "ORDER BY depth, point_id LIMIT 1", CAM_PICK))
def g8_pick(spark, sf):
    return G.pick(_pts(spark, sf), CAM_PICK, VP, 400.0, 300.0, 10.0).select("point_id")


@register("g9_selection_info", _base("SELECT count(*) AS selected_count, count(DISTINCT cluster) AS "
                                     "clusters_represented FROM proj WHERE screen_x BETWEEN 300 AND 500 AND screen_y "
                                     "BETWEEN 200 AND 400"))
def g9_selection_info(spark, sf):
    p = G.project(_pts(spark, sf), CAM, VP)
    return G.selection_info(p.where(F.col("screen_x").between(300, 500) & F.col("screen_y").between(200, 400)))


@register("g10_legend_stats", with_fixtures(
    _POINTS_SQL + " SELECT cluster, count(*) AS point_count, count(*) FILTER (WHERE is_anomaly) AS anomaly_count, "
    "CAST(sum(count(*)) OVER () AS BIGINT) AS total_points, CAST(sum(count(*) FILTER (WHERE is_anomaly)) OVER () "
    "AS BIGINT) AS total_anomalies, CAST(sum(count(*) FILTER (WHERE cluster IS NOT NULL AND cluster <> -1)) OVER () "
    "AS BIGINT) AS clustered_points FROM dec "
    "GROUP BY cluster", "labelled_points"))
def g10_legend_stats(spark, sf):
    per, totals = G.legend_stats(_pts(spark, sf))
    t = totals.first()
    return per.select("cluster", "point_count", "anomaly_count",
                      *[F.lit(t[c]).cast("bigint").alias(c) for c in ("total_points", "total_anomalies",
                                                                       "clustered_points")])


@register("g11_top_clusters", with_fixtures(
    _POINTS_SQL + " SELECT cluster, count(*) AS point_count FROM dec WHERE cluster IS NOT NULL AND cluster <> -1 "
    "GROUP BY cluster ORDER BY point_count DESC, cluster LIMIT 5", "labelled_points"))
def g11_top_clusters(spark, sf):
    return G.top_clusters(_pts(spark, sf), 5)


@register("g12_minimap", with_fixtures(
    _POINTS_SQL + " SELECT CAST(floor((x * 40 + 100) / 200 * 128) AS BIGINT) AS px, CAST(floor((z * 40 + 100) / 200 * "
    "128) AS BIGINT) AS py, count(*) AS n_points, count(*) FILTER (WHERE is_anomaly) AS n_anomalies FROM dec "
    "GROUP BY 1, 2", "labelled_points"))
def g12_minimap(spark, sf):
    # the cloud spans about [-2.5, 2.5]; scaled x40 to fill the [-100, 100] map
    p = _pts(spark, sf).withColumn("x", F.col("x") * 40).withColumn("z", F.col("z") * 40)
    return G.minimap(p)


@register("g13_cluster_info", with_fixtures(
    _POINTS_SQL + ", g AS (SELECT cluster, count(*) AS count, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, "
    "var_pop(x) + var_pop(y) + var_pop(z) AS variance FROM dec WHERE cluster IS NOT NULL AND cluster <> -1 "
    "GROUP BY cluster) SELECT cluster AS id, 'Cluster ' || CAST(cluster + 1 AS VARCHAR) AS label, 'hsl(' || "
    "CASE WHEN cluster * 360.0 / (SELECT count(*) FROM g) = floor(cluster * 360.0 / (SELECT count(*) FROM g)) "
    "THEN CAST(CAST(floor(cluster * 360.0 / (SELECT count(*) FROM g)) AS BIGINT) AS VARCHAR) ELSE "
    "CAST(cluster * 360.0 / (SELECT count(*) FROM g) AS VARCHAR) END || ', 70%, 60%)' AS color, count, "
    f"{R('cx')} AS cx, {R('cy')} AS cy, {R('cz')} AS cz, {R('variance')} AS variance, "
    f"{R('count / (1 + variance)')} AS density FROM g", "labelled_points"))
def g13_cluster_info(spark, sf):
    g = G.cluster_info(_pts(spark, sf))
    return g.select("id", "label", "color", "count",
                    *[round_to(c).alias(c) for c in ("cx", "cy", "cz", "variance", "density")])


@register("n1_distance3d", with_fixtures(
    "WITH c AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM labelled_points GROUP BY cluster) "
    f"SELECT p.row_id, {R('sqrt((p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy) + (p.z - c.cz) * (p.z - c.cz))')} "
    "AS distance FROM labelled_points p JOIN c USING (cluster)", "labelled_points"))
def n1_distance3d(spark, sf):
    from constella.tables import labelled_points

    lp = labelled_points(spark, sf)
    c = lp.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    j = lp.join(c, "cluster")  # k centre rows: AQE broadcasts them
    d = G.distance3d(F.col("x"), F.col("y"), F.col("z"), F.col("cx"), F.col("cy"), F.col("cz"))
    return j.select("row_id", round_to(d).alias("distance"))


@register("n2_nearest", with_fixtures(
    "WITH me AS (SELECT x AS mx, y AS my, z AS mz FROM labelled_points WHERE row_id = 0) SELECT row_id AS point_id, "
    f"{R('sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))')} AS distance FROM labelled_points, me "
    "WHERE row_id <> 0 AND sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) <= 1.0 "
    "ORDER BY sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), row_id LIMIT 5",
    "labelled_points"))
def n2_nearest(spark, sf):
    from constella.tables import labelled_points

    lp = labelled_points(spark, sf).withColumnRenamed("row_id", "point_id")
    return G.nearest(lp, 0, k=5, max_distance=1.0).select("point_id", round_to("distance").alias("distance"))
