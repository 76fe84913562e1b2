"""Registered streaming queries (T1-T7): batch twins with DuckDB oracles, and
the streaming forms themselves (file source over the events table,
``availableNow`` trigger) as rows-checked queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from constella.functions.numeric import round_sql as R
from constella.functions.numeric import round_to
from constella.plans.registry import register
from constella.streaming import operators as T
from constella.streaming import ordered as O
from constella.tables import load


def _events(spark, sf):
    return load(spark, sf, "events")


def _stream(spark, sf):
    ev = _events(spark, sf)
    return T.events_stream(spark, sf, ev.schema, files="events.parquet")


def _watchers(spark, sf):
    c = load(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("watcher_id"), F.col("c_nationkey").alias("room"))


@register("t1_latest_progress",
          "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM "
          "events), m AS (SELECT max(ts) AS t FROM events) SELECT user_id AS dataset_id, event_type AS stage, "
          "value AS progress, ts, ts < t - INTERVAL 300 SECOND AS expired FROM e, m WHERE r = 1")
def t1_latest_progress(spark, sf):
    return T.latest_progress_batch(_events(spark, sf))


@register("t1_latest_progress_stream")
def t1_latest_progress_stream(spark, sf):
    out = T.run_available_now(T.latest_progress(_stream(spark, sf)), "t1", "update", key=["dataset_id"])
    return out.select("dataset_id", "stage", "progress", "ts", "expired")


@register("t2_rate_limit",
          "SELECT '10.0.' || CAST(user_id % 16 AS VARCHAR) AS ip, event_type AS agent, time_bucket(INTERVAL 60 SECOND, "
          "ts) AS window_start, count(*) AS requests, count(*) > 30 AS limited FROM events GROUP BY 1, 2, 3")
def t2_rate_limit(spark, sf):
    return T.rate_limit_aligned(T.requests(_events(spark, sf)))


@register("t2_rate_limit_stream")
def t2_rate_limit_stream(spark, sf):
    """Exact rate limiter (window anchored at each key's first request)."""
    return T.run_available_now(T.rate_limit_exact(T.requests(_stream(spark, sf))), "t2", "append")


@register("t3_stale_connections",
          "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= "
          "INTERVAL 120 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, "
          "event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED "
          "PRECEDING) AS sid FROM e) SELECT user_id, min(ts) AS opened_at, max(ts) + INTERVAL 120 SECOND AS "
          "closed_at, count(*) AS pings FROM s GROUP BY user_id, sid")
def t3_stale_connections(spark, sf):
    return T.stale_connections_batch(_events(spark, sf).select("user_id", "ts", "event_id"))


@register("t3_stale_connections_stream")
def t3_stale_connections_stream(spark, sf):
    return T.run_available_now(T.stale_connections(_stream(spark, sf).select("user_id", "ts")), "t3", "append")


@register("t4_connection_stats",
          "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS total_connections, count(*) FILTER "
          "(WHERE user_id % 3 <> 0) AS authenticated, count(*) FILTER (WHERE user_id % 3 = 0) AS anonymous, "
          "count(DISTINCT CASE WHEN user_id % 3 <> 0 THEN user_id END) AS unique_users, count(DISTINCT event_type) "
          "AS rooms FROM events GROUP BY 1")
def t4_connection_stats(spark, sf):
    return T.connection_stats(_events(spark, sf), exact=True)


@register("t4_connection_stats_stream")
def t4_connection_stats_stream(spark, sf):
    return T.run_available_now(T.connection_stats(_stream(spark, sf)), "t4", "append")


@register("t5_route_to_watchers",
          "SELECT e.event_id, count(*) AS n_watchers FROM events e JOIN customer c ON c.c_nationkey = "
          "CAST(e.user_id % 25 AS INTEGER) GROUP BY e.event_id")
def t5_route_to_watchers(spark, sf):
    d = T.route_to_watchers(_events(spark, sf), T.watch_groups(_watchers(spark, sf)))
    return d.groupBy("event_id").agg(F.sum(F.size("watchers")).alias("n_watchers"))


@register("t5_route_to_watchers_stream")
def t5_route_to_watchers_stream(spark, sf):
    """The stream writes a row an event and group; the group's list is joined
    to it again to count its watchers."""
    groups = T.watch_groups(_watchers(spark, sf))
    d = T.run_available_now(T.route_to_watchers(_stream(spark, sf), groups.select("room", "group")), "t5", "append")
    received = d.select("event_id", "room", "group").join(groups, ["room", "group"])
    return received.groupBy("event_id").agg(F.sum(F.size("watchers")).alias("n_watchers"))


@register("t6_stage_durations",
          "SELECT user_id AS dataset_id, event_id, event_type AS stage, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER "
          "(PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS seconds_since_previous FROM events")
def t6_stage_durations(spark, sf):
    return T.stage_durations_batch(_events(spark, sf))


@register("t6_stage_durations_stream")
def t6_stage_durations_stream(spark, sf):
    return T.run_available_now(T.stage_durations(_stream(spark, sf)), "t6", "append")


@register("t7_request_latency",
          f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS requests, {R('avg(value)')} AS "
          "mean_latency, max(value) AS max_latency FROM events GROUP BY 1")
def t7_request_latency(spark, sf):
    r = T.request_latency(_events(spark, sf), exact=True)
    return r.select("window_start", "requests", round_to("mean_latency").alias("mean_latency"), "max_latency")


@register("t7_request_latency_stream")
def t7_request_latency_stream(spark, sf):
    return T.run_available_now(T.request_latency(_stream(spark, sf)), "t7", "append")


# ---------------------------------------------- streams equal to their batch twins
def _requests(stream):
    return T.requests(stream).where("event_id IS NOT NULL OR ts >= '2200-01-01'")


_LIMIT = ("WITH RECURSIVE r AS (SELECT event_id, ts, '10.0.' || CAST(user_id % 16 AS VARCHAR) AS ip, event_type AS agent, "
          "row_number() OVER (PARTITION BY user_id % 16, event_type ORDER BY ts, event_id) AS k FROM events), "
          "w AS (SELECT event_id, ts, ip, agent, k, ts AS window_start, 1 AS seen FROM r WHERE k = 1 UNION ALL "
          "SELECT r.event_id, r.ts, r.ip, r.agent, r.k, CASE WHEN r.ts >= w.window_start + INTERVAL 6 HOUR THEN r.ts ELSE w.window_start END, "
          "CASE WHEN r.ts >= w.window_start + INTERVAL 6 HOUR THEN 1 ELSE w.seen + 1 END "
          "FROM w JOIN r ON r.ip = w.ip AND r.agent = w.agent AND r.k = w.k + 1) "
          "SELECT event_id, ip, agent, window_start, seen <= 2 AS allowed FROM w")


@register("t2_rate_limit_in_order", _LIMIT)
def t2_rate_limit_in_order(spark, sf):
    """The exact limiter (2 requests in 6 hours from the first) as a stream."""
    return O.run_to_end(_stream(spark, sf), lambda s: O.rate_limit(_requests(s), 2, 6 * 3600), "t2-order")


@register("t3_stale_connections_to_end",
          "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= "
          "INTERVAL 120 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, "
          "event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED "
          "PRECEDING) AS sid FROM e) SELECT user_id, min(ts) AS opened_at, max(ts) + INTERVAL 120 SECOND AS "
          "closed_at, count(*) AS pings FROM s GROUP BY user_id, sid")
def t3_stale_connections_to_end(spark, sf):
    return O.run_to_end(_stream(spark, sf), lambda s: T.stale_connections(s.select("user_id", "ts")), "t3-end")


@register("t4_connection_stats_exact_stream",
          "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS total_connections, count(*) FILTER "
          "(WHERE user_id % 3 <> 0) AS authenticated, count(*) FILTER (WHERE user_id % 3 = 0) AS anonymous, "
          "count(DISTINCT CASE WHEN user_id % 3 <> 0 THEN user_id END) AS unique_users, count(DISTINCT event_type) "
          "AS rooms FROM events GROUP BY 1")
def t4_connection_stats_exact_stream(spark, sf):
    return O.run_to_end(_stream(spark, sf), O.connection_stats, "t4-end")


_ROOMS = ("WITH a AS (SELECT user_id, ts, event_id, event_type = 'signup' AS joins, lead(ts) OVER w AS nts, lead(event_id) OVER w AS nid "
          "FROM events WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
          "SELECT e.event_id, e.user_id % 25 AS room, a.user_id AS watcher_id FROM events e JOIN a ON a.user_id % 25 = e.user_id % 25 "
          "AND a.joins AND (a.ts < e.ts OR (a.ts = e.ts AND a.event_id < e.event_id)) AND (a.nts IS NULL OR e.ts < a.nts OR "
          "(e.ts = a.nts AND e.event_id < a.nid)) WHERE e.event_type NOT IN ('signup', 'error')")


def _rooms(events):
    """signup joins the room, error leaves it, all else is a message to it."""
    room = (F.col("user_id") % 25).cast("long").alias("room")
    acts = F.col("event_type").isin("signup", "error")
    return (events.where(acts | F.col("event_type").isNull()).select(
        "event_id", "ts", room, F.col("user_id").alias("watcher_id"), (F.col("event_type") == "signup").alias("joins")),
        events.where(~acts | F.col("event_type").isNull()).select("event_id", "ts", room))


@register("t5_room_deliveries", _ROOMS)
def t5_room_deliveries(spark, sf):
    return O.room_deliveries_batch(*_rooms(_events(spark, sf)))


@register("t5_room_deliveries_stream", _ROOMS)
def t5_room_deliveries_stream(spark, sf):
    """The stream writes blocks of messages and the stays beside them; they are
    made into deliveries as they are read."""
    return O.unpacked(O.run_to_end(_stream(spark, sf), lambda s: O.room_deliveries(*_rooms(s), packed=True), "t5-rooms"))


@register("t6_stage_durations_in_order",
          "WITH d AS (SELECT user_id AS dataset_id, event_id, event_type AS stage, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER "
          "(PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS s FROM events) SELECT dataset_id, event_id, stage, ts, "
          "CASE WHEN s <= 43200 THEN s END AS seconds_since_previous FROM d")
def t6_stage_durations_in_order(spark, sf):
    return O.run_to_end(_stream(spark, sf), lambda s: O.stage_durations(s, 43_200), "t6-order")


@register("t7_request_latency_to_end",
          f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS requests, {R('avg(value)')} AS "
          "mean_latency, max(value) AS max_latency, quantile_disc(value, 0.5) AS median_latency FROM events GROUP BY 1")
def t7_request_latency_to_end(spark, sf):
    r = O.run_to_end(_stream(spark, sf), T.request_latency, "t7-end")
    return r.select("window_start", "requests", round_to("mean_latency").alias("mean_latency"), "max_latency", "median_latency")
