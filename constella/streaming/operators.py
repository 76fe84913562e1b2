"""Structured Streaming operators (T1-T7) and their batch twins.

The reference keeps these behaviours in process memory (Redis keys with a
TTL, dictionaries of connections). Here each is a streaming DataFrame
transformation with event-time semantics: a 10-minute watermark bounds the
state, rows later than the watermark are dropped, and the stateful ones keep
O(1) state per key (``applyInPandasWithState``). Each has a batch twin over
the same rows so a replay can be checked with plain SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from constella.session import settle, shared_dir

WATERMARK = "10 minutes"


# --------------------------------------------------------------- sources/sinks
def events_stream(spark, directory: str, schema: T.StructType, files: str = "*.parquet",
                  files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file stream over ``directory`` (files matching ``files``),
    with an explicit schema. Event time must be a session-zone TIMESTAMP for
    watermarks, so a TIMESTAMP_NTZ ``ts`` is cast (UTC session: same instant)."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    df = r.parquet(directory)
    if "ts" in df.columns:
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def run_available_now(df: DataFrame, name: str, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Drive a streaming query to completion over everything available and
    return its output as a table written under the shared checkpoint folder
    (each micro-batch appended as parquet by ``foreachBatch``). For update
    mode, ``key`` keeps the last version of each row."""
    spark = df.sparkSession
    out = shared_dir(spark, f"stream-{name}")
    ckpt = shared_dir(spark, f"stream-ckpt-{name}")

    def sink(batch: DataFrame, epoch: int):
        batch.withColumn("__epoch", F.lit(epoch)).write.mode("append").parquet(out)

    q = (df.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    try:
        res = spark.read.parquet(out)
    except Exception:  # noqa: BLE001 - nothing was emitted
        return spark.createDataFrame([], df.schema)
    if key:
        w = Window.partitionBy(*key).orderBy(F.desc("__epoch"))
        res = res.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return res.drop("__epoch")


# --------------------------------------------------------------- T1
LATEST_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.LongType()), T.StructField("stage", T.StringType()),
    T.StructField("progress", T.DoubleType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("expired", T.BooleanType())])
LATEST_STATE = T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType()),
                             T.StructField("stage", T.StringType()), T.StructField("progress", T.DoubleType())])


def latest_progress(stream: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """Newest (stage, progress) per dataset; an entry expires ttl seconds
    (event time) after its last update and is then emitted as expired and
    dropped from state. Output mode update; key = dataset_id."""
    ttl_ms = ttl_seconds * 1000

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            ts, eid, stage, prog = state.get
            state.remove()
            yield pd.DataFrame({"dataset_id": [key[0]], "stage": [stage], "progress": [prog], "ts": [ts],
                                "expired": [True]})
            return
        best = state.get if state.exists else None
        for pdf in pdfs:
            pdf = pdf.sort_values(["ts", "event_id"])
            last = pdf.iloc[-1]
            cand = (last["ts"], int(last["event_id"]), last["stage"], float(last["progress"]))
            if best is None or (pd.Timestamp(cand[0]), cand[1]) > (pd.Timestamp(best[0]), best[1]):
                best = cand
        state.update(best)
        state.setTimeoutTimestamp(int(pd.Timestamp(best[0]).timestamp() * 1000) + ttl_ms)
        yield pd.DataFrame({"dataset_id": [key[0]], "stage": [best[2]], "progress": [best[3]], "ts": [best[0]],
                            "expired": [False]})

    src = stream.withWatermark("ts", WATERMARK).select(
        F.col("user_id").alias("dataset_id"), "ts", "event_id", F.col("event_type").alias("stage"),
        F.col("value").alias("progress"))
    return src.groupBy("dataset_id").applyInPandasWithState(
        step, LATEST_SCHEMA, LATEST_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest_progress_batch(events: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """Batch twin: newest event per dataset; expired when it is older than
    ttl before the last event time of the whole input (the final watermark
    position without delay)."""
    end = events.agg(F.max("ts")).first()[0]
    g = events.groupBy(F.col("user_id").alias("dataset_id")).agg(
        F.max_by(F.struct("event_type", "value", "ts"), F.struct("ts", "event_id")).alias("l"))
    return g.select("dataset_id", F.col("l.event_type").alias("stage"), F.col("l.value").alias("progress"),
                    F.col("l.ts").alias("ts"),
                    (F.col("l.ts") < F.lit(end) - F.expr(f"INTERVAL {ttl_seconds} SECONDS")).alias("expired"))


# --------------------------------------------------------------- T2
def requests(events: DataFrame) -> DataFrame:
    """Requests derived from events: client IP from the user, agent from the
    event type."""
    return events.select("event_id", "ts", F.concat(F.lit("10.0."), (F.col("user_id") % 16).cast("string"))
                         .alias("ip"), F.col("event_type").alias("agent"))


def rate_limit_aligned(reqs: DataFrame, limit: int = 30, window: str = "60 seconds") -> DataFrame:
    """T2 (aligned): requests per (ip, agent) per tumbling minute; windows
    over the limit flagged. Works on a stream (append after the watermark) or
    a batch frame."""
    if reqs.isStreaming:
        reqs = reqs.withWatermark("ts", WATERMARK)
    g = reqs.groupBy("ip", "agent", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return g.select("ip", "agent", F.col("w.start").alias("window_start"), "requests",
                    (F.col("requests") > limit).alias("limited"))


RATE_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ip", T.StringType()),
                            T.StructField("agent", T.StringType()), T.StructField("window_start", T.TimestampNTZType()),
                            T.StructField("allowed", T.BooleanType())])
RATE_STATE = T.StructType([T.StructField("start", T.TimestampNTZType()), T.StructField("count", T.LongType())])


def rate_limit_exact(reqs: DataFrame, limit: int = 30, seconds: int = 60) -> DataFrame:
    """T2 (exact): the 60 s window of a key starts at its first request; up
    to ``limit`` requests are allowed in it, later ones rejected (and not
    counted); the first request after the window starts a new one. State per
    key: window start and count."""
    span = pd.Timedelta(seconds=seconds)

    def step(key, pdfs, state: GroupState):
        start, count = state.get if state.exists else (None, 0)
        start = pd.Timestamp(start) if start is not None else None
        rows = []
        for pdf in pdfs:
            for r in pdf.sort_values(["ts", "event_id"]).itertuples(index=False):
                t = pd.Timestamp(r.ts)
                if start is None or t >= start + span:
                    start, count = t, 0
                ok = count < limit
                if ok:
                    count += 1
                rows.append((r.event_id, key[0], key[1], start, ok))
        state.update((start, count))
        yield pd.DataFrame(rows, columns=["event_id", "ip", "agent", "window_start", "allowed"])

    src = reqs.withWatermark("ts", WATERMARK) if reqs.isStreaming else reqs
    return src.groupBy("ip", "agent").applyInPandasWithState(
        step, RATE_SCHEMA, RATE_STATE, "append", GroupStateTimeout.NoTimeout)


# --------------------------------------------------------------- T3
def stale_connections(pings: DataFrame, idle: str = "120 seconds") -> DataFrame:
    """A connection (per user) is closed after two idle minutes: each
    session window is one connection; it closes at its last ping + 120 s."""
    src = pings.withWatermark("ts", WATERMARK) if pings.isStreaming else pings
    g = src.groupBy("user_id", F.session_window("ts", idle).alias("s")).agg(F.count(F.lit(1)).alias("pings"))
    return g.select("user_id", F.col("s.start").alias("opened_at"), F.col("s.end").alias("closed_at"), "pings")


def stale_connections_batch(pings: DataFrame, idle_seconds: int = 120, bucket: str = "hour") -> DataFrame:
    """Batch twin of T3 without ordering a hot user in one task: gaps come
    from a lag inside (user, time bucket) windows plus the previous bucket's
    last ping; session numbers are the within-bucket running count of gaps
    >= idle plus the user's count over earlier buckets (a running sum over
    the small per-bucket table); sessions are then one grouped aggregate."""
    ev = pings.select("user_id", "ts", F.date_trunc(bucket, F.col("ts")).alias("__b"),
                      F.monotonically_increasing_id().alias("__k") if "event_id" not in pings.columns
                      else F.col("event_id").alias("__k"))
    inner = Window.partitionBy("user_id", "__b").orderBy("ts", "__k")
    ev = ev.withColumn("__prev", F.lag("ts").over(inner))
    per_b = ev.groupBy("user_id", "__b").agg(F.max("ts").alias("__last"))
    ub = Window.partitionBy("user_id").orderBy("__b")
    carry = per_b.select("user_id", "__b", F.lag("__last").over(ub).alias("__carry"))
    ev = ev.join(carry, ["user_id", "__b"], "left")
    prev = F.coalesce(F.col("__prev"), F.col("__carry"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    ev = ev.withColumn("__new", F.when(prev.isNull() | (gap >= F.lit(idle_seconds * 1_000_000)), 1).otherwise(0))
    ev = ev.withColumn("__in", F.sum("__new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    news = ev.groupBy("user_id", "__b").agg(F.sum("__new").alias("__n"))
    offs = news.select("user_id", "__b", (F.sum("__n").over(ub.rowsBetween(Window.unboundedPreceding, -1)))
                       .alias("__off"))
    ev = ev.join(offs, ["user_id", "__b"], "left").withColumn(
        "__sid", F.coalesce(F.col("__off"), F.lit(0)) + F.col("__in"))
    g = ev.groupBy("user_id", "__sid").agg(F.min("ts").alias("opened_at"), F.max("ts").alias("__end"),
                                           F.count(F.lit(1)).alias("pings"))
    return g.select("user_id", "opened_at",
                    (F.col("__end") + F.make_interval(secs=F.lit(idle_seconds))).alias("closed_at"), "pings")


# --------------------------------------------------------------- T4
def connection_stats(events: DataFrame, window: str = "1 day", exact: bool = False) -> DataFrame:
    """T4: per window total, authenticated (user known), anonymous, unique
    users and rooms (event types). The streaming form uses approximate
    distinct counts (HyperLogLog, bounded state)."""
    src = events.withWatermark("ts", WATERMARK) if events.isStreaming else events
    anon = F.col("user_id") % 3 == 0  # fixed rule: every third user connects anonymously
    distinct = F.count_distinct if exact else F.approx_count_distinct
    g = src.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("total_connections"), F.count_if(~anon).alias("authenticated"),
        F.count_if(anon).alias("anonymous"), distinct(F.when(~anon, F.col("user_id"))).alias("unique_users"),
        distinct("event_type").alias("rooms"))
    return g.select(F.col("w.start").alias("window_start"), "total_connections", "authenticated", "anonymous",
                    "unique_users", "rooms")


# --------------------------------------------------------------- T5
def watch_groups(watchers: DataFrame, chunk: int = 250_000) -> DataFrame:
    """The membership table by room, as lists: (room, group, watchers), a row
    for a room's watchers in each stretch of ``chunk`` rows. Copies and null
    ids stay; settled, so that the groups are the same whenever they are read."""
    at = F.monotonically_increasing_id()
    dealt = watchers.select("room", "watcher_id", F.floor(at / F.lit(chunk)).alias("group"))
    return settle(dealt.groupBy("room", "group").agg(F.collect_list(F.struct("watcher_id")).alias("watchers")))


def route_to_watchers(events: DataFrame, groups: DataFrame) -> DataFrame:
    """T5: deliver each dataset event to every watcher of its dataset
    (stream-static equi-join; the membership table is the static side). A
    delivery goes to a group of ``watch_groups``: (event_id, ts, room,
    event_type, group) and the columns of ``groups``; ``watchers`` of a group
    are its single receivers."""
    ev = events.select("event_id", "ts", (F.col("user_id") % 25).cast("int").alias("room"), "event_type")
    return ev.join(groups, "room")


# --------------------------------------------------------------- T6
STAGE_SCHEMA = T.StructType([T.StructField("dataset_id", T.LongType()), T.StructField("event_id", T.LongType()),
                             T.StructField("stage", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
                             T.StructField("seconds_since_previous", T.DoubleType())])
STAGE_STATE = T.StructType([T.StructField("ts", T.TimestampNTZType())])


def stage_durations(stream: DataFrame) -> DataFrame:
    """Time since the previous event of the same dataset (state: the last
    event time). Assumes per-key arrival in event-time order, as a progress
    feed is; the batch twin uses ``lag``."""

    def step(key, pdfs, state: GroupState):
        last = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        for pdf in pdfs:
            for r in pdf.sort_values(["ts", "event_id"]).itertuples(index=False):
                t = pd.Timestamp(r.ts)
                out.append((key[0], r.event_id, r.stage, t, None if last is None else (t - last).total_seconds()))
                last = t
        state.update((last,))
        yield pd.DataFrame(out, columns=["dataset_id", "event_id", "stage", "ts", "seconds_since_previous"])

    src = stream.withWatermark("ts", WATERMARK).select(
        F.col("user_id").alias("dataset_id"), "event_id", F.col("event_type").alias("stage"), "ts")
    return src.groupBy("dataset_id").applyInPandasWithState(
        step, STAGE_SCHEMA, STAGE_STATE, "append", GroupStateTimeout.NoTimeout)


def stage_durations_batch(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Batch twin of T6: time since the previous event of the same dataset.

    A dataset holding a third of all events must not be ordered in one task,
    so the lag runs inside (dataset, time bucket) windows; the first event
    of a bucket takes the last timestamp of the dataset's previous non-empty
    bucket, from a per-(dataset, bucket) aggregate (one row per bucket)."""
    ev = events.select(F.col("user_id").alias("dataset_id"), "event_id", F.col("event_type").alias("stage"), "ts",
                       F.date_trunc(bucket, F.col("ts")).alias("__b"))
    inner = Window.partitionBy("dataset_id", "__b").orderBy("ts", "event_id")
    ev = ev.withColumn("__prev", F.lag("ts").over(inner))
    last = ev.groupBy("dataset_id", "__b").agg(F.max("ts").alias("__last"))
    per_bucket = Window.partitionBy("dataset_id").orderBy("__b")
    carry = last.select("dataset_id", "__b", F.lag("__last").over(per_bucket).alias("__carry"))
    j = ev.join(carry, ["dataset_id", "__b"], "left")
    prev = F.coalesce(F.col("__prev"), F.col("__carry"))
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    return j.select("dataset_id", "event_id", "stage", "ts", (us.cast("double") / 1e6).alias("seconds_since_previous"))


# --------------------------------------------------------------- T7
def request_latency(events: DataFrame, window: str = "1 hour", exact: bool = False) -> DataFrame:
    """Per tumbling window, requests, mean / max latency and the median
    (approximate on a stream: percentile_approx keeps bounded state)."""
    src = events.withWatermark("ts", WATERMARK) if events.isStreaming else events
    aggs = [F.count(F.lit(1)).alias("requests"), F.avg("value").alias("mean_latency"),
            F.max("value").alias("max_latency")]
    if not exact:
        aggs.append(F.percentile_approx("value", 0.5).alias("median_latency"))
    g = src.groupBy(F.window("ts", window).alias("w")).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), *[c for c in g.columns if c != "w"])
