"""Catalogue queries (J1-J12, F3-F10, P10) over users, datasets, sessions
and visualisations.

Joins are declared and left to Catalyst/AQE (broadcast when a side is
measured small at runtime, sort-merge otherwise, skew splitting on). Where
the reference compares rows pairwise (same device), the relation is rewritten
as grouped counts so no pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# J1
def owned(users: DataFrame, datasets: DataFrame, how: str = "inner") -> DataFrame:
    return users.join(datasets, "user_id", how)


# J2
def with_parent(datasets: DataFrame) -> DataFrame:
    parents = datasets.select(F.col("dataset_id").alias("parent_id"), F.col("name").alias("parent_name"),
                              F.col("version").alias("parent_version"))
    return datasets.join(parents, "parent_id", "left")


def chain_depth(datasets: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Number of ancestors of each dataset by pointer jumping: each round
    joins the (id, pointer, hops) table with itself, doubling the reach, so a
    chain of length L needs log2(L) joins. Lineage is cut every 4 rounds. A
    chain that ends in a cycle raises: it outlasts the number of datasets."""
    from constella.session import cut_lineage

    cur = datasets.select("dataset_id", F.col("parent_id").alias("ptr"),
                          F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("bigint").alias("hops"))
    n = datasets.count()
    for r in range(max_rounds):
        nxt = cur.alias("a").join(cur.alias("b"), F.col("a.ptr") == F.col("b.dataset_id"), "left").select(
            F.col("a.dataset_id"), F.col("b.ptr").alias("ptr"),
            (F.col("a.hops") + F.coalesce(F.col("b.hops"), F.lit(0))).alias("hops"))
        cur = nxt
        if r % 4 == 3:
            cur = cut_lineage(cur)
        if cur.where(F.col("ptr").isNotNull()).limit(1).count() == 0:
            return cur.select("dataset_id", F.col("hops").alias("depth"))
        if 2 ** (r + 1) > n:
            raise RuntimeError("the parents of some datasets form a cycle")
    raise RuntimeError(f"chains still open after {max_rounds} rounds; raise max_rounds")


# J3
def same_device_counts(sessions: DataFrame) -> DataFrame:
    """Per session, how many *other* sessions come from the same device: same
    fingerprint OR (same IP AND same user agent). Inclusion-exclusion over
    three grouped counts (fingerprint; ip+agent; all three) replaces the
    pairwise comparison, so the work is linear even when one device owns a
    third of all sessions. A session without device information matches
    nothing."""
    fp = F.col("device_fingerprint")
    has = fp.isNotNull()
    by_fp = sessions.where(has).groupBy("device_fingerprint").agg(F.count(F.lit(1)).alias("n_fp"))
    by_ia = sessions.where(has).groupBy("ip_address", "user_agent").agg(F.count(F.lit(1)).alias("n_ia"))
    by_all = sessions.where(has).groupBy("device_fingerprint", "ip_address", "user_agent").agg(
        F.count(F.lit(1)).alias("n_all"))
    s = (sessions.join(by_fp, "device_fingerprint", "left")
         .join(by_ia, ["ip_address", "user_agent"], "left")
         .join(by_all, ["device_fingerprint", "ip_address", "user_agent"], "left"))
    n = F.coalesce(F.col("n_fp"), F.lit(0)) + F.coalesce(F.col("n_ia"), F.lit(0)) \
        - F.coalesce(F.col("n_all"), F.lit(0)) - 1
    return s.select("session_id", "user_id", F.when(has, n).otherwise(F.lit(0)).cast("bigint")
                    .alias("same_device_sessions"))


def same_device_as(sessions: DataFrame, session_id: int) -> DataFrame:
    """Sessions from the same device as one given session (a filter on its
    keys: no join against the whole table)."""
    me = sessions.where(F.col("session_id") == session_id).select(
        "device_fingerprint", "ip_address", "user_agent").first()
    if me is None or me["device_fingerprint"] is None:
        return sessions.limit(0)
    cond = (F.col("device_fingerprint") == me["device_fingerprint"]) | (
        (F.col("ip_address") == me["ip_address"]) & (F.col("user_agent") == me["user_agent"]))
    return sessions.where(F.col("device_fingerprint").isNotNull() & cond & (F.col("session_id") != session_id))


# J4
def accessible(datasets: DataFrame, users: DataFrame) -> DataFrame:
    """Datasets owned by an active user (left semi join)."""
    return datasets.join(users.where("is_active").select("user_id"), "user_id", "left_semi")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed (left anti join)."""
    return rows.join(ids.select(key), key, "left_anti")


# J5
def user_stats(users: DataFrame, datasets: DataFrame, visualizations: DataFrame, sessions: DataFrame,
               now: str) -> DataFrame:
    """Per user: datasets, visualisations, last upload, account age in days,
    logins. Each side is aggregated per user *before* the joins, so the join
    is one row per user per side and never multiplies rows."""
    d = datasets.groupBy("user_id").agg(F.count(F.lit(1)).alias("dataset_count"),
                                        F.max("created_at").alias("last_upload"),
                                        F.min("created_at").alias("first_seen"))
    v = visualizations.groupBy(F.col("owner_id").alias("user_id")).agg(F.count(F.lit(1)).alias("viz_count"))
    s = sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("login_count"))
    out = users.select("user_id").join(d, "user_id", "left").join(v, "user_id", "left").join(s, "user_id", "left")
    return out.select(
        "user_id", F.coalesce("dataset_count", F.lit(0)).cast("bigint").alias("dataset_count"),
        F.coalesce("viz_count", F.lit(0)).cast("bigint").alias("visualization_count"), "last_upload",
        F.datediff(F.to_timestamp(F.lit(now)), F.col("first_seen")).alias("age_days"),
        F.coalesce("login_count", F.lit(0)).cast("bigint").alias("login_count"))


# J6
def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """Offset/limit page (limit capped at 1000) with total, page and pages."""
    limit = max(1, min(limit, 1000))
    total = df.count()
    rows = df.orderBy(*order).offset(skip).limit(limit)
    return rows.select("*", F.lit(total).cast("bigint").alias("total"),
                       F.lit(skip // limit + 1).cast("int").alias("page"),
                       F.lit(-(-total // limit)).cast("bigint").alias("pages"))


# J7
def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


# J8
def upsert_fields(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Partial update: a null in the update leaves the field untouched."""
    cols = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"__new_{c}") for c in cols])
    j = base.join(u, key, "left")
    return j.select(*[(F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c))
                      for c in base.columns])


# J9
def delete_cascade(datasets: DataFrame, visualizations: DataFrame, doomed: DataFrame):
    """Remove the listed datasets and every visualisation that refers to them."""
    ids = doomed.select("dataset_id").distinct()
    return without(datasets, ids, "dataset_id"), without(visualizations, ids, "dataset_id")


# J10
def like(df: DataFrame, user: int) -> DataFrame:
    return df.withColumn("liked_by", F.array_union(F.coalesce("liked_by", F.array().cast("array<bigint>")),
                                                   F.array(F.lit(user).cast("bigint"))))


def unlike(df: DataFrame, user: int) -> DataFrame:
    return df.withColumn("liked_by", F.array_remove("liked_by", F.lit(user).cast("bigint")))


def like_summary(df: DataFrame, user: int) -> DataFrame:
    return df.select("*", F.coalesce(F.size("liked_by"), F.lit(0)).alias("like_count"),
                     F.coalesce(F.array_contains("liked_by", F.lit(user).cast("bigint")), F.lit(False))
                     .alias("liked_by_user"))


# J11
def active_sessions(sessions: DataFrame, user_id: int) -> DataFrame:
    return sessions.where((F.col("user_id") == user_id) & F.col("is_active")).orderBy(F.desc("last_used_at"),
                                                                                       F.desc("session_id"))


def revoke(sessions: DataFrame, user_id: int, session_id: int | None = None) -> DataFrame:
    """Deactivate one session of the user, or all of them."""
    hit = F.col("user_id") == user_id
    if session_id is not None:
        hit = hit & (F.col("session_id") == session_id)
    return sessions.withColumn("is_active", F.when(hit, F.lit(False)).otherwise(F.col("is_active")))


# J12
def expire_sessions(sessions: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """New snapshot with sessions past expiry deactivated, and the count."""
    past = F.col("expires_at") < F.to_timestamp(F.lit(now))
    snap = sessions.withColumn("is_active", F.when(past, F.lit(False)).otherwise(F.col("is_active")))
    n = sessions.agg(F.count_if(past & F.col("is_active")).alias("expired"))
    return snap, n


# F3-F10
def visible_to(datasets: DataFrame, user_id: int, mine: bool = False) -> DataFrame:
    own = F.col("user_id") == user_id
    return datasets.where(own if mine else (own | F.col("is_public")))


def search(df: DataFrame, term: str, cols: Sequence[str]) -> DataFrame:
    t = term.lower()
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False))
    return df.where(cond)


def has_tags(df: DataFrame, tags: Sequence[str], col: str = "tags") -> DataFrame:
    """Every requested tag is a substring of the tag list (AND)."""
    cond = F.lit(True)
    for t in tags:
        cond = cond & F.coalesce(F.col(col).contains(t), F.lit(False))
    return df.where(cond)


def eq_filters(df: DataFrame, **values) -> DataFrame:
    for k, v in values.items():
        if v is not None:
            df = df.where(F.col(k) == F.lit(v))
    return df


def catalogue_search(df: DataFrame, min_rows=None, max_rows=None, created_from=None, created_to=None,
                     sort_by: str = "created_at", descending: bool = True) -> DataFrame:
    if min_rows is not None:
        df = df.where(F.col("row_count") >= min_rows)
    if max_rows is not None:
        df = df.where(F.col("row_count") <= max_rows)
    if created_from is not None:
        df = df.where(F.col("created_at") >= F.to_timestamp(F.lit(created_from)))
    if created_to is not None:
        df = df.where(F.col("created_at") <= F.to_timestamp(F.lit(created_to)))
    key = F.desc(sort_by) if descending else F.asc(sort_by)
    return df.orderBy(key, F.asc("dataset_id"))


def range_filter(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    cond = F.lit(True)
    for c, (lo, hi) in ranges.items():
        cond = cond & F.col(c).between(lo, hi)
    return df.where(cond)


def column_strategy(df: DataFrame, strategy: str = "all", columns: Sequence[str] = (), sample_size: int = 100,
                    seed: int = 42, id_col: str = "row_id") -> DataFrame:
    if strategy == "custom":
        return df.select(*[c for c in columns if c in df.columns])
    if strategy == "sample":
        if not 100 <= sample_size <= 10000:
            raise ValueError("sample_size must be in [100, 10000]")
        from constella.operators.clean import sample_n
        return sample_n(df, sample_size, seed, id_col)
    return df


def visible_clusters(points: DataFrame, shown: DataFrame) -> DataFrame:
    """Points whose cluster is in the shown list (left semi join)."""
    return points.join(shown.select("cluster"), "cluster", "left_semi")


# P10
def catalogue_stats(datasets: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Totals (datasets, public, processed, size, mean rows, success rate) and
    the most frequent tags (exploded tag list, grouped, top-k)."""
    totals = datasets.agg(
        F.count(F.lit(1)).alias("total_datasets"), F.count_if("is_public").alias("public_datasets"),
        F.count_if(F.col("status") == "processed").alias("processed_datasets"),
        F.sum("size_bytes").alias("total_size_bytes"), F.avg("row_count").alias("mean_rows"),
        (F.count_if(F.col("status") == "processed") /
         F.nullif(F.count_if(F.col("status").isin("processed", "error")), F.lit(0))).alias("success_rate"))
    tags = datasets.select(F.explode(F.split("tags", ",")).alias("tag")).select(F.trim("tag").alias("tag")) \
        .where(F.col("tag") != "").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), F.asc("tag"))
    return totals, tags.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
