"""Registered catalogue queries (J1-J12, F3-F10, P10) and scalar-function
queries, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from constella.functions import scalars as S
from constella.functions.numeric import round_sql as R
from constella.functions.numeric import round_to
from constella.operators import catalogue as J
from constella.plans.registry import register
from constella.tables import (datasets, labelled_points, load, sessions, users, visualizations, with_fixtures)

NOW = "2024-01-15 00:00:00"
DS_COLS = ("dataset_id, name, user_id, status, is_public, tags, size_bytes, row_count, created_at, parent_id, "
           "version")


@register("j1_user_datasets", with_fixtures(
    "SELECT u.user_id, u.email, d.dataset_id, d.name FROM users u JOIN datasets d USING (user_id)",
    "users", "datasets"))
def j1_user_datasets(spark, sf):
    return J.owned(users(spark, sf), datasets(spark, sf)).select("user_id", "email", "dataset_id", "name")


@register("j2_dataset_parent", with_fixtures(
    "SELECT d.dataset_id, d.parent_id, p.name AS parent_name, p.version AS parent_version FROM datasets d "
    "LEFT JOIN datasets p ON p.dataset_id = d.parent_id", "datasets"))
def j2_dataset_parent(spark, sf):
    return J.with_parent(datasets(spark, sf)).select("dataset_id", "parent_id", "parent_name", "parent_version")


@register("j2_chain_depth", with_fixtures(
    "WITH RECURSIVE walk(dataset_id, ptr, depth) AS (SELECT dataset_id, parent_id, CAST(0 AS BIGINT) FROM datasets "
    "UNION ALL SELECT w.dataset_id, d.parent_id, w.depth + 1 FROM walk w JOIN datasets d ON d.dataset_id = w.ptr) "
    "SELECT dataset_id, max(depth) AS depth FROM walk GROUP BY dataset_id", "datasets"))
def j2_chain_depth(spark, sf):
    return J.chain_depth(datasets(spark, sf))


@register("j3_same_device", with_fixtures(
    "SELECT a.session_id, a.user_id, CAST(count(b.session_id) AS BIGINT) AS same_device_sessions FROM sessions a "
    "LEFT JOIN sessions b ON a.device_fingerprint IS NOT NULL AND b.device_fingerprint IS NOT NULL AND "
    "a.session_id <> b.session_id AND (a.device_fingerprint = b.device_fingerprint OR (a.ip_address = b.ip_address "
    "AND a.user_agent = b.user_agent)) GROUP BY a.session_id, a.user_id", "sessions"))
def j3_same_device(spark, sf):
    return J.same_device_counts(sessions(spark, sf))


@register("j4_accessible", with_fixtures(
    f"SELECT {DS_COLS} FROM datasets WHERE user_id IN (SELECT user_id FROM users WHERE is_active)",
    "users", "datasets"))
def j4_accessible(spark, sf):
    return J.accessible(datasets(spark, sf), users(spark, sf))


@register("j4_clustered", with_fixtures(
    "SELECT row_id, cluster FROM labelled_points WHERE row_id NOT IN (SELECT row_id FROM labelled_points "
    "WHERE cluster = -1)", "labelled_points"))
def j4_clustered(spark, sf):
    lp = labelled_points(spark, sf)
    return J.without(lp, lp.where("cluster = -1"), "row_id").select("row_id", "cluster")


@register("j5_user_stats", with_fixtures(
    "WITH d AS (SELECT user_id, count(*) AS n, max(created_at) AS last_upload, min(created_at) AS first_seen "
    "FROM datasets GROUP BY user_id), v AS (SELECT owner_id AS user_id, count(*) AS n FROM visualizations GROUP BY "
    "owner_id), s AS (SELECT user_id, count(*) AS n FROM sessions GROUP BY user_id) SELECT u.user_id, "
    "coalesce(d.n, 0) AS dataset_count, coalesce(v.n, 0) AS visualization_count, d.last_upload, "
    f"CAST(date_diff('day', CAST(d.first_seen AS DATE), DATE '{NOW[:10]}') AS INTEGER) AS age_days, "
    "coalesce(s.n, 0) AS login_count FROM users u LEFT JOIN d USING (user_id) LEFT JOIN v USING (user_id) "
    "LEFT JOIN s USING (user_id)", "users", "datasets", "visualizations", "sessions"))
def j5_user_stats(spark, sf):
    return J.user_stats(users(spark, sf), datasets(spark, sf), visualizations(spark, sf), sessions(spark, sf), NOW)


@register("j6_page", with_fixtures(
    f"SELECT {DS_COLS}, (SELECT count(*) FROM datasets) AS total, CAST(3 AS INTEGER) AS page, "
    "CAST(ceil((SELECT count(*) FROM datasets) / 20.0) AS BIGINT) AS pages FROM datasets "
    "ORDER BY created_at DESC, dataset_id DESC LIMIT 20 OFFSET 40", "datasets"))
def j6_page(spark, sf):
    return J.page(datasets(spark, sf), [F.desc("created_at"), F.desc("dataset_id")], skip=40, limit=20)


@register("j7_lookup", with_fixtures(f"SELECT {DS_COLS} FROM datasets WHERE dataset_id = 42", "datasets"))
def j7_lookup(spark, sf):
    return J.lookup(datasets(spark, sf), "dataset_id", 42)


@register("j8_upsert_fields", with_fixtures(
    "WITH u AS (SELECT dataset_id, CASE WHEN row_count > 3000 THEN 'big ' || name END AS new_name, "
    "CASE WHEN status = 'error' THEN true END AS new_public FROM datasets WHERE status <> 'uploaded') "
    "SELECT d.dataset_id, coalesce(u.new_name, d.name) AS name, d.user_id, d.status, "
    "coalesce(u.new_public, d.is_public) AS is_public, d.tags, d.size_bytes, d.row_count, d.created_at, "
    "d.parent_id, d.version FROM datasets d LEFT JOIN u USING (dataset_id)", "datasets"))
def j8_upsert_fields(spark, sf):
    ds = datasets(spark, sf)
    upd = ds.where(F.col("status") != "uploaded").select(
        "dataset_id", F.when(F.col("row_count") > 3000, F.concat(F.lit("big "), "name")).alias("name"),
        F.when(F.col("status") == "error", F.lit(True)).alias("is_public"))
    return J.upsert_fields(ds, upd, "dataset_id")


@register("j9_delete_cascade", with_fixtures(
    "WITH doomed AS (SELECT dataset_id FROM datasets WHERE status = 'error') "
    "SELECT 'datasets' AS table_name, count(*) AS remaining FROM datasets WHERE dataset_id NOT IN "
    "(SELECT dataset_id FROM doomed) UNION ALL SELECT 'visualizations', count(*) FROM visualizations WHERE "
    "dataset_id NOT IN (SELECT dataset_id FROM doomed)", "datasets", "visualizations"))
def j9_delete_cascade(spark, sf):
    ds = datasets(spark, sf)
    d2, v2 = J.delete_cascade(ds, visualizations(spark, sf), ds.where(F.col("status") == "error"))
    return d2.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit("datasets").alias("table_name"), "remaining") \
        .unionByName(v2.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit("visualizations").alias("table_name"),
                                                                         "remaining"))


def _likes(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("viz_id")).agg(
        F.array_sort(F.collect_set("l_suppkey")).alias("liked_by"))


@register("j10_likes",
          "WITH v AS (SELECT l_orderkey AS viz_id, list_sort(list_distinct(list(l_suppkey))) AS liked_by FROM lineitem "
          "GROUP BY l_orderkey), a AS (SELECT viz_id, CASE WHEN list_contains(liked_by, 7) THEN liked_by ELSE "
          "list_append(liked_by, 7) END AS liked_by FROM v), r AS (SELECT viz_id, list_filter(liked_by, lambda x: x <> 3) "
          "AS liked_by FROM a) SELECT viz_id, CAST(len(liked_by) AS INTEGER) AS like_count, "
          "list_contains(liked_by, 5) AS liked_by_user FROM r")
def j10_likes(spark, sf):
    """Add a like by user 7 (idempotent), remove user 3's, then count and
    test membership of user 5; like lists are the suppliers of each order."""
    v = J.unlike(J.like(_likes(spark, sf), 7), 3)
    return J.like_summary(v, 5).select("viz_id", "like_count", "liked_by_user")


@register("j11_active_sessions", with_fixtures(
    "SELECT session_id, user_id, last_used_at FROM sessions WHERE user_id = 17 AND is_active "
    "AND session_id <> (SELECT min(session_id) FROM sessions WHERE user_id = 17)", "sessions"))
def j11_active_sessions(spark, sf):
    """Active sessions of user 17 after revoking that user's first session."""
    s = sessions(spark, sf)
    first = s.where("user_id = 17").agg(F.min("session_id")).first()[0]
    return J.active_sessions(J.revoke(s, 17, first), 17).select("session_id", "user_id", "last_used_at")


@register("j12_expire_sessions", with_fixtures(
    f"SELECT count(*) FILTER (WHERE expires_at < TIMESTAMP '{NOW}' AND is_active) AS expired, "
    f"count(*) FILTER (WHERE is_active AND NOT (expires_at < TIMESTAMP '{NOW}')) AS still_active FROM sessions",
    "sessions"))
def j12_expire_sessions(spark, sf):
    snap, n = J.expire_sessions(sessions(spark, sf), NOW)
    still = snap.agg(F.count_if("is_active")).first()[0]
    return n.select("expired", F.lit(still).cast("bigint").alias("still_active"))


# ------------------------------------------------------------------ F3-F10
@register("f3_visible_to", with_fixtures(
    f"SELECT {DS_COLS} FROM datasets WHERE user_id = 11 OR is_public", "datasets"))
def f3_visible_to(spark, sf):
    return J.visible_to(datasets(spark, sf), 11, mine=False)


@register("f4_search", with_fixtures(
    "SELECT user_id, email, first_name FROM users WHERE coalesce(lower(email) LIKE '%000000%', false) OR "
    "coalesce(lower(first_name) LIKE '%st9%', false)", "users"))
def f4_search(spark, sf):
    # one term per column here; the operator ORs its term over all given columns
    u = users(spark, sf).select("user_id", "email", "first_name")
    return J.search(u, "000000", ["email"]).unionByName(J.search(u, "ST9", ["first_name"])) \
        .dropDuplicates(["user_id"])


@register("f5_has_tags", with_fixtures(
    f"SELECT {DS_COLS} FROM datasets WHERE contains(tags, 'URGENT') AND contains(tags, 'F')", "datasets"))
def f5_has_tags(spark, sf):
    return J.has_tags(datasets(spark, sf), ["URGENT", "F"])


@register("f6_eq_filters", with_fixtures(
    f"SELECT {DS_COLS} FROM datasets WHERE status = 'processed' AND is_public", "datasets"))
def f6_eq_filters(spark, sf):
    return J.eq_filters(datasets(spark, sf), status="processed", is_public=True, user_id=None)


@register("f7_catalogue_search", with_fixtures(
    f"SELECT {DS_COLS} FROM datasets WHERE row_count >= 1000 AND row_count <= 2000 AND created_at >= "
    "TIMESTAMP '1995-01-01 00:00:00' AND created_at <= TIMESTAMP '1996-12-31 00:00:00'", "datasets"))
def f7_catalogue_search(spark, sf):
    return J.catalogue_search(datasets(spark, sf), 1000, 2000, "1995-01-01 00:00:00", "1996-12-31 00:00:00",
                              "row_count", True)


@register("f8_range_filter", with_fixtures(
    "SELECT * FROM labelled_points WHERE x BETWEEN -0.5 AND 0.5 AND y BETWEEN -1 AND 1", "labelled_points"))
def f8_range_filter(spark, sf):
    return J.range_filter(labelled_points(spark, sf), {"x": (-0.5, 0.5), "y": (-1.0, 1.0)})


@register("f9_column_strategy", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY "
                                "md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def f9_column_strategy(spark, sf):
    o = load(spark, sf, "orders")
    sampled = J.column_strategy(o, "sample", sample_size=100, id_col="o_orderkey")
    return J.column_strategy(sampled, "custom", ["o_orderkey", "o_totalprice", "no_such_column"])


@register("f10_visible_clusters", with_fixtures(
    "SELECT * FROM labelled_points WHERE cluster IN (SELECT label FROM embeddings WHERE label % 3 = 0 "
    "GROUP BY label)", "labelled_points"))
def f10_visible_clusters(spark, sf):
    shown = load(spark, sf, "embeddings").where("label % 3 = 0").select(F.col("label").alias("cluster")).distinct()
    return J.visible_clusters(labelled_points(spark, sf), shown)


# ------------------------------------------------------------------ P10
@register("p10_catalogue_stats", with_fixtures(
    "SELECT count(*) AS total_datasets, count(*) FILTER (WHERE is_public) AS public_datasets, count(*) FILTER "
    "(WHERE status = 'processed') AS processed_datasets, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, "
    f"{R('avg(row_count)')} AS mean_rows, {R('count(*) FILTER (WHERE status = ' + chr(39) + 'processed' + chr(39) + ') / nullif(count(*) FILTER (WHERE status IN (' + chr(39) + 'processed' + chr(39) + ', ' + chr(39) + 'error' + chr(39) + ')), 0)')} AS success_rate "
    "FROM datasets", "datasets"))
def p10_catalogue_stats(spark, sf):
    totals, _ = J.catalogue_stats(datasets(spark, sf))
    return totals.select("total_datasets", "public_datasets", "processed_datasets",
                         F.col("total_size_bytes").cast("bigint").alias("total_size_bytes"),
                         round_to("mean_rows").alias("mean_rows"), round_to("success_rate").alias("success_rate"))


@register("p10_top_tags", with_fixtures(
    "WITH t AS (SELECT trim(unnest(string_split(tags, ','))) AS tag FROM datasets), c AS (SELECT tag, count(*) AS n "
    "FROM t WHERE tag <> '' GROUP BY tag) SELECT tag, n, CAST(row_number() OVER (ORDER BY n DESC, tag) AS INTEGER) "
    "AS rank FROM c QUALIFY rank <= 5", "datasets"))
def p10_top_tags(spark, sf):
    _, tags = J.catalogue_stats(datasets(spark, sf))
    return tags


# ------------------------------------------------------------------ scalars
@register("fn_user_names", with_fixtures(
    "SELECT user_id, CASE WHEN position('@' IN email) = 0 THEN '***' ELSE (CASE WHEN length(split_part(email, '@', 1)) "
    "<= 2 THEN repeat('*', length(split_part(email, '@', 1))) ELSE left(split_part(email, '@', 1), 1) || "
    "repeat('*', length(split_part(email, '@', 1)) - 2) || right(split_part(email, '@', 1), 1) END) || '@' || "
    "substr(email, position('@' IN email) + 1) END AS masked_email, "
    "CASE WHEN coalesce(first_name, '') <> '' AND coalesce(last_name, '') <> '' THEN first_name || ' ' || last_name "
    "WHEN coalesce(first_name, '') <> '' THEN first_name WHEN coalesce(last_name, '') <> '' THEN last_name "
    "ELSE split_part(email, '@', 1) END AS full_name, "
    "CASE WHEN coalesce(first_name, '') <> '' AND coalesce(last_name, '') <> '' THEN upper(left(first_name, 1) || "
    "left(last_name, 1)) WHEN coalesce(first_name, '') <> '' THEN upper(left(first_name, 1)) ELSE "
    "upper(left(email, 1)) END AS initials FROM users", "users"))
def fn_user_names(spark, sf):
    u = users(spark, sf)
    return u.select("user_id", S.mask_email("email").alias("masked_email"),
                    S.full_name("first_name", "last_name", "email").alias("full_name"),
                    S.initials("first_name", "last_name", "email").alias("initials"))


@register("fn_session_times", with_fixtures(
    "SELECT session_id, CASE WHEN device_fingerprint IS NULL THEN 'Unknown Device' ELSE user_agent || ' on ' || "
    "'Unknown' || ' (' || device_fingerprint || ')' END AS device_name, expires_at < TIMESTAMP '" + NOW + "' AS "
    "expired, CAST(floor(epoch(expires_at)) - floor(epoch(TIMESTAMP '" + NOW + "')) AS BIGINT) AS seconds_left, "
    "strftime(expires_at + INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%S') AS extended_to FROM sessions", "sessions"))
def fn_session_times(spark, sf):
    s = sessions(spark, sf)
    now = F.to_timestamp(F.lit(NOW))
    return s.select("session_id",
                    S.device_label("user_agent", F.lit(None).cast("string"), "device_fingerprint",
                                   F.col("device_fingerprint").isNotNull()).alias("device_name"),
                    S.is_expired("expires_at", now).alias("expired"),
                    S.seconds_until(F.col("expires_at"), now).alias("seconds_left"),
                    S.iso_text(S.add_days("expires_at", 7)).alias("extended_to"))


def _attack_sql(col: str) -> str:
    return " + ".join(f"CAST(coalesce(regexp_matches({col}, '{p.replace(chr(39), chr(39) * 2)}', 'i'), false) AS INTEGER)"
                      for p in S.ATTACK_PATTERNS)


@register("fn_attack_scan", f"SELECT page_id, {_attack_sql('url')} AS url_hits, {_attack_sql('html')} AS html_hits "
                            "FROM pages")
def fn_attack_scan(spark, sf):
    p = load(spark, sf, "pages")
    return p.select("page_id", S.matched_patterns("url").alias("url_hits"), S.matched_patterns("html").alias("html_hits"))


@register("fn_mask_credentials",
          "WITH u AS (SELECT page_id, 'postgresql://user' || CAST(page_id % 5 AS VARCHAR) || CASE WHEN page_id % 3 = 0 "
          "THEN '' ELSE ':secret' END || '@' || url AS dsn FROM pages) SELECT page_id, CASE WHEN "
          "len(string_split(dsn, '@')) = 2 AND position('://' IN split_part(dsn, '@', 1)) > 0 AND "
          "position(':' IN regexp_extract(split_part(dsn, '@', 1), '^.*://(.*)$', 1)) > 0 THEN "
          "regexp_extract(split_part(dsn, '@', 1), '^(.*)://', 1) || '://' || split_part(regexp_extract("
          "split_part(dsn, '@', 1), '^.*://(.*)$', 1), ':', 1) || ':***@' || split_part(dsn, '@', 2) ELSE '***' END "
          "AS masked FROM u")
def fn_mask_credentials(spark, sf):
    p = load(spark, sf, "pages")
    dsn = F.concat(F.lit("postgresql://user"), (F.col("page_id") % 5).cast("string"),
                   F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.lit(":secret")), F.lit("@"), F.col("url"))
    return p.select("page_id", S.mask_credentials(dsn).alias("masked"))


@register("fn_color_scale",
          "WITH st AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderkey, "
          f"{R('CASE WHEN hi = lo THEN 1.25 ELSE 0.5 + (o_totalprice - lo) / (hi - lo) * 1.5 END')} AS size, "
          "CASE WHEN hi = lo THEN '#0000ff' ELSE printf('rgb(%d, %d, %d)', CAST(floor(0 + 255 * greatest(0, least(1, "
          "(o_totalprice - lo) / (hi - lo))) + 0.5) AS INTEGER), CAST(floor(0.5) AS INTEGER), CAST(floor(255 + "
          "(0 - 255) * greatest(0, least(1, (o_totalprice - lo) / (hi - lo))) + 0.5) AS INTEGER)) END AS color, "
          f"{R('o_totalprice * 10 / 1048576.0')} AS size_mb FROM orders, st")
def fn_color_scale(spark, sf):
    o = load(spark, sf, "orders")
    r = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).first()
    lo, hi = F.lit(r["lo"]), F.lit(r["hi"])
    return o.select("o_orderkey", round_to(S.map_to_size("o_totalprice", lo, hi)).alias("size"),
                    S.interpolate_color(F.col("o_totalprice"), lo, hi).alias("color"),
                    round_to(S.bytes_to_mb(F.col("o_totalprice") * 10)).alias("size_mb"))
