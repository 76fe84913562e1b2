"""Registered selection, sampling, cleaning, scaling and feature-selection
queries (F1, F2, M1, M2, C1-C21) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from constella.functions.numeric import round_sql as R
from constella.functions.numeric import round_sig, round_to
from constella.functions.numeric import round_sig_sql as RS
from constella.operators import clean as C
from constella.plans.registry import register
from constella.tables import NUMERIC_FEATURES as FEATS
from constella.tables import features, load, with_fixtures

POWER_LAMBDAS = {"l_quantity": 0.5, "l_extendedprice": 0.25, "l_discount": 1.5, "l_tax": -0.5}


def rounded(df, cols=FEATS):
    return df.select(*[(round_to(F.col(c)).alias(c) if c in cols else F.col(c)) for c in df.columns])


def _sel_rounded(src: str, exprs: dict[str, str], extra: str = "row_id") -> str:
    parts = [extra] + [f"{R(e)} AS {c}" for c, e in exprs.items()]
    return f"SELECT {', '.join(parts)} FROM {src}"


# ------------------------------------------------------------------ F1, F2
@register("f1_select_features", with_fixtures("SELECT row_id, l_quantity, l_tax FROM features", "features"))
def f1_select_features(spark, sf):
    return C.select_features(features(spark, sf), ["l_quantity", "l_tax", "no_such_column"])


@register("f2_numeric_features", "SELECT o_orderkey, o_custkey FROM orders")
def f2_numeric_features(spark, sf):
    o = load(spark, sf, "orders")
    return o.select(*C.numeric_features(o, target="o_totalprice"))


# ------------------------------------------------------------------ M1, M2
@register("m1_sample_n", "SELECT * FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey "
                         "LIMIT 100")
def m1_sample_n(spark, sf):
    return C.sample_n(load(spark, sf, "orders"), 100, 42, id_col="o_orderkey")


@register("m2_stratified_sample",
          "WITH sizes AS (SELECT o_orderpriority, count(*) AS size FROM orders GROUP BY o_orderpriority), "
          "quotas AS (SELECT o_orderpriority, least(size, greatest(1, CAST(floor(200 * size / (SELECT sum(size) "
          "FROM sizes)) AS BIGINT))) AS quota FROM sizes), ranked AS (SELECT o.*, row_number() OVER (PARTITION BY "
          "o.o_orderpriority ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rk FROM orders o) "
          "SELECT r.o_orderkey, r.o_custkey, r.o_orderstatus, r.o_totalprice, r.o_orderdate, r.o_orderpriority "
          "FROM ranked r JOIN quotas q USING (o_orderpriority) WHERE r.rk <= q.quota")
def m2_stratified_sample(spark, sf):
    o = load(spark, sf, "orders")
    return C.stratified_sample(o, "o_orderpriority", 200, 42, id_col="o_orderkey").select(*o.columns)


# ------------------------------------------------------------------ C1-C6
@register("c1_impute_drop", with_fixtures(
    "SELECT row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM features "
    "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL",
    "features"))
def c1_impute_drop(spark, sf):
    return C.impute_drop(features(spark, sf), FEATS)


def _impute_sql(stat: str) -> str:
    stats = ", ".join(f"{stat.format(c=c)} AS s_{c}" for c in FEATS)
    return with_fixtures(
        f"WITH st AS (SELECT {stats} FROM features) "
        + _sel_rounded("features, st", {c: f"coalesce({c}, s_{c})" for c in FEATS}), "features")


@register("c2_impute_mean", _impute_sql("avg({c})"))
def c2_impute_mean(spark, sf):
    return rounded(C.impute_mean(features(spark, sf).drop("l_returnflag"), FEATS))


@register("c3_impute_median", _impute_sql("median({c})"))
def c3_impute_median(spark, sf):
    return rounded(C.impute_median(features(spark, sf).drop("l_returnflag"), FEATS))


def _mode_sql() -> str:
    modes = []
    for c in FEATS:
        modes.append(f"(SELECT {c} FROM features WHERE {c} IS NOT NULL GROUP BY {c} "
                     f"ORDER BY count(*) DESC, {c} ASC LIMIT 1) AS s_{c}")
    return with_fixtures(f"WITH st AS (SELECT {', '.join(modes)}) "
                         + _sel_rounded("features, st", {c: f"coalesce({c}, s_{c})" for c in FEATS}), "features")


@register("c4_impute_mode", _mode_sql())
def c4_impute_mode(spark, sf):
    return rounded(C.impute_mode(features(spark, sf).drop("l_returnflag"), FEATS))


@register("c6_impute_zero", with_fixtures(_sel_rounded("features", {c: f"coalesce({c}, 0)" for c in FEATS}),
                                          "features"))
def c6_impute_zero(spark, sf):
    return rounded(C.impute_zero(features(spark, sf).drop("l_returnflag"), FEATS))


_PARTS_SQL = ("SELECT p_partkey AS row_id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END "
              "AS p_size, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part")


def _parts_missing(spark, sf):
    p = load(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("row_id"),
                    F.when(F.col("p_partkey") % 7 == 0, None).otherwise(F.col("p_size").cast("double")).alias("p_size"),
                    F.when(F.col("p_partkey") % 11 == 0, None).otherwise(F.col("p_retailprice")).alias("p_retailprice"))


def _knn_fill_sql(f: str, other: str) -> str:
    return (f"SELECT row_id, avg(v) AS fill FROM (SELECT q.row_id, d.{f} AS v, row_number() OVER (PARTITION BY "
            f"q.row_id ORDER BY sqrt(2.0 * ((q.{other} - d.{other}) * (q.{other} - d.{other}))), d.row_id) AS rk "
            f"FROM pm q JOIN pm d ON q.{f} IS NULL AND q.{other} IS NOT NULL AND d.{f} IS NOT NULL AND "
            f"d.{other} IS NOT NULL) WHERE rk <= 5 GROUP BY row_id")


@register("c5_impute_knn",
          f"WITH pm AS ({_PARTS_SQL}), fs AS ({_knn_fill_sql('p_size', 'p_retailprice')}), "
          f"fp AS ({_knn_fill_sql('p_retailprice', 'p_size')}) SELECT pm.row_id, "
          f"{R('coalesce(pm.p_size, fs.fill, (SELECT avg(p_size) FROM pm))')} AS p_size, "
          f"{R('coalesce(pm.p_retailprice, fp.fill, (SELECT avg(p_retailprice) FROM pm))')} AS p_retailprice "
          "FROM pm LEFT JOIN fs ON fs.row_id = pm.row_id LEFT JOIN fp ON fp.row_id = pm.row_id")
def c5_impute_knn(spark, sf):
    """k = 5 nearest rows by nan-Euclidean distance over part size and price
    (nulls by rule), mean of the donors' values."""
    from constella.operators.neighbors import impute_knn

    out = impute_knn(_parts_missing(spark, sf), ["p_size", "p_retailprice"], k=5)
    return rounded(out, ["p_size", "p_retailprice"])


# ------------------------------------------------------------------ C7, C8
def _clip_sql() -> str:
    stats = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in FEATS)
    exprs = {c: f"least(greatest({c}, q1_{c} - 1.5 * (q3_{c} - q1_{c})), q3_{c} + 1.5 * (q3_{c} - q1_{c}))"
             for c in FEATS}
    return with_fixtures(f"WITH st AS (SELECT {stats} FROM features) " + _sel_rounded("features, st", exprs),
                         "features")


@register("c7_clip_iqr", _clip_sql())
def c7_clip_iqr(spark, sf):
    return rounded(C.clip_iqr(features(spark, sf).drop("l_returnflag"), FEATS))


def _zscore_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATS)
    conds = " AND ".join(f"({c} IS NULL OR s_{c} = 0 OR abs(({c} - m_{c}) / s_{c}) < 3)" for c in FEATS)
    return with_fixtures(f"WITH st AS (SELECT {stats} FROM features) SELECT row_id, l_quantity, l_extendedprice, "
                         f"l_discount, l_tax FROM features, st WHERE {conds}", "features")


@register("c8_filter_zscore", _zscore_sql())
def c8_filter_zscore(spark, sf):
    return C.filter_zscore(features(spark, sf).drop("l_returnflag"), FEATS, 3.0)


# ------------------------------------------------------------------ C9-C13
def _standard_sql(src: str = "features", fit_where: str = "") -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS)
    exprs = {c: f"CASE WHEN {c} IS NULL THEN NULL WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END"
             for c in FEATS}
    return with_fixtures(f"WITH st AS (SELECT {stats} FROM {src} {fit_where}) "
                         + _sel_rounded(f"{src}, st", exprs), "features")


@register("c9_scale_standard", _standard_sql())
def c9_scale_standard(spark, sf):
    return rounded(C.scale(features(spark, sf).drop("l_returnflag"), FEATS, "standard"))


@register("c10_scale_minmax", with_fixtures(
    "WITH st AS (SELECT " + ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in FEATS) + " FROM features) "
    + _sel_rounded("features, st", {c: f"CASE WHEN {c} IS NULL THEN NULL WHEN b_{c} = a_{c} THEN 0.0 "
                                       f"ELSE ({c} - a_{c}) / (b_{c} - a_{c}) END" for c in FEATS}), "features"))
def c10_scale_minmax(spark, sf):
    return rounded(C.scale(features(spark, sf).drop("l_returnflag"), FEATS, "minmax"))


@register("c11_scale_robust", with_fixtures(
    "WITH st AS (SELECT " + ", ".join(f"median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) "
                                      f"AS i_{c}" for c in FEATS) + " FROM features) "
    + _sel_rounded("features, st", {c: f"({c} - m_{c}) / CASE WHEN i_{c} = 0 THEN 1.0 ELSE i_{c} END"
                                    for c in FEATS}), "features"))
def c11_scale_robust(spark, sf):
    return rounded(C.scale(features(spark, sf).drop("l_returnflag"), FEATS, "robust"))


def _yj_sql(c: str, lam: float) -> str:
    a = f"ln(1 + {c})" if lam == 0 else f"(pow({c} + 1, {lam}) - 1) / {lam}"
    b = f"-ln(1 - {c})" if lam == 2 else f"-(pow(1 - {c}, {2 - lam}) - 1) / {2 - lam}"
    return f"CASE WHEN {c} >= 0 THEN {a} ELSE {b} END"


def _power_sql() -> str:
    t = ", ".join(f"{_yj_sql(c, POWER_LAMBDAS[c])} AS {c}" for c in FEATS)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS)
    exprs = {c: f"CASE WHEN {c} IS NULL THEN NULL WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END"
             for c in FEATS}
    return with_fixtures(f"WITH yj AS (SELECT row_id, {t} FROM features), st AS (SELECT {stats} FROM yj) "
                         + _sel_rounded("yj, st", exprs), "features")


@register("c12_scale_power", _power_sql())
def c12_scale_power(spark, sf):
    df = features(spark, sf).drop("l_returnflag")
    return rounded(C.fit_power(df, FEATS, POWER_LAMBDAS).transform(df))


@register("c13_scale_dispatch", _standard_sql())
def c13_scale_dispatch(spark, sf):
    # an unknown method name falls back to standard scaling, as in the reference
    return rounded(C.scale(features(spark, sf).drop("l_returnflag"), FEATS, "no-such-scaler"))


# ------------------------------------------------------------------ C14, C15, C16
@register("c14_select_variance", with_fixtures(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {RS(f'var_pop({c})')} AS variance, "
                       f"coalesce(var_pop({c}) > 1.0, false) AS selected FROM features" for c in FEATS), "features"))
def c14_select_variance(spark, sf):
    v = C.select_variance(features(spark, sf), FEATS, 1.0)
    return v.select("feature", round_sig("variance").alias("variance"), "selected")


def _anova_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, l_returnflag AS y, {c} AS x FROM features" for c in FEATS)
    return with_fixtures(
        f"WITH long AS ({long}), clean AS (SELECT * FROM long WHERE x IS NOT NULL AND y IS NOT NULL), "
        "per AS (SELECT feature, y, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM clean GROUP BY feature, y), "
        "g AS (SELECT feature, sum(n) AS N, sum(s) AS S, sum(ss) AS SS, sum(s * s / n) AS B, count(*) AS K "
        "FROM per GROUP BY feature), sc AS (SELECT feature, ((B - S * S / N) / (K - 1)) / ((SS - B) / (N - K)) "
        "AS score FROM g) SELECT feature, "
        f"{R('score', 3)} AS score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, feature) AS INTEGER) "
        "AS rank, row_number() OVER (ORDER BY score DESC NULLS LAST, feature) <= 2 AS selected FROM sc", "features")


@register("c15_select_univariate", _anova_sql())
def c15_select_univariate(spark, sf):
    s = C.univariate_scores(features(spark, sf), FEATS, "l_returnflag", classification=True, k=2)
    return s.select("feature", round_to("score", 3).alias("score"), "rank", "selected")


@register("c16_select_model_based")
def c16_select_model_based(spark, sf):
    df = C.impute_mean(features(spark, sf), FEATS)
    return C.select_model_based(df, FEATS, "l_returnflag", classification=True, trees=20)


# ------------------------------------------------------------------ C17-C21
@register("c17_validate", with_fixtures(
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS inf_count, CAST("
    + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c}))" for c in FEATS)
    + " AS BIGINT) AS nan_count, CAST(" + " + ".join(f"CASE WHEN count(DISTINCT {c}) <= 1 THEN 1 ELSE 0 END"
                                                     for c in FEATS)
    + " AS BIGINT) AS constant_features, CAST(2 AS BIGINT) AS non_numeric_columns, count(*) < 10 AS too_few_rows, "
    "count(*) >= 10 AS is_valid FROM features", "features"))
def c17_validate(spark, sf):
    return C.validate(features(spark, sf), FEATS)


@register("c18_transform_new", _standard_sql("features", "WHERE l_returnflag = 'R'"))
def c18_transform_new(spark, sf):
    df = features(spark, sf)
    fitted = C.fit_standard(df.where(F.col("l_returnflag") == "R"), FEATS)
    return rounded(fitted.transform(df.drop("l_returnflag")))


def _preprocess_sql() -> str:
    means = ", ".join(f"avg({c}) AS m_{c}" for c in FEATS)
    filled = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in FEATS)
    zst = ", ".join(f"avg({c}) AS zm_{c}, stddev_samp({c}) AS zs_{c}" for c in FEATS)
    conds = " AND ".join(f"(zs_{c} = 0 OR abs(({c} - zm_{c}) / zs_{c}) < 3)" for c in FEATS)
    std = ", ".join(f"avg({c}) AS sm_{c}, stddev_pop({c}) AS ss_{c}" for c in FEATS)
    exprs = {c: f"CASE WHEN ss_{c} = 0 THEN 0.0 ELSE ({c} - sm_{c}) / ss_{c} END" for c in FEATS}
    return with_fixtures(
        f"WITH mm AS (SELECT {means} FROM features), filled AS (SELECT row_id, {filled} FROM features, mm), "
        f"zz AS (SELECT {zst} FROM filled), kept AS (SELECT filled.* FROM filled, zz WHERE {conds}), "
        f"st AS (SELECT {std} FROM kept) " + _sel_rounded("kept, st", exprs), "features")


@register("c19_preprocess", _preprocess_sql())
def c19_preprocess(spark, sf):
    from constella.plans.flow import preprocess
    out, _steps = preprocess(features(spark, sf).drop("l_returnflag"), FEATS, missing="mean",
                             outliers="zscore", scaling="standard")
    return rounded(out)


@register("c20_normalize", f"SELECT o_orderkey, {R('CASE WHEN mx = mn THEN 0.0 ELSE (o_totalprice - mn) / (mx - mn) END')}"
                           " AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx "
                           "FROM orders)")
def c20_normalize(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(C.scale(o, ["o_totalprice"], "minmax"), ["o_totalprice"])


@register("c21_sigma_outliers", "SELECT o_orderkey, coalesce(abs(o_totalprice - m) > 2 * s, false) AS is_outlier "
                                "FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def c21_sigma_outliers(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.sigma_outliers(o, "o_totalprice", 2.0).select("o_orderkey", "is_outlier")
