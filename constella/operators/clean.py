"""Selection, sampling, imputation, outliers, scaling, feature selection.

Pattern: *fit* is one distributed aggregate whose result is bounded by the
number of features (a mean, a quantile, a lambda per column) and comes back to
the driver as a few numbers; *apply* is a narrow column expression with those
numbers as literals, so it stays inside whole-stage codegen and never joins
or shuffles the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from constella.functions.quantiles import exact_quantiles


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


class NoFeaturesError(ValueError):
    pass


# ------------------------------------------------------------------ F1, F2
def select_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Keep the requested columns that exist (plus identity columns)."""
    present = [c for c in cols if c in df.columns]
    if not present:
        raise NoFeaturesError(f"none of the requested columns exist: {list(cols)}")
    return df.select(*[k for k in keep if k in df.columns and k not in present], *present)


def numeric_features(df: DataFrame, target: str | None = None,
                     exclude: Sequence[str] = ("row_id",)) -> list[str]:
    """Numeric columns, without the target and the identity columns."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name != target and f.name not in exclude]


# ------------------------------------------------------------------ M1, M2
def sample_key(seed: int, id_col: str = "row_id") -> Column:
    """Repeatable pseudo-random order: md5 of seed and row id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _q(id_col).cast("string")))


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Uniform sample of n rows without replacement (all rows when fewer).

    ``orderBy(...).limit(n)`` plans as a top-n per partition plus one merge of
    at most n rows per partition; n is a user-visible row cap (<= 10,000 in
    the reference), so the merge is bounded."""
    return df.orderBy(sample_key(seed, id_col), _q(id_col)).limit(n)


def stratified_sample(df: DataFrame, target: str, n: int, seed: int = 42,
                      id_col: str = "row_id") -> DataFrame:
    """Per class min(size, max(1, floor(n * size / total))) rows, each class
    sampled by the md5 order.

    The rank filter first uses the literal n (the largest possible quota), so
    Spark plans a partial top-n per class *before* the shuffle and a hot class
    never moves more than n rows per input partition."""
    sizes = df.groupBy(target).agg(F.count(F.lit(1)).alias("__size"))
    total = F.sum("__size").over(Window.partitionBy())
    quotas = sizes.select(target, F.least(F.col("__size"), F.greatest(
        F.lit(1).cast("bigint"), F.floor(F.lit(n) * F.col("__size") / total))).alias("__quota"))
    w = Window.partitionBy(target).orderBy(sample_key(seed, id_col), _q(id_col))
    ranked = df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n)
    return (ranked.join(quotas, target, "left")
            .where(F.col("__rank") <= F.col("__quota")).drop("__rank", "__quota"))


# ------------------------------------------------------------------ C1-C6
def impute_drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def missing_as_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN cells of ``cols`` are missing values, like nulls."""
    floats = {c for c, kind in df.dtypes if kind in ("double", "float") and c in cols}
    return df.select(*[F.when(~F.isnan(_q(c)), _q(c)).alias(c) if c in floats else _q(c) for c in df.columns])


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    r = missing_as_null(df, cols).agg(*[F.avg(_q(c)).alias(c) for c in cols]).first()
    return {c: r[c] for c in cols}


def fill_with(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    exprs = []
    df = missing_as_null(df, list(values))
    for c in df.columns:
        if c in values and values[c] is not None:
            exprs.append(F.coalesce(_q(c), F.lit(float(values[c]))).alias(c))
        else:
            exprs.append(_q(c))
    return df.select(*exprs)


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fill_with(df, column_means(df, cols))


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    q = exact_quantiles(missing_as_null(df, cols), cols, [0.5])
    return {c: q[(c, 0.5)] for c in cols}


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fill_with(df, column_medians(df, cols))


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Most frequent value per column; ties go to the smallest value. The
    count per (column, value) is a distributed aggregate; only d rows return."""
    long = missing_as_null(df, cols).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _q(c).cast("double").alias("value")) for c in cols])))
    counts = long.where(F.col("value").isNotNull()).groupBy("column_name", "value").count()
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
    rows = counts.withColumn("r", F.row_number().over(w)).where("r = 1").collect()
    got = {r["column_name"]: r["value"] for r in rows}
    return {c: got.get(c) for c in cols}


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fill_with(df, column_modes(df, cols))


def impute_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def impute(df: DataFrame, cols: Sequence[str], how: str = "mean") -> DataFrame:
    if how == "drop":
        return impute_drop(df, cols)
    if how == "mean":
        return impute_mean(df, cols)
    if how == "median":
        return impute_median(df, cols)
    if how == "mode":
        return impute_mode(df, cols)
    if how == "zero":
        return impute_zero(df, cols)
    if how == "knn":
        from constella.operators.neighbors import impute_knn
        return impute_knn(df, cols)
    raise ValueError(f"unknown missing-value strategy {how!r}")


# ------------------------------------------------------------------ C7, C8, C21
def iqr_bounds(df: DataFrame, cols: Sequence[str], whisker: float = 1.5) -> dict[str, tuple]:
    q = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None:
            out[c] = (None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1 - whisker * iqr, q3 + whisker * iqr)
    return out


def clip_iqr(df: DataFrame, cols: Sequence[str], whisker: float = 1.5) -> DataFrame:
    b = iqr_bounds(df, cols, whisker)
    return df.select(*[
        (F.least(F.greatest(_q(c), F.lit(b[c][0])), F.lit(b[c][1])).alias(c)
         if c in b and b[c][0] is not None else _q(c)) for c in df.columns])


def filter_zscore(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Keep rows whose |z| < threshold on every feature (sample std). A
    constant column passes (its z is undefined, not an outlier); a missing
    value is not an outlier."""
    r = df.agg(*[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.stddev_samp(_q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    cond = F.lit(True)
    for i, c in enumerate(cols):
        m, s = r[f"m{i}"], r[f"s{i}"]
        if m is None or s is None or s == 0 or math.isnan(s):
            continue
        z = F.abs((_q(c) - F.lit(m)) / F.lit(s))
        cond = cond & (_q(c).isNull() | (z < F.lit(threshold)))
    return df.where(cond)


def sigma_outliers(df: DataFrame, col: str, threshold: float = 2.0) -> DataFrame:
    """Flag |x - mean| > threshold * population std (client rule)."""
    r = df.agg(F.avg(_q(col)).alias("m"), F.stddev_pop(_q(col)).alias("s")).first()
    m, s = r["m"], r["s"]
    flag = F.lit(False) if m is None else (F.abs(_q(col) - F.lit(m)) > F.lit(threshold * (s or 0.0)))
    return df.withColumn("is_outlier", F.coalesce(flag, F.lit(False)))


# ------------------------------------------------------------------ scalers
@dataclass
class Fitted:
    """Fitted per-column parameters: x -> (x - shift) / scale (after an
    optional Yeo-Johnson transform with lambdas)."""

    method: str
    shift: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    lambdas: dict[str, float] = field(default_factory=dict)
    fill: dict[str, float] = field(default_factory=dict)

    def expr(self, c: str) -> Column:
        x = _q(c)
        if c in self.fill and self.fill[c] is not None:
            x = F.coalesce(x, F.lit(float(self.fill[c])))
        if c in self.lambdas:
            x = yeo_johnson_expr(x, self.lambdas[c])
        if c in self.shift:
            sc = self.scale.get(c, 1.0)
            if sc == 0:
                return F.when(x.isNull(), None).otherwise(F.lit(0.0))
            return (x - F.lit(self.shift[c])) / F.lit(sc)
        return x

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply to any frame holding the fitted columns."""
        missing = [c for c in set(self.shift) | set(self.fill) | set(self.lambdas) if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing for transform: {sorted(missing)}")
        touched = set(self.shift) | set(self.fill) | set(self.lambdas)
        return df.select(*[(self.expr(c).alias(c) if c in touched else _q(c)) for c in df.columns])

    def params_frame(self, spark) -> DataFrame:
        cols = sorted(set(self.shift) | set(self.fill) | set(self.lambdas))
        rows = [(self.method, c, self.fill.get(c), self.lambdas.get(c), self.shift.get(c), self.scale.get(c))
                for c in cols]
        return spark.createDataFrame(rows, "method string, column_name string, fill double, lambda double, "
                                           "shift double, scale double")


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Fitted:
    """(x - mean) / population std; zero std maps to 0."""
    r = df.agg(*[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.stddev_pop(_q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return Fitted("standard", {c: r[f"m{i}"] or 0.0 for i, c in enumerate(cols)},
                  {c: (r[f"s{i}"] or 0.0) for i, c in enumerate(cols)})


def fit_mean_standard(df: DataFrame, cols: Sequence[str]) -> Fitted:
    """Mean imputation followed by standard scaling, fitted in one pass:
    after filling with the mean, the mean is unchanged and the population
    variance is the observed one times n_observed / n."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(_q(c)).alias(f"k{i}") for i, c in enumerate(cols)],
               *[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.var_pop(_q(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    n = r["n"] or 0
    fill, shift, scale_ = {}, {}, {}
    for i, c in enumerate(cols):
        m, k, v = r[f"m{i}"], r[f"k{i}"], r[f"v{i}"]
        fill[c] = m
        shift[c] = m if m is not None else 0.0
        var = (v or 0.0) * k / n if n else 0.0
        scale_[c] = math.sqrt(var) if var > 0 else 0.0
    return Fitted("standard", shift, scale_, fill=fill)


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> Fitted:
    """(x - min) / (max - min); a constant column maps to 0."""
    r = df.agg(*[F.min(_q(c)).alias(f"a{i}") for i, c in enumerate(cols)],
               *[F.max(_q(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    shift, scale = {}, {}
    for i, c in enumerate(cols):
        lo, hi = r[f"a{i}"], r[f"b{i}"]
        shift[c] = float(lo) if lo is not None else 0.0
        scale[c] = float(hi - lo) if lo is not None else 0.0
    return Fitted("minmax", shift, scale)


def fit_robust(df: DataFrame, cols: Sequence[str]) -> Fitted:
    """(x - median) / IQR; a zero IQR scales by 1 (as scikit-learn does)."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    shift, scale = {}, {}
    for c in cols:
        med = q[(c, 0.5)]
        shift[c] = med if med is not None else 0.0
        iqr = (q[(c, 0.75)] - q[(c, 0.25)]) if med is not None else 1.0
        scale[c] = iqr if iqr != 0 else 1.0
    return Fitted("robust", shift, scale)


def yeo_johnson_expr(x: Column, lam: float) -> Column:
    pos = x >= 0
    if abs(lam) < 1e-12:
        a = F.log1p(x)
    else:
        a = (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    if abs(lam - 2) < 1e-12:
        b = -F.log1p(-x)
    else:
        b = -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(pos, a).otherwise(b)


def _yj_loglik(df: DataFrame, cols: Sequence[str], grids: dict[str, list[float]]) -> dict[str, float]:
    """Best lambda per column on its grid: one aggregate evaluates every
    (column, lambda) pair, log-likelihood -n/2 log var + (l-1) sum sign log1p|x|."""
    aggs = [F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(F.signum(_q(c)) * F.log1p(F.abs(_q(c)))).alias(f"g{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(cols):
        for j, lam in enumerate(grids[c]):
            y = yeo_johnson_expr(_q(c), lam)
            aggs.append(F.var_pop(y).alias(f"v{i}_{j}"))
    r = df.agg(*aggs).first()
    best = {}
    for i, c in enumerate(cols):
        n, g = r[f"n{i}"], r[f"g{i}"] or 0.0
        top, arg = -math.inf, 1.0
        for j, lam in enumerate(grids[c]):
            v = r[f"v{i}_{j}"]
            if v is None or v <= 0 or math.isnan(v):
                continue
            ll = -n / 2.0 * math.log(v) + (lam - 1) * g
            if ll > top:
                top, arg = ll, lam
        best[c] = arg
    return best


def fit_power(df: DataFrame, cols: Sequence[str], lambdas: dict[str, float] | None = None) -> Fitted:
    """Yeo-Johnson with lambda by maximum likelihood, then standardised: a
    coarse grid on [-2, 2], moved and widened twofold while the best lies on
    its end, then finer grids around the best down to steps of 0.005."""
    if lambdas is None:
        step, lambdas, open_ = {c: 0.1 for c in cols}, {c: 0.0 for c in cols}, list(cols)
        grid = lambda c: [round(lambdas[c] + step[c] * (k - 20), 10) for k in range(41)]
        for _ in range(24):
            grids = {c: grid(c) for c in open_}
            best = _yj_loglik(df, open_, grids)
            lambdas |= best
            open_ = [c for c in open_ if best[c] in (grids[c][0], grids[c][-1])]
            step |= {c: 2 * step[c] for c in open_}
            if not open_:
                break
        else:
            raise RuntimeError(f"no lambda of most likelihood found for {open_}")
        while coarse := [c for c in cols if step[c] > 0.005]:
            step |= {c: step[c] / 20 for c in coarse}
            lambdas |= _yj_loglik(df, coarse, {c: grid(c) for c in coarse})
    tmp = Fitted("power", lambdas=dict(lambdas))
    t = tmp.transform(df.select(*cols))
    std = fit_standard(t, cols)
    return Fitted("power", std.shift, std.scale, dict(lambdas))


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard") -> Fitted:
    if method == "none":
        return Fitted("none")
    if method == "minmax":
        return fit_minmax(df, cols)
    if method == "robust":
        return fit_robust(df, cols)
    if method == "power":
        return fit_power(df, cols)
    return fit_standard(df, cols)  # unknown names fall back to standard


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard") -> DataFrame:
    return fit_scaler(df, cols, method).transform(df)


# ------------------------------------------------------------------ C14-C16
def select_variance(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Per feature population variance and whether it is kept (> threshold)."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), _q(c).cast("double").alias("value")) for c in cols])))
    return long.groupBy("feature").agg(F.var_pop("value").alias("variance")).withColumn(
        "selected", F.coalesce(F.col("variance") > F.lit(threshold), F.lit(False)))


def univariate_scores(df: DataFrame, cols: Sequence[str], target: str, classification: bool,
                      k: int = 10) -> DataFrame:
    """ANOVA F (classification) or regression F per feature; top-k selected.

    Both come from small aggregates: per-class count/sum/sum of squares
    (rows = classes x features) or one correlation per feature."""
    long = df.select(_q(target).alias("__y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), _q(c).cast("double").alias("x")) for c in cols]))) \
        .where(F.col("x").isNotNull() & F.col("__y").isNotNull())
    if classification:
        per = long.groupBy("feature", "__y").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"),
                                                 F.sum(F.col("x") * F.col("x")).alias("ss"))
        g = per.groupBy("feature").agg(
            F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("ss").alias("SS"),
            F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"), F.count(F.lit(1)).alias("K"))
        ss_between = F.col("B") - F.col("S") * F.col("S") / F.col("N")
        ss_within = F.col("SS") - F.col("B")
        score = (ss_between / (F.col("K") - 1)) / (ss_within / (F.col("N") - F.col("K")))
        scored = g.select("feature", score.alias("score"))
    else:
        g = long.groupBy("feature").agg(F.corr("x", F.col("__y").cast("double")).alias("r"),
                                        F.count(F.lit(1)).alias("N"))
        r2 = F.col("r") * F.col("r")
        scored = g.select("feature", (r2 / (1 - r2) * (F.col("N") - 2)).alias("score"))
    w = Window.orderBy(F.desc_nulls_last("score"), F.asc("feature"))
    return scored.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= k)


def is_classification_target(df: DataFrame, target: str) -> bool:
    """Categorical, or fewer than 10 distinct values (the reference's rule)."""
    dt = df.schema[target].dataType
    if not isinstance(dt, T.NumericType):
        return True
    return df.select(target).distinct().limit(10).count() < 10


def select_model_based(df: DataFrame, cols: Sequence[str], target: str, classification: bool,
                       trees: int = 100, seed: int = 42) -> DataFrame:
    """Random-forest importance per feature; kept when >= the mean."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = VectorAssembler(inputCols=list(cols), outputCol="__f", handleInvalid="skip").transform(df)
    if classification:
        data = StringIndexer(inputCol=target, outputCol="__y", handleInvalid="skip").fit(data).transform(data)
        model = RandomForestClassifier(featuresCol="__f", labelCol="__y", numTrees=trees, seed=seed).fit(data)
    else:
        data = data.withColumn("__y", _q(target).cast("double"))
        model = RandomForestRegressor(featuresCol="__f", labelCol="__y", numTrees=trees, seed=seed).fit(data)
    imp = model.featureImportances.toArray().tolist()
    mean = sum(imp) / len(imp) if imp else 0.0
    spark = df.sparkSession
    return spark.createDataFrame([(c, float(v), bool(v >= mean)) for c, v in zip(cols, imp)],
                                 "feature string, importance double, selected boolean")


# ------------------------------------------------------------------ C17
def validate(df: DataFrame, cols: Sequence[str] | None = None, min_rows: int = 10) -> DataFrame:
    """inf / NaN cells, constant features, non-numeric columns, too few rows."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    cols = [c for c in (cols or numeric) if c in numeric]
    non_numeric = len([c for c in df.columns if c not in numeric])
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    inf = [F.count_if(F.abs(_q(c).cast("double")) == float("inf")) for c in cols]
    nan = [F.count_if(_q(c).isNull() | F.isnan(_q(c).cast("double"))) for c in cols]
    const = [(F.countDistinct(_q(c)) <= 1).cast("int") for c in cols]
    zero = F.lit(0).cast("bigint")
    aggs += [sum(inf, zero).alias("inf_count"), sum(nan, zero).alias("nan_count"),
             sum(const, F.lit(0)).cast("bigint").alias("constant_features")]
    r = df.agg(*aggs)
    return r.select("n_rows", "inf_count", "nan_count", "constant_features",
                    F.lit(non_numeric).cast("bigint").alias("non_numeric_columns"),
                    (F.col("n_rows") < min_rows).alias("too_few_rows"),
                    ((F.col("n_rows") >= min_rows) & (F.col("inf_count") == 0)).alias("is_valid"))
