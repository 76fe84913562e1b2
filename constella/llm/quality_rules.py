"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every rule rejects a document whose metric lies beyond a cutoff. Cutoffs are
not guessed: for each stratum (language) and rule, the strictest cutoff of a
fixed grid is taken whose false-rejection rate on labelled good documents is
certified below ``alpha``. The certificate is the exact binomial tail: with
``k`` of ``n`` good holdout documents rejected, the cutoff passes when
P(Binomial(n, alpha) <= k) <= delta / m, which is the same as the
Clopper-Pearson upper bound at level 1 - delta / m lying below alpha. m counts
every (stratum, rule, cutoff) tested, a Bonferroni correction, so with
probability 1 - delta no selected cutoff rejects more than alpha of the good
documents of its stratum, whichever cutoffs were chosen.

Defined cases: null or empty text has no words, fails the base rule and is not
kept; a null language is the stratum ''; a stratum without enough labelled good
documents gets no cutoff and keeps whatever passes the base rule; repeated
rows are judged alike, and exact copies count once in the holdout (the bound
needs independent texts); other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from constella.llm.common import SPACES, WORD_GAP, join_small
from constella.session import cut_lineage

#: rule -> (direction, grid of cutoffs); "gt" rejects above, "lt" below.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbol_ratio": ("gt", (0.01, 0.02, 0.05, 0.10, 0.20, 0.30)),
    "dup_line_ratio": ("gt", (0.05, 0.10, 0.20, 0.30, 0.50)),
    "repeat_ratio": ("gt", (0.05, 0.10, 0.20, 0.30, 0.40)),
    "word_length": ("gt", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0)),
    "short_words": ("lt", (4.0, 3.5, 3.0, 2.5, 2.0)),
}


def metrics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines,
    n_repeat_words and base_failed per document: narrow projections of the
    text, no shuffle.

    Neighbouring elements meet by zipping shifted slices; a lambda never looks
    back into a whole array, which Spark would evaluate anew per element."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    d = docs.select("doc_id", *keep, text.alias("__t"))
    d = d.withColumn("__w", F.split(F.btrim("__t", F.lit(SPACES)), WORD_GAP))
    d = d.withColumn("__w", F.when(F.element_at("__w", 1) == "", none).otherwise(F.col("__w")))
    n = F.size("__w")
    # words hold no white space, so a joined window names its three words exactly
    windows = F.zip_with(
        F.zip_with(F.slice("__w", 1, n - 2), F.slice("__w", 2, n - 2), lambda a, b: F.concat_ws(" ", a, b)),
        F.slice("__w", 3, n - 2), lambda a, b: F.concat_ws(" ", a, b))
    d = d.withColumn("__g", F.when(n >= 3, windows).otherwise(none))
    d = d.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    # equal windows side by side, each with its position; empty without repeats
    d = d.withColumn("__p", F.when(
        F.size(F.array_distinct("__g")) < F.size("__g"),
        F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    m = F.size("__p")
    d = d.withColumn("__e", F.zip_with(F.slice("__p", 2, m - 1), F.slice("__p", 1, m - 1),
                                       lambda a, b: a["g"] == b["g"]))
    no = F.array(F.lit(False))
    twice = F.zip_with(F.concat(no, "__e"), F.concat("__e", no), lambda a, b: a | b)
    starts = F.array_compact(F.zip_with("__p", twice, lambda x, f: F.when(f, x["i"])))
    # each start covers three words, fewer where the previous start is closer
    covered = F.aggregate(
        F.sort_array(starts), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"])
    return d.select(
        "doc_id", *keep, n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("__t", WORD_GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50)
                 | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _metric(rule: str) -> Column:
    ratio = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
             "repeat_ratio": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"),
             "short_words": ("word_chars", "n_words")}[rule]
    return F.coalesce(F.col(ratio[0]) / F.nullif(F.col(ratio[1]), F.lit(0)), F.lit(0.0))


def _beyond(rule: str, cutoff) -> Column:
    return _metric(rule) > cutoff if RULES[rule][0] == "gt" else _metric(rule) < cutoff


def _lgamma(x: Column) -> Column:
    """log Gamma(x), x >= 1: Stirling's series at x + 8, shifted back."""
    z = x + 8.0
    series = ((z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z)
              + 1 / (1260 * z * z * z * z * z))
    shift = F.log(x)
    for i in range(1, 8):
        shift = shift + F.log(x + float(i))
    return series - shift


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed from k downwards. Below the mean the
    terms fall faster than a geometric series, so the sum may stop early and
    add that series as a strict upper bound; at or above the mean the answer
    is only needed as "not small" and 1.0 is returned."""
    nd, kd = n.cast("double"), k.cast("double")
    log_top = (_lgamma(nd + 1) - _lgamma(kd + 1) - _lgamma(nd - kd + 1)
               + kd * math.log(p) + (nd - kd) * math.log(1 - p))
    steps = F.least(kd, 64 + 40 * F.sqrt(nd)).cast("int")
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * (kd - j) * (1 - p) / ((nd - kd + j + 1) * p)).alias("term"),
                              (a["sum"] + a["term"] * (kd - j) * (1 - p) / ((nd - kd + j + 1) * p)).alias("sum")),
        lambda a: F.struct(a["term"].alias("term"), a["sum"].alias("sum")))
    left = kd - steps
    ratio = left * (1 - p) / ((nd - left + 1) * p)
    value = F.exp(log_top) * (total["sum"] + total["term"] * ratio / (1 - ratio))
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), value))


def thresholds(holdout: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """One row per stratum of ``holdout`` (metrics of good documents plus a
    ``stratum`` column) with the certified cutoff of each rule, else null."""
    tests = [(r, c) for r, (_, grid) in RULES.items() for c in grid]
    counts = holdout.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(_beyond(r, c).cast("long")).alias(f"k{i}") for i, (r, c) in enumerate(tests)])
    counts = cut_lineage(counts)  # one row per stratum
    m = max(1, counts.count()) * len(tests)
    long = counts.select("stratum", "n", F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k"))
        for i, (r, c) in enumerate(tests)])))
    safe = long.where(binomial_tail(F.col("n"), F.col("k"), alpha) <= delta / m)
    return safe.groupBy("stratum").agg(*[
        (F.min if way == "gt" else F.max)(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}")
        for r, (way, _) in RULES.items()])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01,
          delta: float = 0.05) -> DataFrame:
    """Metrics, base verdict, cutoffs of the stratum and ``kept``.

    ``labels`` (doc_id, quality, toxic) marks the holdout: a document is good
    with quality 1 and toxic 0. The metrics are written once (a few numbers a
    document) and read for the holdout and for the verdict."""
    m = metrics(docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                            F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest")), keep=("stratum", "digest"))
    m = cut_lineage(m)
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id").distinct()
    cols = [c for c in m.columns if c not in ("doc_id", "stratum", "digest")]
    holdout = (m.where(~F.col("base_failed")).join(good, "doc_id").groupBy("stratum", "digest")
               .agg(*[F.first(c).alias(c) for c in cols]))
    cuts = cut_lineage(m.select("stratum").distinct().join(thresholds(holdout, alpha, delta), "stratum", "left"))
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(_beyond(r, F.col(f"cut_{r}")), F.lit(False))
    out = join_small(m.drop("digest"), cuts, "stratum")
    return out.withColumn("kept", ~F.col("base_failed") & ~bad)
