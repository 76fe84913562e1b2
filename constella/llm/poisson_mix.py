"""Mixing sources to target weights by Poisson replication (native).

Each source gets a mean repetition rate: target share x budget / size of the
source, sizes in UTF-8 bytes of all its texts. Each document draws its number
of copies by inverting the Poisson distribution function at a uniform number
hashed from (seed, doc_id), so the draw is the same on every run, executor
and partitioning. Documents are exploded by their counts and put in one global
random order (range partitions of a hash of seed, doc_id and copy).

Rates over 500 are drawn as the sum of equal parts with own hash seeds (a sum
of Poisson counts is Poisson), so exp(-rate) never underflows.

Defined cases: a null source is a source of its own (''); null or empty texts
weigh nothing but are drawn at their source's rate; a source without bytes has
rate 0; sources missing from the targets have weight 0; rows that repeat a
doc_id share its draw; an empty table gives an empty mix. Extra columns are
carried along, ``copy`` and ``order_key`` are overwritten if present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from constella.llm.common import join_small
from constella.session import cut_lineage

PART = 500.0


def uniform(*parts) -> Column:
    """In (0, 1): 52 bits of md5 over the parts, shifted by half a step."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def rates(docs: DataFrame, targets: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """source, bytes, rate and cdf (the Poisson distribution function of one
    part, up to where a double holds no more). ``targets`` (source, weight),
    default equal weights; ``budget``: total bytes wanted, default what is
    there."""
    size = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("double")).alias("bytes"))
    size = cut_lineage(size)  # one row per source
    if targets is None:
        want = size.select("source", (F.col("bytes") > 0).cast("double").alias("weight"))
    else:
        want = targets.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                              F.col("weight").cast("double").alias("weight")).groupBy("source").agg(
            F.sum("weight").alias("weight"))
    both = size.join(want, "source", "left").where(F.col("bytes") > 0)
    total = both.agg(F.sum("bytes"), F.sum(F.greatest(F.col("weight"), F.lit(0.0)))).first()
    all_bytes, all_weight = total[0] or 0.0, total[1] or 0.0
    scale = (all_bytes if budget is None else float(budget)) / all_weight if all_weight else 0.0
    rate = F.coalesce(F.greatest(F.col("weight"), F.lit(0.0)) * scale / F.nullif(F.col("bytes"), F.lit(0.0)),
                      F.lit(0.0))
    out = size.join(want, "source", "left").select("source", "bytes", rate.alias("rate"))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int")))
    lam = F.col("rate") / F.col("parts")
    top = F.ceil(lam + 12 * F.sqrt(lam) + 24).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct(F.exp(-lam).alias("p"), F.array(F.exp(-lam)).alias("cdf")),
        lambda a, k: F.struct((a["p"] * lam / k).alias("p"),
                              F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * lam / k)).alias("cdf")),
        lambda a: a["cdf"])
    return out.withColumn("cdf", step)


def mix(docs: DataFrame, targets: DataFrame | None = None, budget: float | None = None, seed: int = 7,
        ordered: bool = True) -> DataFrame:
    """``docs`` replicated: every column, plus rate, copy (from 0) and
    order_key; globally shuffled unless ``ordered`` is false."""
    table = cut_lineage(rates(docs, targets, budget).select(
        F.col("source").alias("__source"), "rate", F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf")))
    keyed = docs.drop("rate", "copy", "order_key").withColumn(
        "__source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    d = join_small(keyed, table, "__source")
    one = lambda part: F.size(F.filter("__cdf", lambda c: c < uniform(F.lit(seed), part, F.col("doc_id"))))
    first = F.size(F.filter("__cdf", lambda c: c < F.col("__u")))
    rest = F.aggregate(F.sequence(F.lit(1), F.col("__parts") - 1), F.lit(0), lambda a, j: a + one(j))
    d = d.withColumn("__u", uniform(F.lit(seed), F.lit(0), F.col("doc_id")))
    d = d.withColumn("__n", first + F.when(F.col("__parts") > 1, rest).otherwise(F.lit(0)))
    d = d.where(F.col("__n") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    d = d.drop("__source", "__parts", "__cdf", "__u", "__n")
    d = d.withColumn("order_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.col("doc_id").cast("string"),
                                                    F.col("copy").cast("string"))))
    return d.orderBy("order_key") if ordered else d
