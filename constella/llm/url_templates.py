"""URL filters by a path-template tree.

For every host the path segments form a tree, built level by level from counts
(never from lists of urls): children that hold less than ``literal_share`` of
their node turn into the wildcard '*', whatever their number; heavier ones stay
literal, at most 1 / ``literal_share`` a node. Siblings that stay literal and whose
labelled rates do not differ significantly from their pooled rate (a two-sided
z test) merge into one branch '~'. After ``depth`` levels the rest of a path
counts as one more segment, so no path is cut off. A template (host and its
generalised segments) is rejected when its smoothed labelled purity,
(good + prior * strength) / (labelled + strength), is below ``purity``; the
prior is the rate of all labelled pages.

Fixed rules come first: the longest rule that fits the host (or a parent
domain) and whose path starts the url's path decides; else the template.

Defined cases: a url that is null or has no '://' has empty host and path, no
rule, and the template of the empty host; empty paths have no segments; pages
without labels follow the prior; a page repeated is counted as often; a table
without labels rejects nothing; extra columns are carried
along, those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from constella.session import cut_lineage

#: Fixed values: (verdict, host, path) of the contract's rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split_url(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path."""
    d = pages.drop("host", "path", "template", "purity", "rule", "verdict").withColumn("__u", F.coalesce(F.col("url"), F.lit("")))
    d = d.withColumn("__r", F.expr("CASE WHEN instr(__u, '://') > 0 THEN substring(__u, instr(__u, '://') + 3) ELSE '' END"))
    host = F.regexp_extract("__r", r"\A[^/?#]*", 0)
    path = F.regexp_extract("__r", r"\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return d.withColumn("host", F.translate(host, upper, lower)).withColumn("path", path).drop("__u", "__r")


def match_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) columns over host and path: the longest rule that fits."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def templates(paths: DataFrame, depth: int = 6, literal_share: float = 0.02, z: float = 2.576) -> DataFrame:
    """(host, path, template) from ``paths`` (host, path, n, good, labelled),
    one row a distinct host and path."""
    parts = F.split(F.col("path"), "/")  # the part before the first slash is empty
    segs = F.slice(parts, 2, depth)
    tail = F.slice(parts, F.lit(depth + 2), F.size(parts))
    p = paths.withColumn("__seg", F.when(F.size(tail) > 0, F.concat(segs, F.array(F.concat_ws("/", tail)))).otherwise(segs))
    p = cut_lineage(p.withColumn("template", F.lit("")))
    for level in range(1, depth + 2):
        seg = F.get("__seg", F.lit(level - 1))
        child = (p.where(F.size("__seg") >= level).groupBy("host", "template", seg.alias("seg"))
                 .agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("labelled").alias("labelled")))
        child = cut_lineage(child)
        node = child.groupBy("host", "template").agg(
            F.sum("n").alias("nn"), F.count(F.lit(1)).alias("kids"),
            F.sum(F.when(F.col("labelled") > 0, F.col("good"))).alias("ng"), F.sum("labelled").alias("nl"))
        c = child.join(node, ["host", "template"])
        rare = (F.col("n") < literal_share * F.col("nn"))
        wild = rare & (F.col("kids") > 1)
        rate = F.col("ng") / F.nullif(F.col("nl"), F.lit(0))
        spread = F.sqrt(rate * (1 - rate) / F.nullif(F.col("labelled"), F.lit(0)))
        differs = F.coalesce(F.abs(F.col("good") / F.nullif(F.col("labelled"), F.lit(0)) - rate)
                             > z * F.nullif(spread, F.lit(0.0)), F.lit(False))
        step = F.when(wild, F.lit("*")).when((F.col("kids") > 1) & ~differs, F.lit("~")).otherwise(F.col("seg"))
        c = c.select("host", F.col("template").alias("__parent"), F.col("seg").alias("__s"),
                     F.concat(F.col("template"), F.lit("/"), step).alias("__next"))
        a = p.withColumn("__parent", F.col("template")).withColumn("__s", seg)
        p = cut_lineage(a.join(c, ["host", "__parent", "__s"], "left")
                        .withColumn("template", F.coalesce("__next", "template")).drop("__parent", "__s", "__next"))
        if level <= depth and p.where(F.size("__seg") > level).limit(1).count() == 0:
            break
    return p.drop("__seg")


def judge(pages: DataFrame, labels: DataFrame, purity: float = 0.5, strength: float = 10.0, rules=RULES,
          **tree) -> DataFrame:
    """Pages with host, path, rule, template, purity and verdict. ``labels``:
    (page_id, good 0/1)."""
    d = split_url(pages)
    rated = labels.where(F.col("page_id").isNotNull() & F.col("good").isNotNull()).groupBy("page_id").agg(
        F.min("good").cast("double").alias("__good"))
    counted = d.select("page_id", "host", "path").join(rated, "page_id", "left").groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__good"), F.lit(0.0)).alias("good"),
        F.count("__good").alias("labelled"))
    t = templates(counted, **tree)
    base = t.agg(F.sum("good") / F.nullif(F.sum("labelled"), F.lit(0))).first()[0]
    prior = 1.0 if base is None else float(base)
    score = t.groupBy("host", "template").agg(
        ((F.sum("good") + prior * strength) / (F.sum("labelled") + strength)).alias("purity"))
    verdicts = cut_lineage(t.select("host", "path", "template").join(score, ["host", "template"]))
    rule, ruled = match_rule(rules)
    return (d.join(verdicts, ["host", "path"]).withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(ruled, F.when(F.col("purity") < purity, "block").otherwise("allow"))))
