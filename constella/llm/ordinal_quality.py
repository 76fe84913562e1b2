"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - s), with one score s = w . x shared by all
grades and ordered thresholds theta_0 < theta_1 < ...; x are hashed features
of the whole text: presence of each distinct word and of its first four
characters (lower case, punctuation off), log(1 + count) of each word shape
(letters by case, digits, other characters, runs collapsed) and of adjacent
repeats. Only features significantly more frequent below the top grade (a
likelihood-ratio test of document rates in the sample) get a weight, so a short
clean text holds no evidence against it. Scoring gives the expected grade and the tail probabilities
P(grade >= k) used for selection.

Fitting uses a bounded sample of labelled documents, at most ``per_grade`` of
each grade in hash order of doc_id (a documented parameter: 3000 x 3 grades);
every document is scored. The sample's ids are broadcast (bounded by the same
parameter), so no text is shuffled; its features (not texts) reach the driver
and full-batch Adagrad fits w and theta there.

Grades of the labels table: 2 for good quality, less 1 for low quality, less 1
for toxic.

Defined cases: null and empty texts have no features and score 0, so their
grade is what the thresholds give; without any labelled row, or with one grade
only, the model accepts everything (tail probability 1); repeated rows score
alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constella.llm.common import give_back, share


GRADES = 3
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_RUNS = re.compile(r"([^\W\d_]+)|(\d+)")


def shape_of(word: str) -> str:
    """Word shape: a run of letters becomes A (upper case), Aa or a, a run of
    digits becomes 0, everything else stays; twelve characters at most."""
    def sign(m) -> str:
        t = m.group()
        return "0" if m.lastindex == 2 else "A" if t.isupper() else "a" if t.islower() else "Aa"

    return _RUNS.sub(sign, word)[:12]


def slot(feature: str, bits: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


class Hasher:
    """Words to feature slots, remembering a bounded number of words."""

    def __init__(self, bits: int, remember: int = 400_000):
        self.bits, self.remember, self.known = bits, remember, {}

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots and weights of one whole text."""
        words = text.split() if text else []
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.known) > self.remember:
            self.known.clear()
        counts, known = Counter(words), self.known
        for w in set(counts).difference(known):
            stem = w.lower().strip(_EDGES)
            known[w] = (slot("w " + stem, self.bits), slot("p " + stem[:4], self.bits), slot("s " + shape_of(w), self.bits))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        s = np.array(list(map(known.__getitem__, counts)), np.int64)
        present = np.unique(s[:, :2])
        shapes, inverse = np.unique(s[:, 2], return_inverse=True)
        repeats = sum(map(eq, words, words[1:]))
        i = np.r_[present, shapes, slot("r", self.bits)]
        x = np.r_[np.ones(len(present)), np.log1p(np.bincount(inverse, n)), math.log1p(repeats)]
        return i, x


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray | None, theta: np.ndarray | None, bits: int):
        self.weights, self.theta, self.bits = weights, theta, bits
        self.hasher = Hasher(bits)

    def __getstate__(self):
        return self.__dict__ | {"hasher": Hasher(self.bits)}

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= k), k = 1 ..., one row a text."""
        if self.weights is None:
            return np.ones((len(texts), GRADES - 1))
        s = np.zeros(len(texts))
        for r, t in enumerate(texts):
            i, x = self.hasher.features(t)
            s[r] = self.weights[i] @ x
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - s[:, None], -40, 40)))

    def bar(self, cutoff: float) -> float:
        """The tail probability that keeps a text: ``cutoff``, or that of a
        text with no evidence against it where this is lower (few labels)."""
        return cutoff if self.weights is None else min(cutoff, float(self.tails([None])[0, -1]))


def g_statistic(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> np.ndarray:
    """Likelihood-ratio statistic of a of n_a against b of n_b documents."""
    p = (a + b) / (n_a + n_b)

    def part(seen, expected):
        return seen * np.log(np.where(seen > 0, seen / np.maximum(expected, 1e-300), 1.0))

    return 2 * (part(a, n_a * p) + part(n_a - a, n_a * (1 - p)) + part(b, n_b * p) + part(n_b - b, n_b * (1 - p)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, bits: int, steps: int = 200,
        rate: float = 0.5, l2: float = 1e-4, evidence: float = 16.0, balance: float = 0.5) -> Model:
    """Features whose likelihood-ratio statistic reaches ``evidence``, then
    full-batch Adagrad on the mean negative log likelihood. A row weighs
    (rows of its grade) ** -balance: 0 leaves the sample as it is, 1 makes
    grades weigh alike."""
    if len(set(grades.tolist())) < 2:
        return Model(None, None, bits)
    sizes = np.array([len(i) for i, _ in rows])
    at, x = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    used, col = np.unique(at, return_inverse=True)
    # keep features more frequent below the top grade: a short clean text then has no evidence against it
    top = grades == grades.max()
    inside = np.bincount(col[top[row]], minlength=len(used))
    outside = np.bincount(col[~top[row]], minlength=len(used))
    telling = g_statistic(inside, top.sum(), outside, (~top).sum()) >= evidence
    telling &= inside * (~top).sum() < outside * top.sum()
    keep = telling[col]
    used, col, x, row = used[telling], (np.cumsum(telling) - 1)[col[keep]], x[keep], row[keep]
    share = np.bincount(grades, minlength=GRADES)
    weight = np.maximum(share, 1)[grades].astype(float) ** -balance
    weight /= weight.sum()
    w, gap = np.zeros(len(used)), np.array([0.0] + [0.5] * (GRADES - 2))  # theta: first, then log-gaps
    acc_w, acc_g = np.full(len(used), 1e-8), np.full(GRADES - 1, 1e-8)
    for _ in range(steps):
        theta = np.cumsum(np.r_[gap[0], np.exp(gap[1:])])
        s = np.bincount(row, w[col] * x, minlength=len(rows))
        cut = np.concatenate([[-1e9], theta, [1e9]])
        hi = 1 / (1 + np.exp(np.clip(s - cut[grades + 1], -40, 40)))
        lo = 1 / (1 + np.exp(np.clip(s - cut[grades], -40, 40)))
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gs = weight * (dhi - dlo) / p  # d(-log p)/ds
        gt = np.bincount(grades + 1, -weight * dhi / p, minlength=GRADES + 2) + np.bincount(
            grades, weight * dlo / p, minlength=GRADES + 2)
        gt = gt[1:GRADES]
        gg = np.array([gt[k:].sum() for k in range(GRADES - 1)])
        gg[1:] *= np.exp(gap[1:])
        gw = np.bincount(col, gs[row] * x, minlength=len(used)) + l2 * w
        acc_w += gw * gw
        acc_g += gg * gg
        w -= rate * gw / np.sqrt(acc_w)
        gap -= rate * gg / np.sqrt(acc_g)
    weights = np.zeros(1 << bits)
    weights[used] = w
    return Model(weights, np.cumsum(np.r_[gap[0], np.exp(gap[1:])]), bits)


def train(docs: DataFrame, labels: DataFrame, per_grade: int = 3000, bits: int = 20, steps: int = 200) -> Model:
    """Model from at most ``per_grade`` labelled documents of each grade, one
    row an id (of several, the text with the smallest digest)."""
    grade = 2 - F.when(F.col("toxic") == 1, 1).otherwise(0) - F.when(F.col("quality") == 0, 1).otherwise(0)
    rated = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(grade).alias("grade"))
    some = None
    for g in range(GRADES):
        part = rated.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        some = part if some is None else some.unionByName(part)
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "grade").agg(
        F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))

    def featurise(batches):
        h = Hasher(bits)
        for b in batches:
            got = [h.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id").cast(pa.string()), "grade": b.column("grade").cast(pa.int32()),
                "at": pa.array([i for i, _ in got], pa.list_(pa.int64())),
                "x": pa.array([v for _, v in got], pa.list_(pa.float64()))})

    table = sample.mapInArrow(featurise, "doc_id string, grade int, at array<long>, x array<double>").toArrow()
    order = sorted(range(table.num_rows), key=lambda i: table["doc_id"][i].as_py())
    at, x, g = table["at"], table["x"], table["grade"].to_numpy()
    rows = [(at[i].values.to_numpy(), x[i].values.to_numpy()) for i in order]
    model = fit(rows, g[order].astype(np.int64), bits, steps) if rows else Model(None, None, bits)
    del table, at, x, g, rows
    give_back()  # what the fit held on the driver
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade and p1, p2 (P(grade >= 1), P(grade >= 2))."""
    shared = share(docs.sparkSession, model)

    def run(batches):
        for b in batches:
            p = shared().tails(b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "expected_grade": pa.array(p.sum(1), pa.float64()),
                "p1": pa.array(p[:, 0], pa.float64()), "p2": pa.array(p[:, 1], pa.float64())})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, expected_grade double, p1 double, p2 double")


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, **fitting) -> DataFrame:
    """``score`` plus kept: P(grade >= 2) of at least ``Model.bar(cutoff)``, so a
    text without evidence against it stays."""
    model = train(docs, labels, **fitting)
    return score(docs, model).withColumn("kept", F.col("p2") >= model.bar(cutoff))


def select(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, **fitting) -> DataFrame:
    """The rows of ``docs``, all columns, with P(grade >= 2) of at least
    ``Model.bar(cutoff)``. The model judges each row where it lies: no join, no shuffle."""
    model = train(docs, labels, **fitting)
    shared, bar = share(docs.sparkSession, model), model.bar(cutoff)

    def run(batches):
        for b in batches:
            p = shared().tails(b.column("text").to_pylist())
            yield b.filter(pa.array(p[:, -1] >= bar))

    return docs.mapInArrow(run, docs.schema)
