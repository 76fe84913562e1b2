"""Exact top-k by integer inner product with block-at-a-time pruning.

Vectors become integers floor(256 x). Rows, in order of vec_id, are cut into
document-range blocks; a block carries its forward index (the ids and the
integer rows) and the largest and smallest value of every term (component). A
query's bound for a block sums, term by term, its value times the block's
maximum (or minimum, where the query is negative). A query meets blocks by
falling bound and stops at the first whose bound is below its k-th score so
far; equal bounds are still scored, because a smaller vec_id wins a tie.

Spark partitions the work: blocks are dealt into document groups, queries into
query groups, and every (document group, query group) meets in one task of
bounded size. Each task keeps k rows a query; a window over those rows takes
the best k.

Defined cases: vectors that are null, hold a null or a non-finite component,
or differ in length from the longest-occurring length take no part; rows with
equal vec_id are all candidates, but a query never meets its own id; fewer
candidates than k give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from constella.session import cut_lineage


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v (array<long>) of the rows that take part."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & ok).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(blobs, dims: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, np.int64).reshape(-1, dims) for b in blobs])


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every sum stays below 2^53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2.0 ** 53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def best_of_blocks(qids, q, blocks, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec_id, score) arrays of each query's best k over ``blocks``
    [(ids, rows)], visited by falling bound until it is below the k-th score."""
    high = np.stack([x.max(0) for _, x in blocks]).astype(float)
    low = np.stack([x.min(0) for _, x in blocks]).astype(float)
    up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    bound = up @ high.T + down @ low.T
    visit = np.argsort(-bound, axis=1, kind="stable")
    kept_id = np.full((len(q), k), np.iinfo(np.int64).max)
    kept = np.full((len(q), k), np.iinfo(np.int64).min)
    alive = np.arange(len(q))
    for turn in range(len(blocks)):
        b = visit[alive, turn]
        full = kept[alive, -1] != np.iinfo(np.int64).min
        # a double bound of huge sums may be off by rounding, hence the margin
        top = bound[alive, b] * (1 + 1e-9 * np.sign(bound[alive, b])) + 1
        go = ~full | (top >= kept[alive, -1])
        alive, b = alive[go], b[go]
        if not len(alive):
            break
        for which in np.unique(b):
            rows = alive[b == which]
            ids, x = blocks[which]
            s = _product(q[rows], x)
            s[qids[rows][:, None] == ids[None, :]] = np.iinfo(np.int64).min
            all_s = np.concatenate([kept[rows], s], axis=1)
            all_i = np.concatenate([kept_id[rows], np.broadcast_to(ids, s.shape)], axis=1)
            o = np.lexsort((all_i, ~all_s), axis=1)[:, :k]  # ~s falls as s rises, without overflow
            kept[rows], kept_id[rows] = np.take_along_axis(all_s, o, 1), np.take_along_axis(all_i, o, 1)
    found = kept != np.iinfo(np.int64).min
    return np.broadcast_to(qids[:, None], kept.shape)[found], kept_id[found], kept[found]


def top_k(rows: DataFrame, is_query, k: int = 5, block: int = 512, doc_group: int = 8192,
          query_group: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: a condition on vec_id."""
    spark = rows.sparkSession
    v = integer_vectors(rows)
    stats = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if stats is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, total = int(stats["d"]), int(stats["count"])
    v = v.where(F.size("v") == dims)

    def pack(size):
        def run(frames):
            for pdf in frames:
                pdf = pdf.sort_values("vec_id", kind="stable")
                for s in range(0, len(pdf), size):
                    part = pdf.iloc[s:s + size]
                    yield pd.DataFrame({"first": [int(part.vec_id.iloc[0])],
                                        "ids": [part.vec_id.to_numpy(np.int64).tobytes()],
                                        "data": [np.stack(part.v.to_numpy()).astype(np.int64).tobytes()]})
        return run

    groups = max(1, -(-total // doc_group))
    shape = "first long, ids binary, data binary"
    ranged = cut_lineage(v.repartitionByRange(groups, "vec_id", F.xxhash64("v")).sortWithinPartitions("vec_id"))
    blocks = ranged.mapInPandas(pack(block), shape).withColumn("g", F.spark_partition_id())
    asked = ranged.where(is_query(F.col("vec_id")))
    query_groups = max(1, -(-asked.count() // query_group))
    packed = (asked.repartitionByRange(query_groups, "vec_id", F.xxhash64("v"))
              .mapInPandas(pack(query_group), shape).withColumn("h", F.spark_partition_id()))
    # both sides are written first: partition numbers must not change on a retry
    blocks, packed = cut_lineage(blocks), cut_lineage(packed)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("h", spread(query_groups))
    right = packed.withColumn("g", spread(blocks.select(F.max("g")).first()[0] + 1))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        docs = [(np.frombuffer(i, np.int64), np.frombuffer(x, np.int64).reshape(-1, dims)) for i, x in zip(a.ids, a.data)]
        qids = np.concatenate([np.frombuffer(i, np.int64) for i in b.ids])
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"),
                                     best_of_blocks(qids, _matrix(b.data, dims), docs, k))))

    local = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(
        meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
