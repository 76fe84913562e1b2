"""A global, gap-free row number without a single-task window.

``row_number().over(Window.orderBy(...))`` moves every row into one task.
Here the rows are range-partitioned on the (unique) ordering key, the
partitioning is fixed by a reliable checkpoint (range bounds are sampled),
per-partition counts (one row per partition) give each partition its offset,
and the numbering is a window inside each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from constella.session import cut_lineage


def global_row_number(df: DataFrame, order: Sequence[str], out: str = "row_number",
                      partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (which must be unique)."""
    n = partitions or max(df.sparkSession.sparkContext.defaultParallelism, 1)
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()))
    counts = sorted((r["__pid"], r["c"]) for r in
                    ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("c")).collect())
    if not counts:
        return ranged.drop("__pid").withColumn(out, F.lit(None).cast("long"))
    offsets, acc = [], 0
    for pid, c in counts:
        offsets += [F.lit(pid), F.lit(acc).cast("long")]
        acc += c
    off = F.create_map(*offsets)
    w = Window.partitionBy("__pid").orderBy(*order)
    return ranged.withColumn(out, F.row_number().over(w) + off[F.col("__pid")]).drop("__pid")
