"""Resharding by minimum-cost flow.

Old shards hold some number of bytes, new shards get capacities; the flow
moves the fewest bytes (any byte that stays costs nothing, a moved byte costs
``cost``, 1 by default). The flow network has one node a shard, so the solver
on the driver works on at most shards x shards arcs, whatever the data.

Blocks: the documents of an old shard, in order of falling size and then
doc_id, form one line of bytes; the flow cuts that line into blocks, first the
part that stays, then one block for each receiving shard. A document goes
where its first byte lies. With the largest documents first, cuts fall among
small documents, and shard sizes miss their capacity by little.

Numbers of the line come from range partitions and per-partition sums, never
from one ordered task, so a shard may hold any share of the rows.

Defined cases: null text counts 1 byte; null doc_ids come first in the order;
equal rows are kept and numbered apart; an empty table gives an empty plan.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constella.session import cut_lineage

#: Row key of a table read from files.
ROW = ["__file", "__line"]
#: about how many runs of documents find their place by one row
RUNS = 256


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest flow of every supply into demands of the same total, by
    successive shortest paths with potentials (costs >= 0)."""
    s, t = len(supply) + len(demand), len(supply) + len(demand) + 1
    graph: list[list[list]] = [[] for _ in range(t + 1)]

    def arc(a: int, b: int, room: int, c: float) -> None:
        graph[a].append([b, room, c, len(graph[b])])
        graph[b].append([a, 0, -c, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        arc(s, i, x, 0)
        for j in range(len(demand)):
            arc(i, len(supply) + j, min(x, demand[j]), cost(i, j))
    for j, x in enumerate(demand):
        arc(len(supply) + j, t, x, 0)
    potential = [0.0] * (t + 1)
    while True:
        far = [float("inf")] * (t + 1)
        far[s], by, heap = 0.0, {}, [(0.0, s)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, c, _) in enumerate(graph[a]):
                step = d + c + potential[a] - potential[b]
                if room > 0 and step < far[b] - 1e-12:
                    far[b], by[b] = step, (a, k)
                    heapq.heappush(heap, (step, b))
        if far[t] == float("inf"):
            break
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, far)]
        room, b = None, t
        while b != s:
            a, k = by[b]
            room = graph[a][k][1] if room is None else min(room, graph[a][k][1])
            b = a
        b = t
        while b != s:
            a, k = by[b]
            graph[a][k][1] -= room
            graph[b][graph[a][k][3]][1] += room
            b = a
    return {(i, b - len(supply)): graph[b][back][1]
            for i in range(len(supply)) for b, _, _, back in graph[i]
            if len(supply) <= b < s and graph[b][back][1] > 0}


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def plan(sized: DataFrame, shards: int, **planning) -> DataFrame:
    """``sized`` (doc_id, size, old_shard, ...) with shard and slot."""
    return _plan(sized, shards, **planning).drop("__at")


def _line(columns, size: str = "size") -> tuple[list, list[str]]:
    """The order of an old shard's documents: size, doc_id, then what else
    tells rows apart."""
    return [F.desc(size), "doc_id"], [c for c in columns if c not in ("doc_id", "size", "old_shard")]


def _plan(sized: DataFrame, shards: int, capacities: list[int] | None = None, partitions: int | None = None,
          cost=lambda i, j: 0 if i == j else 1) -> DataFrame:
    """``plan`` and __at, the first byte of a document on its old shard's line.

    Old shards beyond the new number must move wholly; capacities default to
    an even split of all bytes. The result reads a written table, so a retried
    task sees the same order."""
    n = partitions or max(sized.sparkSession.sparkContext.defaultParallelism, 1)
    line, tie = _line(sized.columns)
    ranged = cut_lineage(sized.repartitionByRange(n, "old_shard", *line).sortWithinPartitions("old_shard", *line, *tie)
                         .withColumn("__pid", F.spark_partition_id())
                         .withColumn("__row", F.monotonically_increasing_id()))
    order = Window.partitionBy("__pid", "old_shard").orderBy("__row")
    sums = ranged.groupBy("__pid", "old_shard").agg(F.sum("size").alias("b"))  # partitions + shards rows
    before = Window.partitionBy("old_shard").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("b").over(before), F.lit(0)))
    held = {r["old_shard"]: r["b"] for r in sums.groupBy("old_shard").agg(F.sum("b").alias("b")).collect()}
    old = sorted(held)
    total = sum(held.values())
    want = capacities or even(total, shards)
    flow = min_cost_flow([held[o] for o in old], want, lambda i, j: cost(old[i], j))
    cuts = []  # (old shard, first byte, shard): the part that stays, then the others
    for i, o in enumerate(old):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != o, j)):
            if (i, j) in flow:
                cuts.append((o, at, j))
                at += flow[i, j]
    spark = sized.sparkSession
    blocks = spark.createDataFrame(cuts, "old_shard int, first long, shard int").groupBy("old_shard").agg(
        F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("__blocks"))  # shards x shards entries at most
    placed = (ranged.join(F.broadcast(sums.select("__pid", "old_shard", "__before").join(blocks, "old_shard")),
                          ["__pid", "old_shard"])
              .withColumn("__at", F.col("__before") + F.sum("size").over(order) - F.col("size")))
    here = F.filter("__blocks", lambda b: b["first"] <= F.col("__at"))
    placed = cut_lineage(placed.withColumn("shard", F.element_at(here, -1)["shard"]).drop("__blocks", "__before"))
    counts = placed.groupBy("__pid", "shard").agg(F.count(F.lit(1)).alias("n"))
    prior = Window.partitionBy("shard").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__pid", "shard", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__pid", "shard").orderBy("__row")
    return (placed.join(F.broadcast(counts), ["__pid", "shard"])
            .withColumn("slot", F.col("__base") + F.row_number().over(inside) - 1)
            .drop("__pid", "__row", "__base"))


def located(table: DataFrame) -> DataFrame:
    """A table as read from its files, with the place of each row in them as
    row key (ROW): doc_ids may be null or repeated, places are neither."""
    return table.withColumns({"__file": F.col("_metadata.file_path"), "__line": F.col("_metadata.row_index")})


def move(docs: DataFrame, new_path: str, shards: int, carry: tuple = (), **planning) -> tuple[DataFrame, list[int]]:
    """Writes the shards that gain or lose documents to ``new_path/shard=k`` in
    slot order; shards that keep exactly their documents are left where they
    are. ``docs``: located documents with old_shard; the columns ``carry`` go
    through the plan and are not written. Returns the plan and the shards
    written or emptied."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    sized = docs.select("doc_id", size.alias("size"), "old_shard", *carry, *ROW)
    p = cut_lineage(_plan(sized, shards, **planning))
    moved = p.where(F.col("old_shard") != F.col("shard"))
    touched = [r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect()]  # shards
    wanted = F.col("shard").isin(touched) if touched else F.lit(False)
    _place(docs.withColumn("__size", size), p, wanted).drop("__size", "old_shard", *carry, *ROW).write.partitionBy(
        "shard").mode("overwrite").parquet(new_path)
    return p.drop("__at", *ROW), touched


def _place(docs: DataFrame, p: DataFrame, wanted: Column) -> DataFrame:
    """``docs`` (with __size) and the shard and slot that ``p`` gives them, in
    slot order.

    The blocks of the plan are cut into runs of about a ``RUNS``-th of all
    bytes. A run is known by its first document's key and slot, so a text finds
    its run by its own key, without a join by row, and travels once."""
    line, tie = _line([c for c in p.columns if c not in ("shard", "slot", "__at")], "__size")

    def key(size: str) -> Column:
        return F.struct((-F.col(size)).alias("size"), "doc_id", *tie)  # rises along the line; nulls first

    total = p.agg(F.sum("size")).first()[0] or 0
    run = F.floor(F.col("__at") / F.lit(max(total // RUNS, 1 << 20)))
    first = p.where(wanted).groupBy("old_shard", "shard", run.alias("run")).agg(
        F.min_by(key("size"), "__at").alias("key"), F.min("slot").alias("first"))  # RUNS + shards x shards rows
    other = p.where(~wanted).groupBy("old_shard", "shard", run.alias("run")).agg(
        F.min_by(key("size"), "__at").alias("key"), F.lit(None).cast("long").alias("first"))
    runs = first.unionByName(other).groupBy("old_shard").agg(
        F.sort_array(F.collect_list(F.struct("key", "shard", "first"))).alias("__runs"))
    own = F.element_at(F.filter("__runs", lambda r: r["key"] <= F.col("__key")), -1)
    found = (docs.join(F.broadcast(runs), "old_shard").withColumn("__key", key("__size")).withColumn("__run", own)
             .withColumns({"shard": F.col("__run.shard"), "__first": F.col("__run.first")})
             .drop("__runs", "__run", "__key").where("__first IS NOT NULL"))
    order = Window.partitionBy("shard", "__first").orderBy(*line, *tie)
    return (found.repartitionByRange("shard", "__first")
            .withColumn("slot", F.col("__first") + F.row_number().over(order) - 1).drop("__first"))


def rewrite(spark, old_path: str, new_path: str, shards: int, **planning) -> DataFrame:
    """Reads shard directories ``old_path/shard=k`` and moves their documents.
    Returns the plan."""
    docs = located(spark.read.parquet(old_path)).withColumnRenamed("shard", "old_shard")
    return move(docs, new_path, shards, **planning)[0]
