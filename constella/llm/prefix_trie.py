"""Prefix trie of conversations by truncation peeling.

A conversation is a row with its path: one 16-byte digest per depth, each over
the digest before it and the turn's role and text, so equal digests are equal
prefixes (equality of prefixes rests on these 128 bits). Nodes are never listed
first: the peel starts at the greatest depth, merges the conversations that end
there with the nodes that are left from below, groups them by the digest of that
depth, which gives the nodes of the depth with all their aggregates, then strips
the last turn and goes on with what is left, down to the root.

On Spark: equal conversations become one row (count, smallest id, digest of the
ids). These rows are range-partitioned by path, so the members of a node lie
side by side and each task peels its range alone, level by level on arrays; a
range is bounded by its bytes, whatever first turns its conversations share.
Only nodes on the path of a range's first or last row can go on in the
neighbouring range. Their partial aggregates, at most two paths a range, are
peeled once more in a last step, and the nodes below them get their parent's id
by a join on range and parent. So the number of rounds does not grow with the
depth of the trie, and no key is gathered in one task.

The ids that end at a node are hashed in ascending order: ids are sorted by range
(a hot conversation's ids over many tasks), joined to texts of at most ``CHUNK``
ids, and the texts run through the hash in order, a batch at a time.

A conversation's turns are gathered in one row as digests and word counts (28
bytes a turn); the texts stay where they are read.

Defined cases: null role or text is empty; a null turn comes first; turns of one
number are ordered by the digest of role and text; repeated rows are turns of
their own; rows with a null conv_id belong to no conversation and are left out;
texts of any length count whole; extra columns are ignored; an empty table has
no node (no member, so not even a root).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constella.llm.common import WORD_GAP
from constella.session import shared_dir

CHUNK = 500
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
STATS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, key, words) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != ""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), key.alias("key"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def paths(lists: DataFrame) -> DataFrame:
    """conv_id, path (16 bytes a depth), words (a 32-bit number a depth)."""

    def run(batches):
        for batch in batches:
            path, words = [], []
            for turns in batch.column("turns"):
                last, chain, counts = b"", [], []
                for t in turns.as_py():
                    last = hashlib.md5(last + t["key"]).digest()
                    chain.append(last)
                    counts.append(t["words"])
                path.append(b"".join(chain))
                words.append(np.array(counts, "<i4").tobytes())
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "path": pa.array(path, pa.binary()),
                                              "words": pa.array(words, pa.binary())})

    return lists.mapInArrow(run, "conv_id long, path binary, words binary")


def endings(convs: DataFrame) -> DataFrame:
    """One row per distinct path: path, words, n, conv_id (smallest),
    ends_sha256 (of the ascending decimal ids, joined by commas)."""
    leaf = F.md5("path")

    def chunks(batches):
        held = None  # [path, words, first id, texts]

        def flush():
            return {"path": [held[0]], "words": [held[1]], "conv_id": [held[2]], "n": [len(held[3])],
                    "ids": [",".join(held[3])]}

        for batch in batches:
            out = {k: [] for k in ("path", "words", "conv_id", "n", "ids")}
            for path, words, conv in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "conv_id"))):
                if held is not None and (held[0] != path or len(held[3]) == CHUNK):
                    for k, v in flush().items():
                        out[k] += v
                    held = None
                if held is None:
                    held = [path, words, conv, []]
                held[3].append(str(conv))
            yield _batch(out)
        if held is not None:
            yield _batch(flush())

    def _batch(out):
        kinds = {"path": pa.binary(), "words": pa.binary(), "conv_id": pa.int64(), "n": pa.int64(), "ids": pa.string()}
        return pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in kinds.items()})

    def digest(batches):
        held = None  # [path, words, first id, count, running hash]

        def flush():
            return [*held[:4], held[4].hexdigest()]

        def table(rows):
            kinds = (("path", pa.binary()), ("words", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()),
                     ("ends_sha256", pa.string()))
            return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds)})

        for batch in batches:
            rows = []
            for path, words, conv, n, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "conv_id", "n", "ids"))):
                if held is not None and held[0] == path:
                    held[3] += n
                    held[4].update(b"," + ids.encode())
                    continue
                if held is not None:
                    rows.append(flush())
                held = [path, words, conv, n, hashlib.sha256(ids.encode())]
            yield table(rows)
        if held is not None:
            yield table([flush()])

    sorted_ids = convs.withColumn("leaf", leaf).repartitionByRange("leaf", "conv_id").sortWithinPartitions("leaf", "conv_id")
    listed = sorted_ids.drop("leaf").mapInArrow(chunks, "path binary, words binary, conv_id long, n long, ids string")
    return (listed.withColumn("leaf", leaf).repartition("leaf").sortWithinPartitions("leaf", "conv_id").drop("leaf")
            .mapInArrow(digest, "path binary, words binary, conv_id long, n long, ends_sha256 string"))


class _Rows:
    """Columns of finished or open nodes, gathered level by level."""

    def __init__(self):
        self.parts: list[dict] = []

    def add(self, **columns):
        if len(columns["depth"]):
            self.parts.append(columns)

    def get(self, name, empty=np.int64):
        return np.concatenate([p[name] for p in self.parts]) if self.parts else np.zeros(0, empty)


def _groups(hi, lo):
    """Starts of the groups of neighbours with equal digests."""
    first = np.ones(len(hi), bool)
    first[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return np.flatnonzero(first)


def peel(path: list[bytes], words: list[bytes], n: np.ndarray, conv: np.ndarray, ends: np.ndarray):
    """Peels rows sorted by path. Gives the closed nodes (those that no other
    range can share), and the open ones with what lies closed below them. Where
    a closed node's parent is open, ``open_parent`` is the parent's depth and
    side (2 * depth, + 1 on the last row's path alone), else -1."""
    lengths = np.array([len(p) // 16 for p in path], np.int64)
    starts = np.cumsum(lengths) - lengths
    digests = np.frombuffer(b"".join(path), ">u8").reshape(-1, 2)
    counts = np.frombuffer(b"".join(words), "<i4")
    ending = np.argsort(lengths, kind="stable")
    closed, opened = _Rows(), _Rows()
    # the nodes left from the depth below, by the row that stands for them
    row = np.zeros(0, np.int64)
    left = {k: np.zeros(0, np.int64) for k in ("n", "conv", "children", "leaves", "saved", "mark")}
    upto = len(lengths)
    for depth in range(int(lengths.max()) if len(lengths) else -1, -1, -1):
        since = int(np.searchsorted(lengths[ending], depth, "left"))
        new = ending[since:upto]
        upto = since
        # newly ended conversations join the nodes from below, in order of rows
        rows = np.concatenate([row, new])
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        zero = np.zeros(len(new), np.int64)
        part = {"n": n[new], "conv": conv[new], "children": zero, "leaves": zero, "saved": zero, "mark": zero - 1}
        part = {k: np.concatenate([left[k], part[k]])[order] for k in part}
        ended = np.concatenate([np.full(len(row), -1), new])[order]
        if depth:
            at = starts[rows] + depth - 1
            first = _groups(digests[at, 0], digests[at, 1])
        else:
            first = np.zeros(1, np.int64)
        # regroup: one node a digest
        node = {k: np.add.reduceat(part[k], first) for k in ("n", "children", "leaves", "saved")}
        node["conv"] = np.minimum.reduceat(part["conv"], first)
        last_end = np.maximum.reduceat(ended, first)
        sha = np.where(last_end >= 0, ends[last_end], EMPTY)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        row = rows[first]
        size = counts[starts[row] + depth - 1].astype(np.int64) if depth else np.zeros(len(row), np.int64)
        is_open = np.full(len(row), -1, np.int64)
        if lengths[-1] >= depth:
            is_open[-1] = 2 * depth + 1
        if lengths[0] >= depth:
            is_open[0] = 2 * depth
        # children that wait for this node's id: closed ones get it now
        waiting = part["mark"] >= 0
        if waiting.any():
            ids, marks = node["conv"][group[waiting]], is_open[group[waiting]]
            closed.parts[-1]["parent"][part["mark"][waiting]] = ids
            closed.parts[-1]["open_parent"][part["mark"][waiting]] = marks
        shut = is_open < 0
        leaves = np.where(node["children"] == 0, 1, node["leaves"])
        saved = node["saved"] + (node["n"] - 1) * size
        kept = np.flatnonzero(shut)
        closed.parts.append({
            "conv": node["conv"][kept], "depth": np.full(len(kept), depth), "parent": np.full(len(kept), -1, np.int64),
            "n": node["n"][kept], "children": node["children"][kept], "leaves": leaves[kept], "saved": saved[kept],
            "sha": sha[kept], "open_parent": np.full(len(kept), -1, np.int64)})
        where = np.flatnonzero(~shut)
        at = starts[row[where]] + depth - 1
        own = np.frombuffer(digests[at].tobytes(), "V16") if depth else np.full(len(where), b"", "V16")
        up = np.frombuffer(digests[at - 1].tobytes(), "V16") if depth > 1 else np.full(len(where), b"", "V16")
        opened.add(mark=is_open[where], depth=np.full(len(where), depth), own=own, up=up, conv=node["conv"][where],
                   n=node["n"][where], children=node["children"][where], leaves=node["leaves"][where],
                   saved=node["saved"][where], words=size[where], sha=sha[where])
        # what goes on to the next depth: open children are counted there later
        mark = np.full(len(row), -1, np.int64)
        mark[kept] = np.arange(len(kept))
        left = {"n": node["n"], "conv": node["conv"], "children": shut.astype(np.int64),
                "leaves": np.where(shut, leaves, 0), "saved": np.where(shut, saved, 0), "mark": mark}
    return closed, opened


OPEN = "own binary, up binary, words long"
PART = f"{NODE}, range long, mark long, {OPEN}"


def _peel_ranges(batches):
    """One task: its whole range of rows, sorted by path."""
    table = {k: [] for k in ("path", "words", "n", "conv_id", "ends_sha256")}
    for batch in batches:
        for k in table:
            table[k] += batch.column(k).to_pylist()
    if not table["path"]:
        return
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    closed, opened = peel(table["path"], table["words"], np.array(table["n"], np.int64),
                          np.array(table["conv_id"], np.int64), np.array(table["ends_sha256"], "U64"))
    names = ["conv", "depth", "parent", "n", "children", "leaves", "saved"]
    cols = [pa.array(closed.get(k)) for k in names]
    known = closed.get("open_parent")
    cols[2] = pa.array(closed.get("parent"), mask=known >= 0)
    cols += [pa.array(closed.get("sha", "U64").tolist(), pa.string()), pa.array(np.full(len(known), part)), pa.array(known, mask=known < 0)]
    cols += [pa.nulls(len(known), pa.binary()), pa.nulls(len(known), pa.binary()), pa.nulls(len(known), pa.int64())]
    fields = [f.split()[0] for f in PART.split(", ")]
    whole = pa.RecordBatch.from_arrays(cols, names=fields)
    for k in range(0, whole.num_rows, 50_000):
        yield whole.slice(k, 50_000)
    count = len(opened.get("depth"))
    deep = opened.get("depth")
    binary = [[b"" if d <= gone else bytes(x) for x, d in zip(opened.get(k, "V16"), deep)] for k, gone in (("own", 0), ("up", 1))]
    cols = [pa.array(opened.get("conv")), pa.array(deep), pa.nulls(count, pa.int64())]
    cols += [pa.array(opened.get(k)) for k in ("n", "children", "leaves", "saved")]
    cols += [pa.array(opened.get("sha", "U64").tolist(), pa.string()), pa.array(np.full(count, part)), pa.array(opened.get("mark"))]
    cols += [pa.array(binary[0], pa.binary()), pa.array(binary[1], pa.binary()), pa.array(opened.get("words"))]
    yield pa.RecordBatch.from_arrays(cols, names=fields)


def _join_open(frame):
    """Peels the open nodes of all ranges: two paths a range at most."""
    total = frame.groupby(["depth", "own"], as_index=False).agg(
        conv_id=("conv_id", "min"), n_convs=("n_convs", "sum"), n_children=("n_children", "sum"), n_leaves=("n_leaves", "sum"),
        saved_tokens=("saved_tokens", "sum"), words=("words", "max"), up=("up", "first"),
        ends_sha256=("ends_sha256", lambda s: next((x for x in s if x != EMPTY), EMPTY)))
    done, below = {}, {}
    for r in total.sort_values("depth", ascending=False).to_dict("records"):
        here = below.pop((r["depth"], r["own"]), [])
        r["n_children"] += len(here)
        r["n_leaves"] = 1 if r["n_children"] == 0 else r["n_leaves"] + sum(c["n_leaves"] for c in here)
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"] + sum(c["saved_tokens"] for c in here)
        done[r["depth"], r["own"]] = r
        if r["depth"]:
            below.setdefault((r["depth"] - 1, r["up"]), []).append(r)
    out = frame[["depth", "own", "range", "mark"]].copy()
    node = [done[d, o] for d, o in zip(frame["depth"], frame["own"])]
    out["parent_conv_id"] = [done[r["depth"] - 1, r["up"]]["conv_id"] if r["depth"] else None for r in node]
    out["parent_conv_id"] = out["parent_conv_id"].astype("Int64")
    for k in ("conv_id", *STATS, "ends_sha256"):
        out[k] = [r[k] for r in node]
    out["first"] = ~frame.duplicated(["depth", "own"]).to_numpy()
    return out.drop(columns="own")


def trie(convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``convs`` (conv_id, path, words): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. The peeled ranges are written to the shared folder."""
    spark = convs.sparkSession
    path = shared_dir(spark, "trie")
    (endings(convs).repartitionByRange("path").sortWithinPartitions("path")
     .mapInArrow(_peel_ranges, PART).write.parquet(path))
    parts = spark.read.schema(PART).parquet(path)
    open_rows = parts.where(F.col("own").isNotNull())
    merged = open_rows.groupBy(F.lit(0).alias("all")).applyInPandas(
        lambda key, frame: _join_open(frame),
        "depth long, range long, mark long, parent_conv_id long, conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string, first boolean")
    merged.write.parquet(f"{path}-open")
    merged = spark.read.parquet(f"{path}-open")
    names = [f.split()[0] for f in NODE.split(", ")]
    shut = parts.where(F.col("own").isNull())
    settled = shut.where(F.col("mark").isNull()).select(names)
    waiting = shut.where(F.col("mark").isNotNull()).drop("parent_conv_id").join(
        merged.select("range", "mark", F.col("conv_id").alias("parent_conv_id")), ["range", "mark"]).select(names)
    return settled.unionByName(waiting).unionByName(merged.where("first").select(names))
