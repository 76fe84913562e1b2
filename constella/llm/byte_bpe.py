"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A pre-token is a row of byte positions. Leaf ``i`` of its segment tree holds
the rank of the pair that starts at the live token ``i`` (its left byte
position), packed as rank * width + i, so the smallest value at the root is
the lowest rank and, among equal ranks, the leftmost pair. A merge joins the
token at the root's position with its right neighbour and updates three
leaves: the merged token, its left neighbour, and the neighbour that is gone;
each update climbs one path, so a merge costs log(width).

Distinct pre-tokens are encoded once per task (a bounded table). Many short
ones of equal width share numpy trees, one tree a row; long ones take the same
tree on Python lists.

The vocabulary is read on the driver and broadcast (50 thousand entries, a
fixed file), so executors need no file.

Defined cases: null and empty texts give no ids; ids never depend on other
rows; documents may repeat; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from constella.llm.common import share

NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Ranks of a tiktoken file: id -> bytes, byte -> id, and for every pair
    of ids whose bytes join to an entry, the entry's id (which is its rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = {i: t for t, i in self.ranks.items()}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = max(self.pieces) + 1
        pair = {}
        for t, i in self.ranks.items():
            for cut in range(1, len(t)):
                left, right = self.ranks.get(t[:cut]), self.ranks.get(t[cut:])
                if left is not None and right is not None:
                    pair[left * self.base + right] = i
        self.pair = pair
        self.keys = np.array(sorted(pair), np.int64)
        self.values = np.array([pair[int(k)] for k in self.keys], np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they don't merge or a side is missing."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.values[at], NONE)


def merge_one(piece: bytes, v: Vocabulary) -> list[int]:
    """Ids of one pre-token by a segment tree on Python lists."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    tok = [int(v.byte_id[b]) for b in piece]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    none = int(NONE)

    def leaf(i: int) -> int:
        j = right[i]
        r = v.pair.get(tok[i] * v.base + tok[j]) if j < n else None
        return none if r is None else r * width + i

    tree = [none] * (2 * width)
    for i in range(n):
        tree[width + i] = leaf(i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low

    while tree[1] != none:
        rank, i = divmod(tree[1], width)
        gone = right[i]
        tok[i], tok[gone], right[i] = rank, -1, right[gone]
        if right[i] < n:
            left[right[i]] = i
        put(gone, none)
        put(i, leaf(i))
        if left[i] >= 0:
            put(left[i], leaf(left[i]))
    return [t for t in tok if t >= 0]


def merge_many(pieces: list[bytes], width: int, v: Vocabulary) -> list[bytes]:
    """Ids (little-endian 32-bit) of pre-tokens of at most ``width`` bytes, a
    power of two: one segment tree a row, merged in step."""
    m = len(pieces)
    size = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
    tok = np.full((m, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
    inside = np.arange(width) < size[:, None]
    tok[:, :width] = np.where(inside, v.byte_id[raw], -1)
    right = np.tile(np.minimum(np.arange(1, width + 2), width), (m, 1))
    left = np.tile(np.r_[width, np.arange(width)], (m, 1))
    tree = np.full((m, 2 * width), NONE, np.int64)
    rank = v.lookup(tok[:, :width], tok[:, 1:])
    tree[:, width:] = np.where(rank == NONE, NONE, rank * width + np.arange(width))
    k = width
    while k > 1:
        tree[:, k // 2:k] = np.minimum(tree[:, k:2 * k:2], tree[:, k + 1:2 * k:2])
        k //= 2
    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        rank, at = np.divmod(tree[rows, 1], width)
        gone = right[rows, at]
        after, before = right[rows, gone], left[rows, at]
        tok[rows, at] = rank
        tok[rows, gone] = -1
        right[rows, at] = after
        left[rows, after] = at
        own = v.lookup(rank, tok[rows, after])
        prev = v.lookup(tok[rows, before], rank)
        has = np.flatnonzero(before < width)
        tree[rows, width + gone] = NONE
        tree[rows, width + at] = np.where(own == NONE, NONE, own * width + at)
        tree[rows[has], width + before[has]] = np.where(prev[has] == NONE, NONE, prev[has] * width + before[has])
        for r, leaf in ((rows, gone), (rows, at), (rows[has], before[has])):
            k = (width + leaf) >> 1
            while k.size and k[0] >= 1:
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
                k = k >> 1
        rows = rows[tree[rows, 1] != NONE]
    live = tok[:, :width] >= 0
    flat, ends = tok[:, :width][live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
    return [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


def encode_pieces(pieces: list[str], v: Vocabulary, table: dict[str, bytes]) -> None:
    """Puts the ids of ``pieces`` into ``table``."""
    short: dict[int, list[str]] = {}
    for p in pieces:
        b = p.encode("utf-8", "surrogatepass")
        whole = v.ranks.get(b)
        if whole is not None:
            table[p] = whole.to_bytes(4, "little")
        elif len(b) <= 32:
            short.setdefault(1 << max(1, (len(b) - 1).bit_length()), []).append(p)
        else:
            table[p] = np.array(merge_one(b, v), "<u4").tobytes()
    for width, group in short.items():
        for s in range(0, len(group), 8192):
            part = group[s:s + 8192]
            table.update(zip(part, merge_many([p.encode("utf-8", "surrogatepass") for p in part], width, v)))


class Encoder:
    """Whole texts to ids and back. Remembers up to ``remember`` pre-tokens;
    shared as a broadcast, it stays with a Python worker from task to task."""

    def __init__(self, v: Vocabulary, pattern: str, remember: int = 500_000):
        self.v, self.pattern, self.remember, self.table, self.find = v, pattern, remember, {}, None
        size = np.zeros(v.base, np.int64)
        for i, t in v.pieces.items():
            size[i] = len(t)
        self.size, self.start = size, np.r_[0, np.cumsum(size)[:-1]]
        self.text = np.frombuffer(b"".join(v.pieces.get(i, b"") for i in range(v.base)), np.uint8)

    def __getstate__(self):
        return self.__dict__ | {"table": {}, "find": None}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        if self.find is None:
            import regex

            self.find = regex.compile(self.pattern).findall
        out = []
        for s in range(0, len(texts), 256):
            split = [self.find(t) if t else [] for t in texts[s:s + 256]]
            if len(self.table) > self.remember:
                self.table.clear()
            table = self.table
            encode_pieces(list(set().union(*split).difference(table)), self.v, table)
            out += [b"".join(map(table.__getitem__, x)) for x in split]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for, gathered from the vocabulary."""
        i = np.frombuffer(ids, "<u4")
        n = self.size[i]
        ends = np.cumsum(n)
        where = np.arange(ends[-1] if len(n) else 0) + np.repeat(self.start[i] - (ends - n), n)
        return self.text[where].tobytes()


def encode(docs: DataFrame, vocabulary: str, pattern: str, full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (over the bytes the ids
    decode to) and, with ``full``, ids and decoded text."""
    spark = docs.sparkSession
    shared = share(spark, Encoder(Vocabulary(vocabulary), pattern))
    more = ", ids array<long>, decoded binary" if full else ""

    def run(batches):
        coder = shared()
        for batch in batches:
            ids = coder.encode_batch(batch.column("text").to_pylist())
            back = [coder.decode(x) for x in ids]
            cols = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
            }
            if full:
                cols["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64()))
                cols["decoded"] = pa.array(back, pa.binary())
            yield pa.RecordBatch.from_pydict(cols)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
