"""N-gram Jaccard join by vertical partitioning.

A document's set holds its distinct five-word shingles (64-bit hashes; words
are lower-cased A-Z, shorter texts count as one shingle). All shingles stand
in one global order: rising frequency, then hash. The frequency is an estimate
from a fixed-size count sketch over all documents; any estimate gives the same
links, a good one keeps candidate lists short.

1. Candidates. Two sets with Jaccard >= 0.8 share a shingle among the first
   n - ceil(0.8 n) + 1 of each. Documents that share such a prefix shingle
   form a list. A pair is met in the list of its first common shingle; there
   its overlap cannot exceed what either set has left from that place on, so
   a pair with less left than the threshold asks for is not one of that list,
   and members without any such partner leave it. Of equal lists the one of
   the first shingle is kept: it holds the first common shingle of every pair
   that the others could hold. The smallest document of a list leads it, and
   each document is tested with the smallest of its leaders: one pair a
   document, not all pairs.
2. Vertical counting. The global order is cut into fragments at frequency
   pivots. For the tested pairs each fragment's overlap is counted on its own,
   in its own task, and partial counts are summed per pair.
3. Completion. Lists whose members lie in one component are done. In the
   others every member outside its leader's component is tested with the
   leader, and what still spans components after that pair by pair, again
   only pairs with enough left. No link between documents of different
   components is lost. Which lists span components is found from packed
   memberships: a task sends one row a document, and one row a list back.

Skew: a shingle estimated in more than ``split_at`` documents is dealt over
salts; the smallest document of a batch stands in every salt, so all salts
share the leader, and every two salts share a list. Equal sets inside a
task are linked there and sent on once. Leaders with many members are repeated
over salts.

Defined cases: null, empty and word-less texts have an empty set, link with
nothing and are their own component; a null doc_id gives a null component; a
repeated doc_id is one document (its sets are tested each; all its rows get one
component); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constella.llm.common import give_back, share
from constella.operators.neighbors import connected_components
from constella.session import cut_lineage

WORDS = 5
SLICES = 16
#: texts are cut into words in groups of about this many bytes
GROUP_BYTES = 1_000_000
#: shingle, document, size of its set, what the set has left from the shingle on
POSTING = np.dtype([("t", "<u8"), ("d", "<i8"), ("n", "<u4"), ("r", "<u4")])
MIX = np.uint64(0x9E3779B97F4A7C15)
PLACE, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Whole texts to sorted distinct shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """The set of every text of a column. Texts are cut into words and
        hashed together, in groups of about ``GROUP_BYTES``."""
        group = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // GROUP_BYTES
        cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        return [s for lo, hi in zip(cut, cut[1:]) for s in self._group(texts.slice(lo, hi - lo))]

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        import xxhash

        # the kernel's white space is [\x20\x09-\x0D]; it leaves empty words at the ends of a text
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        coded = split.flatten().dictionary_encode()
        known = coded.dictionary.cast(pa.large_binary()).to_pylist()
        word = coded.indices.to_numpy(zero_copy_only=False)
        there = np.array([len(x) > 0 for x in known], bool)[word]
        if not there.all():
            row, word = row[there], word[there]
        h = np.array([xxhash.xxh64_intdigest(x) for x in known], np.uint64)[word]
        n = np.bincount(row, minlength=len(texts))
        m = max(len(h) - self.words + 1, 0)
        s = h[:m]
        for k in range(1, self.words):
            s = _mix(s * MIX + h[k:k + m])
        inside = row[:m] == row[self.words - 1:self.words - 1 + m]
        s, at = s[inside], row[:m][inside]
        ends = np.cumsum(np.bincount(at, minlength=len(texts))).tolist()
        for lo, hi in zip([0, *ends], ends):
            s[lo:hi].sort()
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1])
        s, at = s[new], at[new]
        ends = np.cumsum(np.bincount(at, minlength=len(texts))).tolist()
        out = [s[lo:hi] for lo, hi in zip([0, *ends], ends)]
        first = np.cumsum(n) - n
        for i in np.flatnonzero((n > 0) & (n < self.words)).tolist():
            w = [known[x] for x in word[first[i]:first[i] + n[i]].tolist()]
            out[i] = np.array([xxhash.xxh64_intdigest(b" ".join(w), len(w))], np.uint64)
        return out


def _ids(col) -> list:
    return col.cast(pa.int64()).to_pylist()


def measure(docs: DataFrame, tool, bits: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles) per document, and the count sketch of shingles
    over all documents: 2^bits counters, a fixed size."""
    slots, part = 1 << bits, (1 << bits) // SLICES

    def run(batches):
        counters, shingler = np.zeros(slots, np.uint32), tool()
        for b in batches:
            sets = shingler.sets(b.column("text"))
            if sets:
                every = np.concatenate(sets)
                found = np.bincount((every & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
                np.add(counters, found, out=counters, casting="unsafe")
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id").cast(pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                "slice": pa.nulls(len(sets), pa.int32()), "counts": pa.nulls(len(sets), pa.binary())})
        if counters.any():
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.nulls(SLICES, pa.int64()), "n": pa.nulls(SLICES, pa.int64()),
                "slice": pa.array(range(SLICES), pa.int32()),
                "counts": pa.array([zlib.compress(counters[i * part:(i + 1) * part].tobytes(), 1) for i in range(SLICES)],
                                   pa.binary())})

    rows = cut_lineage(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, slice int, counts binary"))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(part, np.uint32)
        for c in pdf.counts:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        return pd.DataFrame({"slice": [pdf.slice.iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "slice int, counts binary"
    sums = rows.where("slice IS NOT NULL").withColumn("p", F.spark_partition_id() % 64)
    sums = sums.groupBy("slice", "p").applyInPandas(add, kind).groupBy("slice").applyInPandas(add, kind)
    sketch = np.zeros(slots, np.uint32)
    for r in sums.collect():  # SLICES rows, 2^bits counters in all
        sketch[r["slice"] * part:(r["slice"] + 1) * part] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return rows.where("slice IS NULL").select("doc_id", F.col("n").alias("n_shingles")), sketch


class Order:
    """The global order: (estimated frequency, hash), with fragment pivots."""

    def __init__(self, sketch: np.ndarray, fragments: int):
        self.sketch, self.mask = sketch, np.uint64(len(sketch) - 1)
        # the levels and how many counters stand at each, a slice at a time
        levels, counters = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for part in np.array_split(sketch, SLICES):
            v, c = np.unique(part[part > 0], return_counts=True)
            levels, at = np.unique(np.r_[levels, v], return_inverse=True)
            counters = np.bincount(at, np.r_[counters, c], minlength=len(levels))
        mass = np.cumsum(levels * counters)
        cut = [np.searchsorted(mass, mass[-1] * k / fragments) for k in range(1, fragments)] if len(levels) else []
        self.pivots = np.unique(levels[np.minimum(cut, len(levels) - 1)]) if cut else np.zeros(0, np.uint32)

    def frequency(self, s: np.ndarray) -> np.ndarray:
        return self.sketch[(s & self.mask).astype(np.int64)]

    def fragment(self, s: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pivots, self.frequency(s), side="right")


def prefix_lists(docs: DataFrame, tool, order, threshold: int, buckets: int, split_at: int):
    """Lists of documents that share a prefix shingle (sig, docs, sizes,
    rests, first) and the equal sets found inside tasks (x, y)."""

    def run(batches):
        shingler, o, first = tool(), order(), {}
        for b in batches:
            ids, sets = _ids(b.column("doc_id")), shingler.sets(b.column("text"))
            out, same = [], []
            for i in sorted(range(len(ids)), key=ids.__getitem__):
                s = sets[i]
                n = len(s)
                if not n:
                    continue
                rep = first.setdefault(zlib.crc32(s.tobytes()).to_bytes(4, "little") + _digest(s), ids[i])
                if rep != ids[i]:
                    same.append((rep, ids[i]))
                    continue
                f = o.frequency(s)
                k = n - -(-threshold * n // 100) + 1
                # a set is sorted, so places stand for hashes
                keep = np.sort((f.astype(np.uint64) << PLACE) | np.arange(n, dtype=np.uint64))[:k] & LOW
                out.append((ids[i], n, s[keep], f[keep]))
            if same:
                yield _row(-1, np.array(same, "<i8").tobytes())
            if not out:
                continue
            post = np.empty(sum(len(x[2]) for x in out), POSTING)
            post["t"] = np.concatenate([x[2] for x in out])
            post["d"] = np.repeat([x[0] for x in out], [len(x[2]) for x in out])
            post["n"] = np.repeat([x[1] for x in out], [len(x[2]) for x in out])
            post["r"] = np.concatenate([x[1] - np.arange(len(x[2])) for x in out])
            post = _salted(post, np.concatenate([x[3] for x in out]), split_at)
            where = (post["t"] >> np.uint64(20)) % np.uint64(buckets)
            post = post[np.argsort(where, kind="stable")]
            ends = np.cumsum(np.bincount(where.astype(np.int64), minlength=buckets))
            for k in range(buckets):
                lo = ends[k - 1] if k else 0
                if ends[k] > lo:
                    yield _row(k, post[lo:ends[k]].tobytes())

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "bucket int, data binary")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.bucket.iloc[0] < 0:  # equal sets, dealt over many groups by their text
            return pd.DataFrame({"sig": 0, "docs": list(pdf.data), "sizes": b"", "rests": b"", "first": 0})
        post = _with_partners(np.concatenate([np.frombuffer(x, POSTING) for x in pdf.data]), threshold)
        # sets of one doc_id and size: the one with most left stands for all
        post = post[np.lexsort((-post["r"].astype(np.int64), post["n"], post["d"], post["t"]))]
        same = (post["t"][1:] == post["t"][:-1]) & (post["d"][1:] == post["d"][:-1]) & (post["n"][1:] == post["n"][:-1])
        post = post[np.r_[True, ~same][:len(post)]]
        start = np.flatnonzero(np.r_[True, (post["t"][1:] != post["t"][:-1])][:len(post)])
        size = np.diff(np.r_[start, len(post)])
        lists = {}
        for lo, m in zip(start[size > 1].tolist(), size[size > 1].tolist()):
            g = post[lo:lo + m]
            key, first = (g["d"].tobytes(), g["n"].tobytes()), int(g["n"][0]) - int(g["r"][0])
            if key not in lists or first < lists[key][1]:
                lists[key] = g["r"].tobytes(), first
        return pd.DataFrame({"sig": [int(np.frombuffer(_digest8(d + n), "<i8")[0]) for d, n in lists],
                             "docs": [k[0] for k in lists], "sizes": [k[1] for k in lists],
                             "rests": [v[0] for v in lists.values()], "first": [v[1] for v in lists.values()]})

    shape = "sig long, docs binary, sizes binary, rests binary, first long"
    spread = F.when(F.col("bucket") < 0, F.xxhash64("data") % 64).otherwise(F.lit(0))
    found = cut_lineage(rows.withColumn("part", spread).repartition(buckets, "bucket", "part")
                        .groupBy("bucket", "part").applyInPandas(gather, shape))
    # the place of a list's first document tells which of equal lists has the earlier shingle
    whole = F.struct("docs", "sizes", "rests")
    lists = found.where(F.length("sizes") > 0).groupBy("sig").agg(F.min_by(whole, "first").alias("w")).select("sig", "w.*")
    return cut_lineage(lists), _pairs_of(found.where(F.length("sizes") == 0))


def _reach(n: np.ndarray, r: np.ndarray, threshold: int) -> np.ndarray:
    """The largest set with which a set of n shingles can reach the threshold
    when only r of its shingles can be common."""
    return (r.astype(np.int64) * (100 + threshold) - threshold * n.astype(np.int64)) // threshold


def _with_partners(post: np.ndarray, threshold: int) -> np.ndarray:
    """The postings that have another one of their shingle within reach."""
    post = post[np.lexsort((post["n"], post["t"]))]
    if not len(post):
        return post
    n, reach = post["n"].astype(np.int64), _reach(post["n"], post["r"], threshold)
    new = np.r_[True, post["t"][1:] != post["t"][:-1]]
    larger = np.r_[~new[1:] & (n[1:] <= reach[:-1]), False]
    # running maximum of reach inside a shingle, up to the row before
    group = np.cumsum(new) << 36
    before = np.r_[0, np.maximum.accumulate(reach + group)[:-1]] - group
    least = n[np.flatnonzero(new)][np.cumsum(new) - 1]
    smaller = ~new & (before >= n) & (least <= reach)
    return post[larger | smaller]


def _row(bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "data": pa.array([data], pa.binary())})


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _digest8(b: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_64_digest(b)


def _salted(post: np.ndarray, frequency: np.ndarray, split_at: int) -> np.ndarray:
    """Postings of very frequent shingles, dealt over salts; the batch's
    smallest document of each goes to every salt. Each pair of salts is a key
    of its own, so any two documents meet."""
    salts = frequency // split_at + 1
    hot = salts > 1
    if not hot.any():
        return post
    out = [post[~hot]]
    seen: set[int] = set()
    for p, s in zip(post[hot], salts[hot].tolist()):
        own = int(_mix(np.array([p["d"]]).astype(np.uint64))[0] % np.uint64(s))
        first = int(p["t"]) not in seen
        seen.add(int(p["t"]))
        for a in range(s) if first else [own]:
            for b in range(s):
                q = p.copy()
                q["t"] = _mix(np.array([int(p["t"]) ^ (min(a, b) * 65536 + max(a, b) + 1)], np.uint64))[0]
                out.append(np.array([q], POSTING))
    return np.concatenate(out)


def _pairs_of(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for data in b.column("docs").to_pylist():
                p = np.frombuffer(data, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"x": pa.array(p[:, 0]), "y": pa.array(p[:, 1])})

    return rows.select("docs").mapInArrow(run, "x long, y long")


def leader_pairs(lists: DataFrame, threshold: int) -> DataFrame:
    """(x, y): every document y with the smallest leader x within reach among
    its lists. One pair a document, whatever the lists' number."""
    def run(batches):
        for b in batches:
            xs, ys = [], []
            for d, n, r in zip(*(b.column(c).to_pylist() for c in ("docs", "sizes", "rests"))):
                d, n, reach = _list(d, n, r, threshold)
                y = d[1:][(n[1:] <= reach[0]) & (n[0] <= reach[1:]) & (d[1:] != d[0])]
                xs.append(np.full(len(y), d[0]))
                ys.append(y)
            x, y = np.concatenate(xs), np.concatenate(ys)
            order = np.lexsort((x, y))
            order = order[np.r_[True, y[order][1:] != y[order][:-1]][:len(order)]]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x[order]), "y": pa.array(y[order])})

    rows = lists.select("docs", "sizes", "rests").mapInArrow(run, "x long, y long")
    return rows.groupBy("y").agg(F.min("x").alias("x")).select("x", "y")


def verify(pairs: DataFrame, docs: DataFrame, tool, order, threshold: int, members: int = 400,
           broadcast_rows: int = 500_000) -> DataFrame:
    """The pairs (x, y) whose Jaccard reaches the threshold: partial overlaps
    counted fragment by fragment, summed per pair."""
    spark = docs.sparkSession
    total = pairs.count()
    salts = cut_lineage(pairs.groupBy("x").agg((F.count(F.lit(1)) / members + 1).cast("int").alias("s")))
    member = pairs.join(salts, "x").select(F.col("y").alias("doc_id"), F.col("x").alias("lead"),
                                           F.pmod(F.xxhash64("y"), F.col("s")).cast("int").alias("salt"))
    leader = salts.select(F.col("x").alias("doc_id"), F.col("x").alias("lead"),
                          F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"))
    need = cut_lineage(member.unionByName(leader).groupBy("doc_id").agg(
        F.collect_set(F.struct("lead", "salt")).alias("tasks")))
    # a list a document; sent to all executors only while few, else joined by shuffle
    small = need.limit(broadcast_rows + 1).count() <= broadcast_rows and total <= 4 * broadcast_rows
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(need) if small else need, "doc_id")
    groups = max(12, total // 2000)

    def cut(batches):
        shingler, o = tool(), order()
        for b in batches:
            cols = {k: [] for k in ("lead", "salt", "fragment", "doc_id", "set", "n", "data")}
            for i, s, tasks in zip(_ids(b.column("doc_id")), shingler.sets(b.column("text")), b.column("tasks").to_pylist()):
                f = o.fragment(s)
                own = int(np.frombuffer(_digest8(s.tobytes()), "<i8")[0])
                for k in range(len(o.pivots) + 1):
                    data = s[f == k].tobytes()
                    if not data:
                        continue
                    for x in tasks:
                        for c, v in zip(cols.values(), (x["lead"], x["salt"], k, i, own, len(s), data)):
                            c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(cols.items(), kinds)})

    pieces = texts.mapInArrow(cut, "lead long, salt int, fragment int, doc_id long, set long, n long, data binary")
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("lead", "salt"), F.lit(groups)).cast("int"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        # rows of one doc_id with equal sets count once; its other sets are pairs of their own
        pdf = pdf[~pdf.duplicated(["lead", "salt", "doc_id", "set"])]
        pdf = pdf.sort_values(["lead", "salt"], kind="stable")
        leads, salts, ids = (pdf[c].to_numpy() for c in ("lead", "salt", "doc_id"))
        own, n, data = pdf["set"].tolist(), pdf.n.tolist(), pdf.data.tolist()
        starts = np.flatnonzero(np.r_[True, (leads[1:] != leads[:-1]) | (salts[1:] != salts[:-1])][:len(pdf)]).tolist()
        got = []
        for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
            lead, first = int(leads[lo]), ids[lo:hi] == leads[lo]
            heads, members = (np.flatnonzero(first) + lo).tolist(), (np.flatnonzero(~first) + lo).tolist()
            if not heads or not members:
                continue
            parts = [data[i] for i in members]
            s = np.frombuffer(b"".join(parts), np.uint64)
            begin = np.cumsum([0, *(len(x) // 8 for x in parts[:-1])])
            for a in heads:
                h = np.frombuffer(data[a], np.uint64)
                common = h[np.minimum(np.searchsorted(h, s), len(h) - 1)] == s
                overlap = np.add.reduceat(common.astype(np.int64), begin).tolist()
                got += [(lead, int(ids[i]), own[a], own[i], n[a], n[i], v) for i, v in zip(members, overlap)]
        return pd.DataFrame(got, columns=["x", "y", "sx", "sy", "nx", "ny", "o"]).astype("int64")

    partial = pieces.groupBy("g", "fragment").applyInPandas(
        count, "x long, y long, sx long, sy long, nx long, ny long, o long")
    both = partial.groupBy("x", "y", "sx", "sy", "nx", "ny").agg(F.sum("o").alias("o"))
    return both.where(100 * F.col("o") >= threshold * (F.col("nx") + F.col("ny") - F.col("o"))).select("x", "y").distinct()


def _list(docs: bytes, sizes: bytes, rests: bytes, threshold: int):
    n = np.frombuffer(sizes, "<u4").astype(np.int64)
    return np.frombuffer(docs, "<i8"), n, _reach(n, np.frombuffer(rests, "<u4"), threshold)


def spanning(lists: DataFrame, components: DataFrame, hold: int = 1_000_000) -> DataFrame:
    """The lists (sig) whose documents lie in several components."""
    def packed(sig, d):
        order = np.argsort(d, kind="stable")
        sig, d = sig[order], d[order]
        at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        ends = pa.py_buffer((np.r_[at, len(d)] * 8).astype("<i4").tobytes())
        sigs = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(sig.tobytes())])
        return pa.RecordBatch.from_pydict({"d": pa.array(d[at]), "sigs": sigs})

    def by_document(batches):
        sig, docs, held = [], [], 0
        for b in batches:
            for s, d in zip(b.column("sig").to_pylist(), b.column("docs").to_pylist()):
                docs.append(np.frombuffer(d, "<i8"))
                sig.append(np.full(len(docs[-1]), s))
                held += len(docs[-1])
                if held > hold:
                    yield packed(np.concatenate(sig), np.concatenate(docs))
                    sig, docs, held = [], [], 0
        if held:
            yield packed(np.concatenate(sig), np.concatenate(docs))

    def bounds(sig, c):
        order = np.argsort(sig, kind="stable")
        sig, c = sig[order], c[order]
        at = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        return pa.RecordBatch.from_pydict({"sig": pa.array(sig[at]), "lo": pa.array(np.minimum.reduceat(c, at)),
                                           "hi": pa.array(np.maximum.reduceat(c, at))})

    def by_list(batches):
        sig, c, held = [], [], 0
        for b in batches:
            got = b.column("sigs").to_pylist()
            sig.append(np.frombuffer(b"".join(got), "<i8"))
            c.append(np.repeat(b.column("c").to_numpy(), [len(x) // 8 for x in got]))
            held += len(sig[-1])
            if held > hold:
                yield bounds(np.concatenate(sig), np.concatenate(c))
                sig, c, held = [], [], 0
        if held:
            yield bounds(np.concatenate(sig), np.concatenate(c))

    # dealt as the join needs them anyhow; also where Spark broadcasts the components, so that a task
    # never has two Python workers at once
    rows = lists.select("sig", "docs").mapInArrow(by_document, "d long, sigs binary").repartition("d")
    rows = rows.join(components.withColumnRenamed("id", "d"), "d", "left").select(
        "sigs", F.coalesce("component", "d").alias("c"))
    ends = rows.mapInArrow(by_list, "sig long, lo long, hi long")
    return ends.groupBy("sig").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("sig")


def open_pairs(lists: DataFrame, components: DataFrame, threshold: int, buckets: int, leaders: bool) -> DataFrame:
    """Pairs across components within reach inside ``lists``: with the leader
    only, or (once those are tested) all others."""
    def unpack(batches):
        for b in batches:
            for sig, d, n, r in zip(*(b.column(c).to_pylist() for c in ("sig", "docs", "sizes", "rests"))):
                d, n, reach = _list(d, n, r, threshold)
                yield pa.RecordBatch.from_pydict({"sig": pa.array(np.full(len(d), sig)), "d": pa.array(d),
                                                  "n": pa.array(n), "reach": pa.array(reach)})

    rows = lists.mapInArrow(unpack, "sig long, d long, n long, reach long")
    rows = rows.join(components.withColumnRenamed("id", "d"), "d", "left").withColumn(
        "c", F.coalesce("component", "d")).drop("component")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sig", "d"] if leaders else ["sig", "n"], kind="stable")
        sig, d, n, reach, c = (pdf[k].to_numpy() for k in ("sig", "d", "n", "reach", "c"))
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        found = set()
        for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(sig)].tolist()):
            if leaders:
                ok = (c[lo:hi] != c[lo]) & (n[lo:hi] <= reach[lo]) & (n[lo] <= reach[lo:hi])
                found.update((int(d[lo]), y) for y in d[lo:hi][ok].tolist())
                continue
            # by rising size: the larger partners of i are a run behind it
            ends = lo + np.searchsorted(n[lo:hi], reach[lo:hi], side="right")
            for i in np.flatnonzero(ends > np.arange(lo, hi) + 1).tolist():
                j = slice(lo + i + 1, int(ends[i]))
                ok = (c[j] != c[lo + i]) & (n[lo + i] <= reach[j])
                x = int(d[lo + i])
                found.update((min(x, y), max(x, y)) for y in d[j][ok].tolist())
        return pd.DataFrame(sorted(found), columns=["x", "y"], dtype="int64")

    g = F.pmod(F.xxhash64("sig"), F.lit(buckets * 8))
    return rows.withColumn("g", g).groupBy("g").applyInPandas(across, "x long, y long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = 80, bits: int = 22, fragments: int = 4,
                    postings: int = 2_000_000, split_at: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    ``postings``: about how many prefix postings a task gathers."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tool = share(spark, Shingler())
    sizes, sketch = measure(docs, tool, bits)
    buckets = int(max(12, sketch.sum(dtype=np.float64) * (100 - threshold) / 100 // postings))
    order = share(spark, Order(sketch, fragments))
    del sketch
    give_back()  # the driver's copies of the sketch
    lists, same = prefix_lists(docs, tool, order, threshold, buckets, split_at)
    edges = cut_lineage(verify(cut_lineage(leader_pairs(lists, threshold)), docs, tool, order, threshold).unionByName(same))
    components = _components(edges)
    for leaders in (True, False):
        lists = cut_lineage(lists.join(spanning(lists, components), "sig"))
        rest = cut_lineage(open_pairs(lists, components, threshold, buckets, leaders))
        if rest.limit(1).count():
            more = cut_lineage(verify(rest, docs, tool, order, threshold))
            if more.limit(1).count():
                edges = edges.unionByName(more)
                components = _components(edges)
    named = components.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))
    return sizes.join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _components(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("x").alias("src"), F.col("y").alias("dst")).where("src <> dst").distinct()
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return cut_lineage(connected_components(cut_lineage(nodes), e))
