"""Suffix-array dedup: cut every byte covered by a 100-byte string that also
starts earlier (a smaller doc_id, or the same document at an earlier start).

Sorting all suffixes of a corpus would move each byte a hundred times. Only
anchored suffixes are sorted: in every 100-byte window the 24-byte string of
smallest hash is its anchor, so equal windows hold equal anchors at the same
offset, and about one byte in 39 starts an anchor.

1. Anchors (24-byte hash, doc_id, position) are dealt by hash; those whose hash
   occurs twice are candidates.
2. Candidates fetch their context, 76 bytes before and 100 from the anchor.
3. Contexts are dealt by anchor. Deep-shallow sorting puts the suffixes that
   start at the anchor in order, and the reversed prefixes that end there:
   multikey quicksort on eight-byte characters to a shallow depth, then one
   blind trie for each group that still shares its prefix. The longest common
   prefixes of neighbours then give, for every depth, the classes of equal
   strings; two windows that start ``b`` bytes before their anchors are equal
   when their reversed prefixes agree to depth b and their suffixes to 100 - b.
   In each class the earliest window stays, the others are covered.
4. Covered ranges go back to their documents.

Equal contexts inside a task are settled there (all but the earliest are
covered) and only the earliest travels on, so copies cost little. An anchor
that occurs more than ``hot`` times does not gather: its windows are dealt by
their own 128-bit hash, one class a key, again settled inside tasks first.

Texts travel packed (zstandard) in buckets of documents. Nothing is collected.

Defined cases: null text is empty; a row without doc_id is returned whole;
rows that repeat a doc_id are one document (they never cover each other); texts
shorter than 100 bytes are kept; extra columns are ignored by ``dedup`` and
carried along by ``cut_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constella.llm.common import give_back, text_bytes

SPAN = 100  # length of a repeated string
GRAM = 24  # length of an anchor, a multiple of 8
BEFORE = SPAN - GRAM  # a window starts at most so far before its anchor
SHALLOW = 40  # bytes sorted by multikey quicksort, a multiple of 8
WINDOWS = BEFORE + 1  # anchors a window can choose from
PLACE = 22  # bits of a position inside a segment
SEGMENT = 1 << 18
PIECE = 8_000_000  # bytes of text that a task handles at once
ROUND = 8_192  # contexts that are looked at and dropped at once
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


# ------------------------------------------------------------------ packing
def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any dtype as one zstandard frame."""
    import zstandard

    head = np.array([len(arrays)] + [a.nbytes for a in arrays], "<i8").tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 3)


def unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, "<i8", len(dtypes), 8)
    at, out = 8 * (1 + len(dtypes)), []
    for n, t in zip(sizes.tolist(), dtypes):
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


def pack_places(doc: np.ndarray, *more: np.ndarray) -> bytes:
    """Rows sorted by doc: ids as steps, which pack well."""
    return pack(np.diff(doc, prepend=np.int64(0)), *more)


def unpack_places(data: bytes, *dtypes) -> list[np.ndarray]:
    step, *more = unpack(data, "<i8", *dtypes)
    return [np.cumsum(step), *more]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * C3
    return h ^ (h >> np.uint64(29))


def bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64) * C1) % np.uint64(buckets)).astype(np.int64)


def split(where: np.ndarray, buckets: int):
    """(bucket, row numbers) of every bucket in use; rows keep their order."""
    order = np.argsort(where, kind="stable")
    ends = np.cumsum(np.bincount(where, minlength=buckets))
    for k in range(buckets):
        lo = ends[k - 1] if k else 0
        if ends[k] > lo:
            yield k, order[lo:ends[k]]


def table(bucket: list, kind: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "kind": pa.array(kind, pa.int32()),
                                       "data": pa.array(data, pa.binary())})


ROWS = "bucket int, kind int, data binary"


# ------------------------------------------------------------------ anchors
def words_at(buf: bytes, lo: int, n: int) -> np.ndarray:
    """The eight bytes from each of the positions lo .. lo + n - 1."""
    w = np.empty(n, "<u8")
    for o in range(min(8, n)):
        m = (n - o + 7) // 8
        w[o::8] = np.frombuffer(buf, "<u8", m, lo + o)
    return w


def gram_hash(buf: bytes, lo: int, n: int) -> np.ndarray:
    w = words_at(buf, lo, n + GRAM - 8)
    h = w[:n] * C1
    for k in range(8, GRAM, 8):
        h = mix(h + w[k:n + k] * C2)
    return mix(h)


def anchors(buf: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all anchors of the windows in buf[:size] and their hashes;
    buf has 16 spare bytes at its end. The leftmost of equal hashes wins."""
    found, hashes = [], []
    starts = size - SPAN + 1
    low = np.uint64((1 << PLACE) - 1)
    for s in range(0, max(starts, 0), SEGMENT):
        n = min(SEGMENT, starts - s) + WINDOWS - 1
        h = gram_hash(buf, s, n)
        m = (h & ~low) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOWS:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if WINDOWS > width:
            m = np.minimum(m[:len(m) - (WINDOWS - width)], m[WINDOWS - width:])
        p = (m & low).astype(np.int64)
        p = p[np.r_[True, p[1:] != p[:-1]]]
        found.append(p + s)
        hashes.append(h[p])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, h = np.concatenate(found), np.concatenate(hashes)
    keep = np.r_[True, p[1:] > p[:-1]]
    return p[keep], h[keep]


class Texts:
    """Texts of some documents, in order of doc_id, as one buffer."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        order = np.argsort(ids, kind="stable")
        self.ids, texts = ids[order], [texts[i] for i in order]
        self.size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.total = int(self.end[-1]) if len(texts) else 0
        self.buf = b"\0" * SPAN + b"".join(texts) + b"\0" * (2 * SPAN)

    def contexts(self, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes around anchors, zero outside the document, and how many
        lie inside before and from the anchor."""
        b = np.frombuffer(self.buf, np.uint8)
        left = np.minimum(pos, BEFORE)
        right = np.minimum(self.size[row] - pos, SPAN)
        # rows of a view: no position of a single byte is written down
        out = np.lib.stride_tricks.sliding_window_view(b, BEFORE + SPAN)[SPAN - BEFORE + self.start[row] + pos]
        at = np.arange(-BEFORE, SPAN)
        edge = np.flatnonzero((left < BEFORE) | (right < SPAN))
        for s in range(0, len(edge), ROUND):
            r = edge[s:s + ROUND]
            out[r] = np.where((at < -left[r, None]) | (at >= right[r, None]), np.uint8(0), out[r])
        return out, left.astype(np.uint8), right.astype(np.uint8)


def key128(ctx: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = ctx.view("<u8")
    a = left.astype(np.uint64) * C2 + right.astype(np.uint64)
    b = a * C3 + C1
    for k in range(w.shape[1]):
        a, b = mix(a * C1 + w[:, k]), mix((b ^ w[:, k]) * C2 + C1)
    return a, b


def settle(ctx, left, right, doc, pos):
    """Equal contexts: (rows that travel on, covered ranges of the others).
    Rows are in order of (doc, pos)."""
    a, b = key128(ctx, left, right)
    order = np.lexsort((np.arange(len(a)), b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(a) else np.zeros(0, bool)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else order
    first = np.empty(len(a), np.int64)
    first[order] = head
    other = (doc[first] != doc) | (pos[first] != pos)
    lo, hi = pos - left, pos + right
    gone = other & (hi - lo >= SPAN)
    return np.flatnonzero(~other), (doc[gone], lo[gone], hi[gone])


def covered(doc, lo, hi, buckets: int, kind: int = 2):
    """Rows of covered ranges, dealt to their documents' buckets."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    out = [(k, pack_places(doc[r], lo[r].astype("<i8"), hi[r].astype("<i8")))
           for k, r in split(bucket_of(doc, buckets), buckets)]
    return table([k for k, _ in out], [kind] * len(out), [d for _, d in out])


# ------------------------------------------------- deep-shallow suffix sorting
def deep_shallow(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of fixed-width byte strings and, for each but the first, the
    common prefix with its predecessor."""
    n, width = strings.shape
    chars = np.zeros((n, -(-width // 8) * 8), np.uint8)
    chars[:, :width] = strings
    chars = chars.view(">u8")
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of the row at each place of the order
    for k in range(SHALLOW // 8):  # multikey quicksort: one character, inside tied groups only
        tied = np.flatnonzero(np.r_[False, group[1:] == group[:-1]] | np.r_[group[1:] == group[:-1], False])
        if not len(tied):
            break
        rows = order[tied]
        key = chars[rows, k].astype(np.uint64)
        by = np.lexsort((key, group[tied]))
        order[tied] = rows[by]
        value = np.zeros(n, np.uint64)
        value[tied] = key[by]
        group = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    for lo, m in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        rows = order[lo:lo + m]
        tails = [t.tobytes() for t in strings[rows]]
        if tails.count(tails[0]) != m:
            order[lo:lo + m] = rows[blind_trie(tails)]
    same = np.zeros(max(n - 1, 0), np.int64)
    for s in range(0, n - 1, 100_000):
        a, b = strings[order[s:s + 100_000]], strings[order[s + 1:s + 100_001]]
        differ = a[:len(b)] != b
        same[s:s + len(b)] = np.where(differ.any(1), differ.argmax(1), width)
    return order, same


def blind_trie(strings: list[bytes]) -> list[int]:
    """Sorted order of strings of equal length. Inner nodes hold only a depth
    and their branches by the byte there; the bytes skipped are not stored. A
    new string descends blindly to some leaf, its common prefix with that leaf
    tells where it branches off, and a second descent puts it there."""
    width = len(strings[0])
    root: list = [width, None, [0]]  # [depth, branches, members]; a leaf has depth = width
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[1] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[2][0]]
        if s == other:
            node[2].append(i)
            continue
        x = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        depth = width - (x.bit_length() + 7) // 8
        node, above = root, None
        while node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if node[0] == depth and node[1] is not None:
            node[1][s[depth]] = [width, None, [i]]
        else:
            branch = [depth, {other[depth]: node, s[depth]: [width, None, [i]]}, None]
            if above is None:
                root = branch
            else:
                above[1][s[above[0]]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[1] is None:
            out.extend(node[2])
        else:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
    return out


def matched(ctx, left, right, doc, pos):
    """Covered ranges of contexts in order of (doc, pos), no two equal."""
    n = len(doc)
    sides = []
    for strings in (ctx[:, :BEFORE][:, ::-1], ctx[:, BEFORE:]):
        order, same = deep_shallow(np.ascontiguousarray(strings))
        near = np.zeros(n, np.int64)  # longest common prefix with any other string
        near[order[1:]] = same
        near[order[:-1]] = np.maximum(near[order[:-1]], same)
        sides.append((order, same, near))
    live = np.flatnonzero(sides[0][2] + sides[1][2] >= SPAN)
    least, most = np.full(n, WINDOWS), np.full(n, -1)
    if len(live):
        classes = np.empty((2, n), np.int64)
        for b in range(WINDOWS):
            for side, depth in ((0, b), (1, SPAN - b)):
                order, same, _ = sides[side]
                classes[side, order] = np.cumsum(np.r_[0, same < depth])
            rows = live[(left[live] >= b) & (right[live] >= SPAN - b)]
            key = classes[0, rows] * n + classes[1, rows]
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            head = rows[first][back]
            hit = rows[(doc[head] != doc[rows]) | (pos[head] != pos[rows])]
            least[hit] = np.minimum(least[hit], b)
            most[hit] = b
    hit = np.flatnonzero(most >= 0)
    return doc[hit], pos[hit] - most[hit], pos[hit] + SPAN - least[hit]


# ------------------------------------------------------------------ the job
def pieces(batches, size: int = PIECE):
    """(ids, texts) of stretches of rows with at most ``size`` bytes of text, or
    one row; what a stretch needed is handed back before the next."""
    for b in batches:
        give_back()
        ids = b.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        texts = b.column("text").cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
            yield ids[lo:hi], [t or b"" for t in texts.slice(lo, hi - lo).to_pylist()]
            lo = hi
    give_back()


def _text_rows(batches, buckets: int):
    """Texts packed by bucket of doc_id (kind 0)."""
    for ids, texts in pieces(batches):
        out = []
        for k, rows in split(bucket_of(ids, buckets), buckets):
            part = [texts[i] for i in rows]
            out.append((k, pack(ids[rows], np.array([len(t) for t in part], "<i8"), np.frombuffer(b"".join(part), np.uint8))))
        yield table([k for k, _ in out], [0] * len(out), [d for _, d in out])


def _read_texts(rows: pd.DataFrame) -> Texts:
    ids, texts = [], []
    for data in rows.data:
        i, n, raw = unpack(data, "<i8", "<i8", np.uint8)
        ends = np.cumsum(n)
        raw = raw.tobytes()
        ids.append(i)
        texts += [raw[a:b] for a, b in zip((ends - n).tolist(), ends.tolist())]
    return Texts(np.concatenate(ids) if ids else np.zeros(0, np.int64), texts)


def _anchor_rows(batches, buckets: int):
    """Anchors by bucket of their hash (kind 1) and ranges settled here (2)."""
    for ids, texts in pieces(batches):
        t = Texts(ids, texts)
        del texts
        p, h = anchors(memoryview(t.buf)[SPAN:], t.total)
        row = np.searchsorted(t.end, p, side="right")
        pos = p - t.start[row] if len(p) else p
        inside = pos + GRAM <= t.size[row] if len(p) else np.zeros(0, bool)
        row, pos, h = row[inside], pos[inside], h[inside]
        keep, gone = [], []
        for s in range(0, len(row), ROUND):  # in order, so the earliest context comes first
            ctx, left, right = t.contexts(row[s:s + ROUND], pos[s:s + ROUND])
            keep.append(np.stack([*key128(ctx, left, right), left.astype(np.uint64), right.astype(np.uint64)]))
        if not keep:
            continue
        a, b2, left, right = np.concatenate(keep, axis=1)
        order = np.lexsort((np.arange(len(a)), b2, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b2[order][1:] != b2[order][:-1])]
        first = np.empty(len(a), np.int64)
        first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        doc = t.ids[row]
        other = (doc[first] != doc) | (pos[first] != pos)
        lo, hi = pos - left.astype(np.int64), pos + right.astype(np.int64)
        gone = other & (hi - lo >= SPAN)
        if gone.any():
            yield covered(doc[gone], lo[gone], hi[gone], buckets)
        on = np.flatnonzero(~other)
        out = []
        for k, r in split((h[on] >> np.uint64(16)).astype(np.int64) % buckets, buckets):
            r = on[r]
            out.append((k, pack_places(doc[r], pos[r].astype("<i8"), (h[r] >> np.uint64(32)).astype("<u4"),
                                       (h[r] >> np.uint64(16)).astype("<u2"))))
        yield table([k for k, _ in out], [1] * len(out), [d for _, d in out])


def _ranges_of(pdf: pd.DataFrame) -> list:
    rows = pdf[pdf.kind == 2]
    return list(zip(rows.bucket.tolist(), rows.kind.tolist(), rows.data))


def _candidates(pdf: pd.DataFrame, buckets: int, hot: int) -> pd.DataFrame:
    """Anchors whose hash occurs twice, back to their documents' buckets (kind
    3; more than ``hot`` times: kind 4). Ranges (kind 2) pass through."""
    out = _ranges_of(pdf)
    parts = [unpack_places(d, "<i8", "<u4", "<u2") for d in pdf.data[pdf.kind == 1]]
    if not parts:
        return pd.DataFrame(out, columns=["bucket", "kind", "data"])
    doc, pos = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    h = np.concatenate([(x[2].astype(np.uint64) << np.uint64(16)) | x[3] for x in parts])
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    size = np.diff(np.r_[np.flatnonzero(new), len(h)])
    count = np.empty(len(h), np.int64)
    count[order] = np.repeat(size, size)
    for kind, rows in ((3, np.flatnonzero((count > 1) & (count <= hot))), (4, np.flatnonzero(count > hot))):
        rows = rows[np.lexsort((pos[rows], doc[rows]))]
        out += [(k, kind, pack_places(doc[rows[r]], pos[rows[r]]))
                for k, r in split(bucket_of(doc[rows], buckets), buckets)]
    return pd.DataFrame(out, columns=["bucket", "kind", "data"])


def _contexts(texts: pd.DataFrame, places: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Contexts of candidates by bucket of their anchor (kind 5), windows of hot
    anchors by bucket of their hash (6), ranges settled here (2)."""
    t, out = _read_texts(texts), _ranges_of(places)

    def ranges(doc, lo, hi):
        if len(doc):
            r = covered(doc, lo, hi, buckets)
            out.extend(zip(r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2).to_pylist()))

    for kind in (3, 4):
        parts = [unpack_places(d, "<i8") for d in places.data[places.kind == kind]]
        if not parts or not len(t.ids):
            continue
        doc, pos = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        # a repeated doc_id: every row of it that reaches this far
        lo, hi = np.searchsorted(t.ids, doc), np.searchsorted(t.ids, doc, side="right")
        take = np.repeat(np.arange(len(doc)), hi - lo)
        row = np.arange(len(take)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[take]
        doc, pos = doc[take], pos[take]
        ok = pos + GRAM <= t.size[row]
        row, doc, pos = row[ok], doc[ok], pos[ok]
        ctx, left, right = t.contexts(row, pos)
        on, gone = settle(ctx, left, right, doc, pos)
        ranges(*gone)
        ctx, left, right, doc, pos = ctx[on], left[on], right[on], doc[on], pos[on]
        if kind == 3:
            gram = np.ascontiguousarray(ctx[:, BEFORE:BEFORE + GRAM]).view("<u8")
            h = mix(gram[:, 0] * C1 + gram[:, 1] * C2 + gram[:, 2] * C3)
            for k, r in split((h >> np.uint64(16)).astype(np.int64) % buckets, buckets):
                out.append((k, 5, pack_places(doc[r], pos[r], left[r], right[r], ctx[r].reshape(-1))))
            continue
        for b in range(WINDOWS):
            rows = np.flatnonzero((left >= b) & (right >= SPAN - b))
            w = np.zeros((len(rows), SPAN + 4), np.uint8)
            w[:, :SPAN] = ctx[rows, BEFORE - b:BEFORE - b + SPAN]
            zero = np.zeros(len(rows), np.uint8)
            full = np.full(len(rows), SPAN, np.uint8)
            on, gone = settle(w, zero, full, doc[rows], pos[rows] - b)
            ranges(*gone)
            a, c = key128(w[on], zero[on], full[on])
            for k, r in split((a >> np.uint64(16)).astype(np.int64) % buckets, buckets):
                out.append((k, 6, pack_places(doc[rows[on[r]]], pos[rows[on[r]]] - b, a[r], c[r])))
    return pd.DataFrame(out, columns=["bucket", "kind", "data"])


def _match(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Ranges covered by earlier windows (kind 2)."""
    out = _ranges_of(pdf)

    def ranges(doc, lo, hi):
        if len(doc):
            r = covered(doc, lo, hi, buckets)
            out.extend(zip(r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2).to_pylist()))

    parts = [unpack_places(d, "<i8", np.uint8, np.uint8, np.uint8) for d in pdf.data[pdf.kind == 5]]
    if parts:
        doc, pos, left, right, ctx = (np.concatenate([x[i] for x in parts]) for i in range(5))
        del parts
        order = np.lexsort((pos, doc))
        doc, pos, left, right, ctx = doc[order], pos[order], left[order], right[order], ctx.reshape(len(order), -1)[order]
        on, gone = settle(ctx, left, right, doc, pos)
        ranges(*gone)
        ctx = ctx[on]
        ranges(*matched(ctx, left[on].astype(np.int64), right[on].astype(np.int64), doc[on], pos[on]))
        del ctx
    parts = [unpack_places(d, "<i8", "<u8", "<u8") for d in pdf.data[pdf.kind == 6]]
    if parts:
        doc, pos, a, c = (np.concatenate([x[i] for x in parts]) for i in range(4))
        order = np.lexsort((pos, doc, c, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])]
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = order[(doc[head] != doc[order]) | (pos[head] != pos[order])]
        ranges(doc[hit], pos[hit], pos[hit] + SPAN)
    return pd.DataFrame(out, columns=["bucket", "kind", "data"])


def _cut(texts: pd.DataFrame, places: pd.DataFrame, keep_text: bool) -> pd.DataFrame:
    """Digest (and text) of every document of a bucket."""
    t = _read_texts(texts)
    if not len(t.ids):
        return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "given"] * keep_text)
    starts, ends, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for data in places.data:
        doc, lo, hi = unpack_places(data, "<i8", "<i8")
        a, b = np.searchsorted(t.ids, doc), np.searchsorted(t.ids, doc, side="right")
        take = np.repeat(np.arange(len(doc)), b - a)
        row = np.arange(len(take)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[take]
        lo, hi = np.minimum(lo[take], t.size[row]), np.minimum(hi[take], t.size[row])
        some = lo < hi
        row = row[some]
        starts.append(t.start[row] + lo[some])
        ends.append(t.start[row] + hi[some])
        rows.append(row)
    lo, hi, row = np.concatenate(starts), np.concatenate(ends), np.concatenate(rows)
    order = np.argsort(lo, kind="stable")
    lo, hi, row = lo[order], hi[order], row[order]
    # ranges that overlap or touch in a document are one run
    new = np.flatnonzero(np.r_[True, (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (row[1:] != row[:-1])][:len(lo)])
    lo, hi, row = lo[new], np.maximum.reduceat(hi, new) if len(new) else hi, row[new]
    before = np.r_[0, np.cumsum(hi - lo)]  # bytes in the runs before each
    upto = np.searchsorted(row, np.arange(len(t.ids)), side="right")
    below = np.searchsorted(row, np.arange(len(t.ids)))
    keep = np.ones(t.total, bool)
    for a, b in zip(lo.tolist(), hi.tolist()):
        keep[a:b] = False
    text = memoryview(t.buf)[SPAN:SPAN + t.total]
    kept = np.frombuffer(text, np.uint8)[keep].tobytes()
    del keep
    cut = [kept[a:b] for a, b in zip((t.start - before[below]).tolist(), (t.end - before[upto]).tolist())]
    out = pd.DataFrame({"doc_id": t.ids, "n_bytes": t.size, "n_removed": before[upto] - before[below], "n_spans": upto - below,
                        "kept_sha256": [hashlib.sha256(x).hexdigest() for x in cut]})
    if keep_text:
        out["kept"] = cut
        out["given"] = [hashlib.md5(text[a:b]).hexdigest() for a, b in zip(t.start.tolist(), t.end.tolist())]
    return out


def _one(work):
    return lambda frame: work(frame)


def _two(work):
    return lambda left, right: work(left, right)


def dedup(docs: DataFrame, keep_text: bool = True, bucket_bytes: int = 8_000_000, hot: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``keep_text``, the kept bytes and the md5 of the given ones."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = d.where("doc_id IS NULL")
    d = d.where("doc_id IS NOT NULL")
    buckets = max(12, text_bytes(d) // bucket_bytes)
    by = lambda rows: rows.repartition(buckets, "bucket").groupBy("bucket")

    def tidy(work):
        def run(*frames):
            give_back()
            out = work(*frames)
            del frames
            give_back()
            return out
        return run

    texts = d.mapInArrow(lambda it: _text_rows(it, buckets), ROWS).repartition(buckets, "bucket")
    first = d.mapInArrow(lambda it: _anchor_rows(it, buckets), ROWS)
    places = by(first).applyInPandas(_one(tidy(lambda p: _candidates(p, buckets, hot))), ROWS)
    fetched = texts.groupBy("bucket").cogroup(by(places)).applyInPandas(_two(tidy(lambda a, b: _contexts(a, b, buckets))), ROWS)
    gone = by(fetched).applyInPandas(_one(tidy(lambda p: _match(p, buckets))), ROWS)
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, given string" * keep_text
    out = texts.groupBy("bucket").cogroup(by(gone)).applyInPandas(_two(tidy(lambda a, b: _cut(a, b, keep_text))), shape)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rest = whole.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                        F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"),
                        *([text.alias("kept"), F.md5(text).alias("given")] if keep_text else []))
    return out.unionByName(rest)


def cut_repeats(docs: DataFrame, **tuning) -> DataFrame:
    """``docs`` with the repeats cut out of text (a character that loses some
    of its bytes goes) and n_chars, where present, counted anew."""
    kept = dedup(docs, **tuning).select("doc_id", "given", "kept").dropDuplicates(["doc_id", "given"])

    def text(batches):
        for b in batches:
            give_back()
            yield pa.RecordBatch.from_pydict({
                "__doc": b.column("doc_id"), "__given": b.column("given"),
                "__text": pa.array([x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()], pa.string())})
        give_back()

    kept = kept.mapInArrow(text, "__doc long, __given string, __text string")
    digest = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    on = (docs["doc_id"].cast("long") == kept["__doc"]) & (digest == kept["__given"])
    new = {"text": F.when(docs["text"].isNull(), docs["text"]).otherwise(F.coalesce(kept["__text"], docs["text"]))}
    out = docs.join(kept, on, "left")
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])
