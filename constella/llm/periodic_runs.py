"""Periodic runs of a text's words, and texts with the repetitions cut out.

A run is a maximal stretch of words with smallest period ``q`` that holds at
least ``times`` periods and ``least`` words. Two structures over a group of
texts (one of the words, one of the words backwards) answer how far the words
from two places agree:

* only suffixes whose place modulo ``COVER`` lies in a difference cover are
  sorted, by their first ``COVER`` words and then by rank doubling (a sampled
  place plus a multiple of ``COVER`` is sampled again);
* any two places reach sampled places after the same few steps (at most
  ``COVER`` - 1 words, compared one by one); from there the answer is the least
  common prefix between their ranks, from a sparse table of range minima.

For every period the places of a harmonic grid are asked: a run of period q
holds a stretch of max(least, times * q) - q places that equal the place q
further on, so a grid of that step meets each run; the agreement forwards and
backwards from the grid place is the run. Grid places number about
n * log(n) / 2 for n words. A run found again with a multiple of its period is
dropped, since both have the same ends.

Texts are independent: the work is one pass over the input split, without a
shuffle. A task handles texts in groups of about ``GROUP`` words, a longer text
alone and whole, with about 200 bytes a word.

Defined cases: null and empty texts and texts of white space have no words and
no run; documents may repeat; a null id is kept; extra columns are ignored; an
empty table gives an empty result; among runs of equal exponent the smallest
start, then the smallest period counts as the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: fixed values: a perfect difference set, every difference modulo 31 occurs
COVER = 31
SAMPLED = (0, 1, 3, 8, 12, 18)
GROUP = 100_000
GRID = 1_000_000


def _meeting() -> np.ndarray:
    """For two residues, the smallest step that brings both into the cover."""
    inside = np.isin(np.arange(COVER), SAMPLED)
    meet = np.zeros((COVER, COVER), np.int64)
    for a in range(COVER):
        for b in range(COVER):
            meet[a, b] = next(s for s in range(COVER) if inside[(a + s) % COVER] and inside[(b + s) % COVER])
    return meet


class CommonPrefix:
    """How many values agree from two places on. ``values`` must end in a value
    that occurs once, and hold numbers from 1 on."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values = np.concatenate([values, np.zeros(COVER + 1, np.int64)])
        self.meet = _meeting()
        places = np.flatnonzero(np.isin(np.arange(n) % COVER, SAMPLED))
        self.sample = np.full(n + COVER + 1, -1, np.int64)
        self.sample[places] = np.arange(len(places))
        self._sort(places, n)

    def _sort(self, places, n):
        heads = np.lib.stride_tricks.sliding_window_view(self.values, COVER)[places].astype(">u4")
        rank = np.unique(np.ascontiguousarray(heads).view(f"S{4 * COVER}").ravel(), return_inverse=True)[1]
        levels, reach = [rank], COVER
        while len(places) and rank.max() + 1 < len(places):
            ahead = places + reach
            after = np.where(ahead < n, rank[self.sample[np.minimum(ahead, n)]] + 1, 0)
            rank = np.unique(rank * (len(places) + 1) + after, return_inverse=True)[1]
            levels.append(rank)
            reach *= 2
        self.rank = rank
        order = np.argsort(rank)
        self._range_minima(self._adjacent(places[order[:-1]], places[order[1:]], levels, n))

    def _adjacent(self, a, b, levels, n):
        """Common prefixes of neighbours in sorted order, from the ranks of the
        doubling rounds and the last few values."""
        a, b = a.copy(), b.copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < n) & (b < n)
            at, bt = self.sample[np.where(inside, a, 0)], self.sample[np.where(inside, b, 0)]
            step = np.where(inside & (levels[k][at] == levels[k][bt]), COVER << k, 0)
            a, b, common = a + step, b + step, common + step
        return common + self._walk(np.minimum(a, n), np.minimum(b, n), np.full(len(a), COVER))

    def _walk(self, a, b, most):
        """Agreeing values from a and b on, up to ``most`` (at most COVER)."""
        common = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        t = 0
        while len(live):
            live = live[self.values[a[live] + t] == self.values[b[live] + t]]
            t += 1
            common[live] = t
            live = live[most[live] > t]
        return common

    def _range_minima(self, least):
        self.table = [least]
        width = 1
        while 2 * width <= len(least):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = self.meet[a % COVER, b % COVER]
        common = self._walk(a, b, step)
        far = np.flatnonzero(common == step)
        at = self.sample[a[far] + step[far]]
        bt = self.sample[b[far] + step[far]]
        known = (at >= 0) & (bt >= 0)  # beyond the last value nothing agrees
        far, x, y = far[known], self.rank[at[known]], self.rank[bt[known]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            these = level == k
            left, right = low[these], high[these] - (1 << int(k))
            row = self.table[k]
            common[far[these]] += np.minimum(row[left], row[right])
        return common


def grid(lengths: np.ndarray, starts: np.ndarray, least: int, times: int):
    """(text, period, place) of all grid places, in parts of about GRID."""
    top = np.where(lengths >= least, lengths // times, 0)
    texts = np.repeat(np.arange(len(lengths)), top)
    periods = np.arange(len(texts)) - np.repeat(np.cumsum(top) - top, top) + 1
    steps = np.maximum(least, times * periods) - periods
    counts = -(-(lengths[texts] - periods) // steps)
    ends = np.cumsum(counts)
    done = 0
    while done < len(texts):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + GRID, "right")))
        part = slice(done, upto)
        c = counts[part]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        text = np.repeat(texts[part], c)
        yield text, np.repeat(periods[part], c), starts[text] + k * np.repeat(steps[part], c)
        done = upto


def runs_of(texts: list[np.ndarray], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each array of word numbers (from 1 on),
    by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not (lengths >= least).any():
        return found
    end = int(max(t.max() for t in texts if len(t))) + 1
    parts = [np.array([end])]  # a value of its own before, between and after the texts
    for k, t in enumerate(texts):
        parts += [t, np.array([end + 1 + k])]
    values = np.concatenate(parts).astype(np.int64)
    starts = np.cumsum(lengths + 1) - lengths
    last = len(values) - 1
    forwards, backwards = CommonPrefix(values), CommonPrefix(values[::-1].copy())
    rows = [np.zeros((4, 0), np.int64)]
    for text, q, place in grid(lengths, starts, least, times):
        keep = values[place] == values[place + q]
        text, q, place = text[keep], q[keep], place[keep]
        after = forwards(place, place + q)
        before = backwards(last - place + 1, last - place - q + 1)
        keep = after + before + q >= np.maximum(least, times * q)
        rows.append(np.stack([text[keep], (place - before - starts[text])[keep], (after + before + q)[keep], q[keep]]))
    rows = np.concatenate(rows, axis=1)
    text, start, length, q = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    first = np.ones(len(text), bool)  # the smallest period of each stretch
    first[1:] = (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    for t, row in zip(text[first].tolist(), zip(start[first].tolist(), length[first].tolist(), q[first].tolist())):
        found[t].append(row)
    for f in found:
        f.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for r in runs:  # by start, then period: the first of equals stays
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self) + 1
        return n


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    numbers = _Numbers()
    return [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, full: bool = True,
              order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, n_runs, start, length, period and exponent_milli of the
    run with the greatest exponent (null without a run), runs_sha256,
    collapsed_sha256 and, with ``full``, runs and the collapsed text. ``order``
    may give, for an id and its number of words, the word numbers to read
    instead of 0, 1, 2 ... (None: as they are)."""
    kind = dict(docs.dtypes)["doc_id"]
    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if full else ""

    def judge(ids, texts):
        runs = runs_of(_numbered(texts), least, times)
        best = [greatest(r) for r in runs]
        listed = ["".join(f"{s},{n},{q}\n" for s, n, q in r).encode() for r in runs]
        kept = [b" ".join(collapsed(t, r)) for t, r in zip(texts, runs)]
        cols = {
            "doc_id": ids,
            "n_words": pa.array([len(t) for t in texts], pa.int64()),
            "n_runs": pa.array([len(r) for r in runs], pa.int64()),
            "start": pa.array([b and b[0] for b in best], pa.int64()),
            "length": pa.array([b and b[1] for b in best], pa.int64()),
            "period": pa.array([b and b[2] for b in best], pa.int64()),
            "exponent_milli": pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
            "runs_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in listed], pa.string()),
            "collapsed_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if full:
            one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            cols["runs"] = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], pa.list_(one))
            cols["collapsed"] = pa.array([x.decode() for x in kept], pa.string())
        return pa.RecordBatch.from_pydict(cols)

    def run(batches):
        for batch in batches:
            ids, texts, begin, size = batch.column("doc_id"), [], 0, 0
            for row in range(batch.num_rows):
                words = (batch.column("text")[row].as_py() or "").encode().split()
                places = order(ids[row].as_py(), len(words)) if order and words else None
                texts.append(words if places is None else [words[i] for i in places.tolist()])
                size += len(words)
                if size >= GROUP:
                    yield judge(ids.slice(begin, row + 1 - begin), texts)
                    texts, begin, size = [], row + 1, 0
            if texts:
                yield judge(ids.slice(begin), texts)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
             f"runs_sha256 string, collapsed_sha256 string{more}")
