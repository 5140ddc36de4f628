"""Runs of periodic words, by internal pattern matching on a suffix array.

A run with smallest period q and at least ``max(12, 2q)`` words repeats a stretch of at least 6 words at distance q, so texts
without such a repeat are set aside first. For the others, every dyadic block of b words asks where it occurs again 2b-1 to 4b-2
words on (1 to 6 for b = 2): a run of such a period holds a block on the grid and its copy one period on. The answers come
from range successor queries in a wavelet matrix over the suffix array; distances are candidate periods, checked by longest common extensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes
from .shingles import _SPACE, hash_spans

#: Fixed value: a run has at least this many words.
LEAST = 12
#: Words of one round of work; a longer text is a round of its own.
ROUND = 1 << 16
RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string"


class Ranks:
    """Suffix array of word numbers, with the rank of every stretch of 1, 2, 4, ... words.

    The rank of a stretch is the number of suffixes before the first one that begins with it, so
    ``[rank, rank + count)`` is its interval in the suffix array. Stretches end with their text, never beyond.
    """

    def __init__(self, words: np.ndarray, stops: np.ndarray):
        n = self.n = len(words)
        self.levels = []
        key = words.astype(np.int64)
        step = 1
        while True:
            order = np.argsort(key, kind="stable")
            new = np.r_[True, np.diff(key[order]) != 0]
            first = np.flatnonzero(new)
            rank = np.empty(n, np.int32)
            rank[order] = np.repeat(first, np.diff(np.r_[first, n])).astype(np.int32)
            self.levels.append(rank)
            if len(first) == n or step >= n:
                break
            ahead = np.arange(n) + step
            inside = ahead < stops
            after = np.where(inside, rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
            key = rank.astype(np.int64) * (n + 1) + after
            step *= 2
        self.order = order.astype(np.int32)

    def intervals(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self.levels[level]
        count = np.bincount(rank, minlength=self.n)
        return rank[at], rank[at] + count[rank[at]]

    def common(self, a: np.ndarray, b: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``a`` and ``b`` (a < b, one text, b up to its end ``stops``) have in common."""
        a, b = a.copy(), b.copy()
        begun = a.copy()
        for k in reversed(range(len(self.levels))):
            rank, size = self.levels[k], 1 << k
            # only the last level may hold for longer stretches still; ranks of stretches cut by the end never agree
            while True:
                fits = b + size <= stops
                same = fits & (rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)])
                a += same * size
                b += same * size
                if k < len(self.levels) - 1 or not same.any():
                    break
        return a - begun


class Positions:
    """A wavelet matrix over the suffix array: next position at or behind x in an interval of suffixes."""

    def __init__(self, order: np.ndarray):
        self.width = max(1, int(len(order) - 1).bit_length())
        self.planes, now = [], order.astype(np.uint32)
        for p in reversed(range(self.width)):
            bit = (now >> p) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            packed = np.r_[packed, np.zeros(16 - len(packed) % 8, np.uint8)].view("<u8")
            before = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]].astype(np.int32)
            self.planes.append((packed, before, int(len(now) - bit.sum())))
            now = np.concatenate((now[~bit], now[bit]))

    @staticmethod
    def _ones(plane, i: np.ndarray) -> np.ndarray:
        packed, before, _ = plane
        at = i >> 6
        rest = packed[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return before[at] + np.bitwise_count(rest)

    def _below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values in [lo, hi) are less than x."""
        found = np.zeros(len(lo), np.int64)
        for p, plane in zip(reversed(range(self.width)), self.planes):
            one = (x >> p) & 1 == 1
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            found += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, plane[2] + a, lo - a), np.where(one, plane[2] + b, hi - b)
        return found

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value of at least x in [lo, hi), -1 where there is none."""
        lo, hi, x = lo.astype(np.int64), hi.astype(np.int64), x.astype(np.int64)
        k = np.where(x < 1 << self.width, self._below(lo, hi, np.minimum(x, (1 << self.width) - 1)), hi - lo)
        none = k >= hi - lo
        value = np.zeros(len(lo), np.int64)
        k = np.where(none, 0, k)
        for p, plane in zip(reversed(range(self.width)), self.planes):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            zeros = (hi - b) - (lo - a)
            one = k >= zeros
            value += one.astype(np.int64) << p
            k -= np.where(one, zeros, 0)
            lo, hi = np.where(one, plane[2] + a, lo - a), np.where(one, plane[2] + b, hi - b)
        return np.where(none, -1, value)


def runs_of(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of several texts laid end to end: first word, end, smallest period, by (first word, period).

    Equal numbers are equal words; words of different texts have different numbers.
    """
    none = (np.zeros(0, np.int64),) * 3
    n = len(words)
    if n < LEAST:
        return none
    ends = np.cumsum(lengths)
    begin, stop = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
    forward = Ranks(words, stop)
    places = Positions(forward.order)
    blocks, shifts = [], []
    for level in range(1, len(forward.levels)):
        b = 1 << level
        least, most = (1 if level == 1 else 2 * b - 1), 4 * b - 2
        at = np.arange(0, n - b + 1, b)
        lo, hi = forward.intervals(level, at)
        open_ = (hi - lo > 1) & (at + b <= stop[at])
        at, lo, hi = at[open_], lo[open_], hi[open_]
        x, last = at + least, np.full(len(at), -1)
        while len(at):
            found = places.successor(lo, hi, x)
            near = (found >= 0) & (found - at <= most)
            at, lo, hi, last, found = at[near], lo[near], hi[near], last[near], found[near]
            if not len(at):
                break
            blocks.append(at)
            shifts.append(found - at)
            # neighbouring answers at most half a block apart form a progression whose step is a period r of the block. If
            # all words from the block to there have that period, distances are multiples of r until it breaks: go on from the break
            step = found - last
            x = found + 1
            r = np.where((last >= 0) & (step <= b // 2), step, 0)
            some = np.flatnonzero(r)
            if len(some):
                reach = at[some] + r[some] + forward.common(at[some], at[some] + r[some], stop[at[some]])
                inside = reach >= found[some] + b
                x[some[inside]] = np.maximum(x[some[inside]], reach[inside] - b + 1)
            last = found
    if not blocks:
        return none
    at, q = np.divmod(np.unique(np.concatenate(blocks) * (n + 1) + np.concatenate(shifts)), n + 1)
    right = forward.common(at, at + q, stop[at])
    backward = Ranks(words[::-1].copy(), (n - begin)[::-1].copy())
    # words before ``at`` and ``at + q``, read backwards: positions n - at - q (the earlier one there) and n - at
    some = at > begin[at]
    left = np.zeros(len(at), np.int64)
    left[some] = backward.common(n - at[some] - q[some], n - at[some], n - begin[at[some]])
    first, end = at - left, at + q + right
    good = end - first >= np.maximum(LEAST, 2 * q)
    first, end, q = first[good], end[good], q[good]
    # equal stretches: the smallest period counts
    order = np.lexsort((q, end, first))
    first, end, q = first[order], end[order], q[order]
    keep = np.r_[True, (np.diff(first) != 0) | (np.diff(end) != 0)][:len(first)]
    first, end, q = first[keep], end[keep], q[keep]
    order = np.lexsort((q, first))
    return first[order], end[order], q[order]


def _repeats(words: np.ndarray, lengths: np.ndarray, k: int = LEAST // 2) -> np.ndarray:
    """Which texts hold a stretch of ``k`` words twice."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    if len(words) < k:
        return np.zeros(len(lengths), bool)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (words[j:len(words) - k + 1 + j] ^ (words[j:len(words) - k + 1 + j] >> np.uint64(29)))
    whole = doc[:len(h)] == doc[k - 1:]
    h, doc = h[whole], doc[:len(whole)][whole]
    h = h ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(h, kind="stable")
    twice = np.flatnonzero(h[order][1:] == h[order][:-1])
    out = np.zeros(len(lengths), bool)
    out[doc[order[twice]]] = True
    return out


def _round(texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """Runs and text without repeats, text by text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[False, ~_SPACE[data]].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    cuts = np.searchsorted(starts, np.r_[0, np.cumsum([len(r) + 1 for r in raw])])
    lengths = np.diff(cuts)
    hashes = hash_spans(data, starts, ends)
    again = _repeats(hashes, lengths)
    held = np.repeat(again, lengths)
    of = np.repeat(np.arange(len(texts)), lengths)[held]
    # equal words of one text get one number
    kept = hashes[held]
    order = np.lexsort((kept, of))
    numbers = np.empty(len(kept), np.int64)
    numbers[order] = np.cumsum(np.r_[False, (np.diff(of[order]) != 0) | (np.diff(kept[order].view(np.int64)) != 0)][:len(kept)])
    sizes = lengths[again]
    first, end, period = runs_of(numbers, sizes)
    begins = np.cumsum(sizes) - sizes
    covered = np.zeros(len(kept) + 1, np.int64)
    np.add.at(covered, first + period, 1)
    np.add.at(covered, end, -1)
    dropped = np.cumsum(covered)[:-1] > 0
    where = np.searchsorted(first, np.r_[begins, len(kept)])
    place = np.cumsum(again) - 1
    for i, t in enumerate(raw):
        span = slice(cuts[i], cuts[i + 1])
        words, runs = t.split(), []
        if again[i]:
            at = int(begins[place[i]])
            of_text = slice(where[place[i]], where[place[i] + 1])
            runs = list(zip((first[of_text] - at).tolist(), (end - first)[of_text].tolist(), period[of_text].tolist()))
            out = dropped[at:at + span.stop - span.start]
            if runs:
                words = [w for w, d in zip(words, out.tolist()) if not d]
        yield runs, b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, text``: all runs of every text (start, length, period in words, by start, then period), and the words
    that no run holds behind its first period, joined by one space.

    A run is a stretch of at least ``max(12, 2 * period)`` words whose words equal those one period on, and
    that no neighbouring word extends; its period is the smallest. Null and empty texts have no run and an empty text; rows
    stay as they are many; other columns are not read. A text is worked on by one task, with about 150 bytes a word.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, run in by_bytes(b.column(1), ROUND * 6):
                found = list(_round(run))
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r, _ in found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(run)), pa.array(rows, schema.types[1]), pa.array([t for _, t in found], pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, RUNS)
