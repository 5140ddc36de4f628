"""Hashed sets of word shingles, computed for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers; hashes only have to agree between tasks.
BASE, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes hashed at once.
CHUNK = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 256)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, inverse)]
    return _powers[0], _powers[1]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, non-empty stretches of bytes.

    Works on pieces of whole stretches, so that the tables stay small whatever the length of a text.
    """
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK)))
        lo, hi = int(starts[at]), int(ends[to - 1])
        power, inverse = _tables(hi - lo)
        total = np.r_[np.uint64(0), np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[:hi - lo], dtype=np.uint64)]
        out[at:to] = mix((total[ends[at:to] - lo] - total[starts[at:to] - lo]) * inverse[starts[at:to] - lo])
        at = to
    return out


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of every text, A-Z lower-cased.

    Fewer words make one shingle of all; no words make none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    lengths = np.array([len(r) + 1 for r in raw], np.int64)
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[False, word].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    words = hash_spans(data, starts, ends)
    first = np.searchsorted(starts, np.r_[0, np.cumsum(lengths)])
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * BASE + words[j:len(words) - k + 1 + j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= k:
            out.append(np.unique(rolled[a:b - k + 1]))
        elif n:
            h = np.array([n], np.uint64)
            for w in words[a:b]:
                h = mix(h * BASE + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set."""
    both = mix(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s, initial=np.uint64(len(s)))], np.uint64))
    return int(mix(both[:1] * BASE + both[1:]).view(np.int64)[0])
