"""Exact top-k over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .tiles import block_join, merge_best, usable


def pack_signs(v: np.ndarray) -> np.ndarray:
    """One bit per component (1: above zero), as bytes."""
    return np.packbits(v > 0, axis=1)


def segments(codes: np.ndarray, bits: int) -> tuple[np.ndarray, list[int]]:
    """Segments of 16 bits (the last may have fewer) as columns of numbers, and their widths."""
    padded = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    values = padded[:, 0::2].astype(np.int64) << 8 | padded[:, 1::2]
    widths = [min(16, bits - 16 * j) for j in range(values.shape[1])]
    return values >> (16 - np.array(widths)), widths


class Index:
    """One table per segment: codes sorted by the segment's value."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, bits: int):
        self.codes, self.ids, self.bits = codes, ids, bits
        values, self.widths = segments(codes, bits)
        self.orders = [np.argsort(values[:, j], kind="stable") for j in range(values.shape[1])]
        self.starts = [np.searchsorted(values[o, j], np.arange((1 << w) + 1)) for j, (o, w) in enumerate(zip(self.orders, self.widths))]
        self.flips: dict[tuple[int, int], np.ndarray] = {}

    def masks(self, width: int, radius: int) -> np.ndarray:
        if (width, radius) not in self.flips:
            self.flips[width, radius] = np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)
        return self.flips[width, radius]

    def search(self, code: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest codes of other ids, ties to smaller ids.

        Segments are probed at radius 0, then 1, and so on. Once segments 0..j have been probed at radius r, every code
        within ``m * r + j`` has been met: a farther segment each would add up to more. The search ends when
        the kth distance is not above that, so that ties at the kth distance are complete too.
        """
        (mine,), m = segments(code[None, :], self.bits)[0], len(self.widths)
        met = np.zeros(len(self.codes), bool)
        met[self.ids == own] = True
        places, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(max(self.widths) + 1):
            for j, w in enumerate(self.widths):
                if radius <= w:
                    probes = mine[j] ^ self.masks(w, radius)
                    a, b = self.starts[j][probes], self.starts[j][probes + 1]
                    n = b - a
                    at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    new = self.orders[j][at]
                    new = new[~met[new]]
                    met[new] = True
                    places = np.r_[places, new]
                    distances = np.r_[distances, np.bitwise_count(self.codes[new] ^ code).sum(axis=1, dtype=np.int64)]
                    best = np.lexsort((self.ids[places], distances))[:k]
                    # codes beyond the kth can never come back
                    places, distances = places[best], distances[best]
                if len(places) == k and distances[-1] <= m * radius + j:
                    return places, distances
        return places, distances


def hamming_tile(k: int):
    def tile(query_id: np.ndarray, queries: np.ndarray, vec_id: np.ndarray, rows: np.ndarray):
        codes = pack_signs(rows)
        order = np.lexsort((vec_id, *codes.T[::-1]))
        codes, vec_id = codes[order], vec_id[order]
        # different vectors of one id may have one code
        once = np.r_[True, (codes[1:] != codes[:-1]).any(axis=1) | (vec_id[1:] != vec_id[:-1])][:len(codes)]
        codes, vec_id = codes[once], vec_id[once]
        # of equal codes only the k + 1 smallest ids can be among the k nearest of anything
        new = np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)] if len(codes) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
        keep = np.arange(len(codes)) - first <= k
        index, out = Index(codes[keep], vec_id[keep], rows.shape[1]), []
        for i, code in zip(query_id, pack_signs(queries)):
            places, distances = index.search(code, i, k)
            out.append((np.full(len(places), i), index.ids[places], distances))
        return tuple(np.concatenate(c) for c in zip(*out))

    return tile


def hamming_nearest(vectors: DataFrame, k: int = 10, query_rows: int = 2048, data_rows: int = 65536) -> DataFrame:
    """``query_id, rank, vec_id, distance``: for every row whose vec_id is divisible by 50 its k nearest other rows.

    A code has one bit per component, set where it is above zero. Exact, ties to smaller vec_id. Every block of rows has
    its own index. Rows with a null id and vectors that are null, empty or hold null or non-finite components take
    no part; vectors of different lengths never meet; equal codes of one id count once.
    """
    rows = usable(vectors, zero=True).dropDuplicates(["vec_id", "v"])
    found = block_join(rows, hamming_tile(k), query_rows, data_rows).distinct()
    return merge_best(found, k, largest=False).withColumn("distance", F.col("score").cast("long")).drop("score")
