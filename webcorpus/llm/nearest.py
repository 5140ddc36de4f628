"""Nearest vectors by a block matrix join: int8 products with error bounds, survivors recomputed in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .tiles import block_join, merge_best, usable


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8 (held as float32, in which sums of products stay exact), their steps, and the norms of row and error."""
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    step = np.maximum(np.abs(unit).max(axis=1) / 127, 1e-300)
    whole = np.rint(unit / step[:, None])
    return whole.astype(np.float32), step, np.linalg.norm(whole, axis=1) * step, np.linalg.norm(unit - whole * step[:, None], axis=1)


def cosine_tile(k: int):
    def tile(query_id: np.ndarray, queries: np.ndarray, vec_id: np.ndarray, rows: np.ndarray):
        # rows of one id side by side: an id takes one of the k places, with its best row
        side = np.argsort(vec_id, kind="stable")
        vec_id, rows = vec_id[side], rows[side]
        begin = np.flatnonzero(np.r_[True, vec_id[1:] != vec_id[:-1]])
        # scaled first, so that neither tiny nor huge components lose the norm
        queries, rows = (x / np.abs(x).max(axis=1, keepdims=True) for x in (queries, rows))
        qi, qs, qn, qe = quantise(queries)
        ri, rs, rn, re = quantise(rows)
        qnorm, rnorm = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((rows * rows).sum(axis=1))
        out = []
        for a in range(0, len(query_id), 256):
            sl = slice(a, a + 256)
            near = (qi[sl] @ ri.T) * qs[sl, None] * rs[None, :]
            # |q.r - q'.r'| <= |q'| |r - r'| + |q - q'| (|r'| + |r - r'|), and room for rounding
            bound = qn[sl, None] * re[None, :] + qe[sl, None] * (rn + re)[None, :] + 1e-6
            own = query_id[sl, None] == vec_id[None, :]
            low = np.where(own, -np.inf, near - bound)
            if len(begin) < len(vec_id):
                low = np.maximum.reduceat(low, begin, axis=1)
            kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
            i, j = np.nonzero((near + bound >= kth[:, None]) & ~own)
            exact = np.concatenate([(queries[a + i[c:c + 65536]] * rows[j[c:c + 65536]]).sum(axis=1) for c in range(0, len(i), 65536)] or [np.zeros(0)]) / (qnorm[a + i] * rnorm[j])
            if len(begin) < len(vec_id):
                order = np.lexsort((-exact, vec_id[j], i))
                i, j, exact = i[order], j[order], exact[order]
                new = np.r_[True, (i[1:] != i[:-1]) | (vec_id[j[1:]] != vec_id[j[:-1]])][:len(i)]
                i, j, exact = i[new], j[new], exact[new]
            order = np.lexsort((vec_id[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place < k
            out.append((query_id[a + i[keep]], vec_id[j[keep]], exact[keep]))
        return tuple(np.concatenate(c) for c in zip(*out))

    return tile


def nearest(vectors: DataFrame, k: int = 5, query_rows: int = 2048, data_rows: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose vec_id is divisible by 50 its k nearest other rows by cosine.

    The bounds never drop a true neighbour, so the result is exact. Rows with a null id and vectors that are null, empty,
    zero or hold null or non-finite components take no part; vectors of different lengths never meet. A row
    never meets rows of its own vec_id; a vec_id that is stored several times
    takes one place with its best score, as candidate and as query (the SQL twin ranks every stored row).
    An empty table gives no rows.
    """
    rows = usable(vectors, zero=False).dropDuplicates(["vec_id", "v"])
    found = block_join(rows, cosine_tile(k), query_rows, data_rows).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merge_best(found, k, largest=True)
