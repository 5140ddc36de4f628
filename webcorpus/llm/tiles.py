"""Queries against all rows in blocks: both sides are dealt into blocks, every pair of blocks meets in one task call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """``vec_id, v``: rows with an id whose vector is not null or empty, holds finite numbers only and, unless ``zero``, is not all zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        fine = fine & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def is_query() -> object:
    return F.col("vec_id") % 50 == 0


def block_join(vectors: DataFrame, tile: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], query_rows: int = 2048, data_rows: int = 8192) -> DataFrame:
    """``query_id, vec_id, score``: what ``tile(query ids, queries, ids, rows)`` returns for every pair of blocks.

    Blocks are dealt by a hash of the id, so their sizes are even whatever the values. A pair of blocks holds about
    ``query_rows`` and ``data_rows`` vectors of one length, which bounds a task's memory. Queries are sent once per data
    block, rows once per query block.
    """
    rows = cut_lineage(vectors.withColumn("dim", F.size("v").cast("long")))
    n_data, n_query = rows.count(), rows.where(is_query()).count()
    d, q = max(1, -(-n_data // data_rows)), max(1, -(-n_query // query_rows))
    h = F.xxhash64("vec_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("dim", F.pmod(h, F.lit(d)).cast("int").alias("d"), each(q).alias("q"), "vec_id", "v")
    asked = rows.where(is_query()).select("dim", each(d).alias("d"), F.pmod(h, F.lit(q)).cast("int").alias("q"), "vec_id", "v")

    def unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = t.column("v").combine_chunks()
        flat = flat.values if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.values for c in flat.chunks])
        ids = t.column("vec_id").to_numpy()
        return ids, np.asarray(flat).reshape(len(ids), -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return BEST.empty_table()
        query_id, vec_id, score = tile(*unpack(left), *unpack(right))
        return pa.table([pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64())], schema=BEST)

    return asked.groupBy("dim", "d", "q").cogroup(data.groupBy("dim", "d", "q")).applyInArrow(meet, "query_id long, vec_id long, score double")


def merge_best(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """``query_id, rank, vec_id, score``: heaps of the k best of every query, merged over all blocks; ties to smaller vec_id."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        heaps: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for q, i, s in zip(*(b.column(c).to_pylist() for c in range(3))):
                # the worst of a heap is its top
                heap, item = heaps.setdefault(q, []), (s if largest else -s, -i)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        rows = [(q, r, -i, s if largest else -s) for q, heap in heaps.items() for r, (s, i) in enumerate(sorted(heap, reverse=True), 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

    return found.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
