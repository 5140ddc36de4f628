"""Work of Python workers on wide rows, with memory and tasks that do not depend on how the rows are stored."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 21) -> Iterator[list[pa.Array]]:
    """The columns of a few rows at a time: at most ``rows`` of them, and about ``size`` bytes or one row.

    Spark fills an Arrow batch with 10,000 rows whatever their width. Cut into pieces, only one piece at a time becomes Python
    values and results. Freed memory goes back to the system now and then.
    """
    passed = 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > size:
                n //= 2
            piece = b.slice(at, n)
            passed += piece.nbytes
            yield piece.columns
            at += n
            if passed > 1 << 25:
                passed = 0
                _give_back()


def _give_back() -> None:
    """Returns freed memory to the system: the C library keeps it unless told otherwise."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def spread(df: DataFrame, factor: int = 4) -> DataFrame:
    """Rows dealt out over all cores where a table of few files and row groups would keep them in fewer tasks than that.

    For rows whose work is longer than their way: it costs one shuffle of the rows.
    """
    spark = df.sparkSession
    return df.repartition(max(factor * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
