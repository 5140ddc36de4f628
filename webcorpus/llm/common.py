"""Helpers shared by the operators: shared files, running offsets, balanced batches, linked components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage, shared_dir

#: A word is a run of anything but space and the five control characters that count as white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own below the shared folder that the cluster names."""
    return os.path.join(shared_dir(spark), kind, uuid.uuid4().hex)


def write_file(path: str, data: bytes) -> None:
    """Write a whole file from a task. It appears under its name complete or not at all, so a repeated task does no harm."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, at)


def read_file(path: str) -> bytes:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return f.read()


def by_bytes(texts: pa.Array, limit: int = 1 << 20, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (null: empty) of about ``limit`` characters, each with the position of its first text.

    Only ``rows`` texts of the column become Python strings at a time.
    """
    begin, size, run = 0, 0, []
    for at in range(0, len(texts), rows):
        for i, t in enumerate(texts.slice(at, rows).to_pylist(), at):
            run.append(t or "")
            size += len(run[-1])
            if size >= limit:
                yield begin, run
                begin, size, run = i + 1, 0, []
    if run:
        yield begin, run


def drop_folder(path: str) -> None:
    """Delete a folder of the shared storage that its maker no longer needs; a missing one is fine."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    if store.get_file_info(at).type == fs.FileType.Directory:
        store.delete_dir(at)


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings that hold while the jobs inside run."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Whole texts go to Python in Arrow batches of fewer rows while the jobs inside run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def each_row(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    """Rows as tuples; only ``rows`` of them become Python values at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield from zip(*(c.slice(at, rows).to_pylist() for c in b.columns))


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def running_starts(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds ``start``: the sum of ``value`` over earlier rows of the same ``key``, in the given order.

    Rows are dealt out by ranges of (key, order), so a key with a third of all rows spreads over
    many tasks; only one sum per task and key is carried across. The table is written once,
    which fixes the ranges and cuts the lineage. Equal rows come in any order among themselves.
    """
    names = df.columns
    cols = [F.col(key).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order]]
    # copies of one sort key beyond a task's share may be dealt anywhere, since the order among them is free
    dealt = df.repartitionByRange(*cols, F.xxhash64(*names)).sortWithinPartitions(*cols)
    k, v = names.index(key), names.index(value)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        import numpy as np

        pid, last, total = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            keys, values = b.column(k).to_pylist(), b.column(v).to_numpy(zero_copy_only=False)
            starts = np.empty(len(keys), np.int64)
            for i, (x, n) in enumerate(zip(keys, values.tolist())):
                if x != last:
                    last, total = x, 0
                starts[i] = total
                total += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts), pa.array(np.full(len(keys), pid, np.int64))], names=[*names, "_inner", "_pid"])

    spelled = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    fixed = cut_lineage(dealt.mapInArrow(within, f"{spelled}, _inner bigint, _pid bigint"))
    sums = fixed.groupBy(F.col(key).alias("_k"), F.col("_pid").alias("_p")).agg(F.sum(value).alias("_sum"))
    # one row per task and key
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    joined = fixed.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_pid") == F.col("_p")))
    return joined.select(*names, (F.col("_before") + F.col("_inner")).cast("long").alias("start"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) of longs to ``node, component`` (smallest node that links reach).

    Alternates two steps: every node hands the smallest node of its neighbourhood to its larger
    neighbours, then to its smaller ones. Both are one min-aggregate and one join, which
    pre-aggregate and split hot nodes; every round is a written table. Stops when the
    edges form stars and no longer change: links that are such stars take one round.
    """
    def pass_on(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v") if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def said(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    # stored first: a round reads its links many times over, and their plan would be in it as often
    ends = F.col("a").cast("long"), F.col("b").cast("long")
    now = cut_lineage(edges.select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b")).where("a <> b").distinct())
    mark = said(now)
    for _ in range(rounds):
        before, now = mark, cut_lineage(pass_on(pass_on(now, True), False))
        mark = said(now)
        if mark == before:
            break
    else:
        raise RuntimeError("the links have not settled")
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")


def crc32_of(data) -> int:
    import zlib

    return zlib.crc32(data) & 0xFFFFFFFF
