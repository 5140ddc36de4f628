"""Token ids as wavelet-matrix shards in the shared folder, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import batch, by_bytes, crc32_of, new_folder, read_file, small_batches, write_file
from .tokens import WordEncoder, tokenizer_path
from .wavelet import dump, load

MANIFEST = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("inner_start", pa.int64())])
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_shards(docs: DataFrame, folder: str, model: str = "word_bpe_49k.json", end_id: int = 2, shard_tokens: int = 1 << 19) -> DataFrame:
    """Writes every row's ids (its end id last), in ascending doc_id order (nulls last; equal ids
    by text), and returns the manifest, one row per shard file, with ``start``.

    Texts are dealt out by ranges of doc_id and encoded where they arrive. A task closes a shard
    after ``shard_tokens`` tokens, so it holds one shard, whatever its share; a longer text is a
    shard of its own. Files appear whole under fixed names: a repeated task rewrites the same bytes.
    """
    path = tokenizer_path(model)
    cols = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*cols).sortWithinPartitions(*cols)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = WordEncoder.shared(path), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype)
        ids, held, size, done, rows = [], [], 0, 0, []

        def close() -> None:
            nonlocal ids, held, size, done
            lengths = np.array([len(x) for x in ids], np.int64)
            at = f"{folder}/part-{part:06d}-{len(rows):06d}.wvm"
            write_file(at, dump(np.concatenate(ids), held, np.cumsum(lengths) - lengths))
            rows.append((part, len(rows), at, len(held), size, done))
            ids, held, size, done = [], [], 0, done + size

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for at, run in by_bytes(b.column(1), 1 << 19):
                for k, x in enumerate(encoder.encode(run)):
                    ids.append(np.r_[x, end])
                    held.append(doc_ids[at + k])
                    size += len(ids[-1])
                    if size >= shard_tokens:
                        close()
        if held:
            close()
        if rows:
            yield batch(MANIFEST, list(zip(*rows)))

    with small_batches(docs.sparkSession):
        manifest = cut_lineage(dealt.mapInArrow(write, "part long, shard long, path string, n_docs long, n_tokens long, inner_start long"))
    # one row per writing task
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return manifest.join(before, "part").select("path", "n_docs", "n_tokens", (F.col("before") + F.col("inner_start")).cast("long").alias("start"))


def read_shards(manifest: DataFrame, files_per_task: int = 4, most_tasks: int = 20_000) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files of a manifest, each read once by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m, docs, starts = load(read_file(at))
                ids, ends = m.tokens().astype("<u4"), np.append(starts[1:], m.n)
                yield batch(ROWS, [docs, starts + first, ends - starts, [crc32_of(ids[s:e]) for s, e in zip(starts, ends)]])

    tasks = min(most_tasks, max(1, manifest.count() // files_per_task))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def binary_output(docs: DataFrame, model: str = "word_bpe_49k.json", end_id: int = 2, shard_tokens: int = 1 << 19) -> DataFrame:
    """Write all documents as shards, read the files back.

    A null text is empty and has its end id alone; an empty table writes nothing and gives no rows;
    equal rows stay, each with its own place; other columns are not read.
    """
    return read_shards(write_shards(docs, new_folder(docs.sparkSession, "wavelet"), model, end_id, shard_tokens))
