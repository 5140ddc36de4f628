"""Token counts: batches balanced by bytes, long texts split at safe boundaries, only lengths return."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, by_bytes
from .tokens import PieceCounter, tokenizer_path

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, batch_chars: int = 1 << 20, longest: int = 8192) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row's whole text.

    No shuffle: a narrow pass over the scan. Workers encode runs of about ``batch_chars`` characters;
    texts over ``longest`` characters are cut at plain spaces. A null text is empty
    (0 bytes, 0 tokens); equal rows stay; other columns are not read.
    """
    path = tokenizer_path(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path, longest)
        for b in batches:
            tokens, sizes = [], []
            for _, run in by_bytes(b.column(1), batch_chars):
                tokens += counter.count(run)
                sizes += [len(t.encode()) for t in run]
            yield batch(SCHEMA, [b.column(0), sizes, tokens])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
