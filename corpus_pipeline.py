"""From stored documents to packed training sequences, in four stages.

Each stage takes ``(spark, docs, sf_dir)`` and all that its predecessor kept; its result is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webcorpus.llm import mixing, packing, set_join, toxicity
from webcorpus.llm.common import table
from webcorpus.session import cut_lineage


def wide_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts make wide rows: Arrow batches of at most ``rows`` of them keep the Python workers small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(min(now, rows) if now > 0 else rows))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    wide_rows(spark)
    return toxicity.clean_only(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by a Jaccard similarity of 0.75 of five-word shingles, the smallest doc_id stays."""
    wide_rows(spark)
    return set_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that a mix of sources by weight takes, as documents; a source may be passed over twice."""
    wide_rows(spark)
    return mixing.mix_texts(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, like documents together."""
    wide_rows(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_windows)]

#: SQL cannot express the classifier, the draws of the mix, or the retrieval order; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
