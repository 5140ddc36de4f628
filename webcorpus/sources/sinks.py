"""Writers. Appends are partitioned Parquet; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.logs import log_rows


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def is_flat(schema: T.StructType) -> bool:
    return not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for f in schema.fields)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Flat records only; nested columns are an error, not a silent conversion."""
    if not is_flat(df.schema):
        nested = [f.name for f in df.schema.fields if not is_flat(T.StructType([f]))]
        raise ValueError(f"CSV needs flat records; nested columns: {', '.join(nested)}")
    df.write.mode(mode).option("header", True).csv(path)


def documents_and_summary(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """NDJSON rows: one ``document`` per page, then one ``done`` row with the counts."""
    cols = [c for c in pages.columns]
    docs = pages.select(F.lit("document").alias("event"), F.to_json(F.struct(*cols)).alias("data"))
    counts = pages.select(F.lit(1).alias("p"), F.lit(0).alias("e")).unionByName(errors.select(F.lit(0).alias("p"), F.lit(1).alias("e"))).agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("completed"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"))
    done = counts.select(F.lit("done").alias("event"), F.to_json(F.struct("completed", "errors")).alias("data"))
    return docs.unionByName(done)


def append_log(df: DataFrame, path: str) -> None:
    """Append audit rows by day, so retention drops whole partitions."""
    log_rows(df).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def append_snapshots(df: DataFrame, path: str) -> None:
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def append_items(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("type").parquet(path)
