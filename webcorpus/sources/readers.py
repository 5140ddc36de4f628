"""Readers: every schema is explicit, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.robots import sitemap_lines

PAGES = "page_id long, url string, html string"
OUTCOMES = "host string, call_id long, start_ts timestamp, ts timestamp, ok boolean, status int, latency_ms double, error string"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages; column pruning keeps ``html`` out of plans that only need URLs."""
    return spark.read.schema(PAGES).parquet(path)


def pages_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Pages as they arrive; the file bound per micro-batch bounds the rows of any one key."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line, trimmed; blank lines and ``#`` comments dropped."""
    line = F.trim(F.regexp_replace("value", r"\s+$", ""))
    return spark.read.text(path).select(line.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def _files_by_host(spark: SparkSession, path: str, value: str, suffix: str) -> DataFrame:
    """Whole files of hosts: in folders ``host=<host>``, or named ``<host>.<suffix>``."""
    files = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    host = F.col("host").cast("string") if "host" in files.columns else F.regexp_replace(name, rf"\.{suffix}$", "")
    return files.select(host.alias("host"), F.col("value").alias(value))


def robots_files(spark: SparkSession, path: str) -> DataFrame:
    """(host, body) of stored robots files; a robots file is small by protocol."""
    return _files_by_host(spark, path, "body", "txt")


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """(host, xml) of stored sitemap documents, which the protocol bounds at 50 MB; a host may have many."""
    return _files_by_host(spark, path, "xml", "xml")


def sitemap_locations(robots: DataFrame) -> DataFrame:
    """Default location of every host plus the ones its robots file names."""
    default = robots.select("host", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("sitemap"))
    return default.unionByName(sitemap_lines(robots)).distinct()
