"""Duplicate removal and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_hash
from ..functions.urls import normalize_url
from .segments import top_k


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def keep_first(df: DataFrame, text: str, order: list[Column], row_id: str) -> DataFrame:
    """First row per content hash in the given order; rows without text are all kept.

    Rows without text get a key of their own, so they neither meet in one group nor need a
    second scan. The per-task window limit leaves one row per hash before the shuffle, so a
    page copied into a third of the corpus costs one row per task.
    """
    blank = F.coalesce(F.col(text), F.lit("")) == ""
    key = F.when(blank, F.concat(F.lit("row:"), F.col(row_id).cast("string"))).otherwise(content_hash(text))
    return top_k(df.withColumn("_key", key), ["_key"], order, 1).drop("_key")


def distinct_urls(df: DataFrame, url: str) -> DataFrame:
    """Normalised URLs, each once."""
    return df.select(normalize_url(url).alias("url")).distinct()


def not_visited(links: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Distinct normalised links that are not among the visited URLs."""
    seen = visited.select(normalize_url(url).alias("url"))
    return distinct_urls(links, url).join(seen, "url", "left_anti")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Set union of URL tables."""
    out = sources[0].select("url")
    for s in sources[1:]:
        out = out.unionByName(s.select("url"))
    return out.distinct()


def not_explored(df: DataFrame, explored: DataFrame, col: str) -> DataFrame:
    """Rows whose trimmed, lower-cased value was not explored yet."""
    seen = explored.select(F.trim(F.lower(F.col(col))).alias("_k")).distinct()
    return df.withColumn("_k", F.trim(F.lower(F.col(col)))).join(seen, "_k", "left_anti").drop("_k")


def first_occurrences(df: DataFrame, keys: list[str], value: str, pos: str, limit: int = 10) -> DataFrame:
    """First occurrence of each value per key, in order, at most ``limit``."""
    firsts = df.groupBy(*keys, value).agg(F.min(pos).alias(pos))
    return top_k(firsts, keys, [F.col(pos).asc(), F.col(value).asc()], limit)


def last_write(df: DataFrame, keys: list[str], seq: list[str], cols: list[str]) -> DataFrame:
    """Last row per key wins."""
    best = F.max_by(F.struct(*cols), F.struct(*seq)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in cols])
