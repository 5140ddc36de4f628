"""Selectors that worked before, per URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from .segments import ranked, top_k

#: URL caps up to this are a top-k, larger ones a place in a distributed order.
_TOP_K = 10_000


def uses(events: DataFrame, url="url", selector="selector", ts="ts") -> DataFrame:
    """Count and last use per URL and non-blank selector."""
    s = F.trim(F.col(selector))
    return events.filter(s != "").groupBy(F.col(url).alias("url"), s.alias("selector")).agg(
        F.count("*").alias("count"), F.max(ts).alias("last_used"))


def score(as_of: Column, count="count", last_used="last_used") -> Column:
    """Count weighted by recency: full within an hour, half within a day, a tenth later."""
    age = (F.unix_micros(as_of) - F.unix_micros(last_used)) / 1_000_000.0
    weight = F
    for bound, w in fixed.RECENCY_STEPS:
        weight = weight.when(age < bound, F.lit(w))
    return F.col(count) * weight.otherwise(F.lit(fixed.RECENCY_OLD))


def suggestions(memory: DataFrame, as_of: Column, limit: int = 5) -> DataFrame:
    scored = memory.withColumn("score", score(as_of))
    return top_k(scored, ["url"], [F.col("score").desc(), F.col("selector")], limit, name="rank").select(
        "url", "selector", "score", "rank")


def capped(memory: DataFrame, per_url: int = fixed.SELECTORS_PER_URL, urls: int = fixed.SELECTOR_URLS) -> DataFrame:
    """Strongest selectors per URL and most recently used URLs.

    The URL cap is a distributed top-k over one row per URL, joined back. A top-k reserves room for its whole cap in every task,
    so large caps count places over ranges of the order instead.
    """
    best = top_k(memory, ["url"], [F.col("count").desc(), F.col("last_used").desc(), F.col("selector")], per_url)
    used = best.groupBy("url").agg(F.max("last_used").alias("_u"))
    order = [F.col("_u").desc(), F.col("url")]
    recent = used.orderBy(*order).limit(urls) if urls <= _TOP_K else ranked(used, order).filter(F.col("_place") < urls)
    return best.join(recent.select("url"), "url", "left_semi")


def counters(memory: DataFrame) -> DataFrame:
    """selector -> count map per URL (at most the per-URL cap of entries)."""
    return memory.groupBy("url").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("selector", "count")))).alias("selectors"))


def forget(memory: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Drop (url, selector) pairs; a NULL selector drops the whole URL."""
    whole = forgotten.filter("selector IS NULL").select("url").distinct()
    pairs = forgotten.filter("selector IS NOT NULL").select("url", "selector").distinct()
    return memory.join(whole, "url", "left_anti").join(pairs, ["url", "selector"], "left_anti")


def hints(memory: DataFrame, as_of: Column) -> DataFrame:
    return suggestions(memory, as_of, 3).select("url", "selector", F.round("score", 2).alias("score"))
