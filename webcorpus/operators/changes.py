"""Change detection over page snapshots ``(url, ts or version, text)``."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text as X, urls as U
from ..session import cut_lineage
from .batches import spread
from .segments import HOUR, previous, running, top_k


def track(snapshots: DataFrame, url="url", order="ts", text="text", width: int = HOUR, keep_text: bool = False,
          ties: list[str] | None = None, keep_sentences: bool = False) -> DataFrame:
    """Previous hash, current hash and ``changed`` of every snapshot.

    ``keep_sentences`` brings the sentences of a snapshot and the one before along in place of the text: each text is hashed and
    split once, on all cores however the table is stored, and kept as a table.
    """
    if keep_sentences:
        snapshots = spread(snapshots)
    hashed = snapshots.withColumn("current_hash", F.substring(X.change_hash(text), 1, 16))
    cols = {"previous_hash": F.col("current_hash")}
    if keep_text:
        cols["previous_text"] = F.col(text)
    if keep_sentences:
        found = hashed.withColumn("sentences", X.sentence_set(text))
        hashed = cut_lineage(found if keep_text else found.drop(text))
        cols["previous_sentences"] = F.col("sentences")
    out = previous(hashed, [url], order, cols, width, ties)
    return out.withColumn(
        "changed", F.col("previous_hash").isNotNull() & (F.col("previous_hash") != F.col("current_hash"))
    )


def sentence_diffs(tracked: DataFrame, text="text") -> DataFrame:
    """Added and removed sentences of changed snapshots; unchanged ones get no list."""
    if "sentences" in tracked.columns:
        found = X.set_changes(F.col("previous_sentences"), F.col("sentences"))
    else:
        found = X.sentence_changes(F.col("previous_text"), F.col(text))
    return tracked.withColumn("changes", F.when(F.col("changed"), found))


def _unified(old: str, new: str, context: int) -> str:
    if old is None or old == new:
        return ""
    return "".join(difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), n=context))


def unified_diffs(tracked: DataFrame, text="text", context: int = 3) -> DataFrame:
    """Unified line diff. Only rows whose text changed reach the Python worker."""

    @F.pandas_udf("string")
    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([_unified(o, n, context) for o, n in zip(old, new)])

    prev = F.col("previous_text")
    same = tracked.filter(prev.isNull() | (prev == F.col(text))).withColumn("diff", F.lit(""))
    moved = tracked.filter(prev.isNotNull() & (prev != F.col(text))).withColumn("diff", diff(prev, F.col(text)))
    return same.unionByName(moved)


def keep_last(snapshots: DataFrame, url="url", order="ts", n: int = fixed.SNAPSHOTS_PER_URL) -> DataFrame:
    return top_k(snapshots, [url], [F.col(order).desc()], n)


def watch_status(tracked: DataFrame, url="url", order="ts", keep: int = fixed.SNAPSHOTS_PER_URL) -> DataFrame:
    """Snapshots held, changes counted, last check and change, latest hash per URL."""
    return tracked.groupBy(url).agg(
        F.least(F.count("*"), F.lit(keep)).alias("snapshot_count"),
        F.count_if("changed").alias("change_count"),
        F.max(order).alias("last_check"),
        F.max(F.when(F.col("changed"), F.col(order))).alias("last_change"),
        F.max_by("current_hash", order).alias("latest_hash"),
    )


def change_events(diffed: DataFrame, url="url", order="ts", width: int = HOUR) -> DataFrame:
    """One row per detected change with its running number and first changes."""
    counted = running(diffed, [url], order, width, sums={"change_count": F.col("changed").cast("long")})
    return counted.filter("changed").select(
        url, U.domain(url).alias("domain"), "change_count",
        F.size("changes").alias("change_count_this_watch"),
        F.slice("changes", 1, fixed.CHANGES_PER_EVENT).alias("changes"),
        F.col("current_hash").alias("content_hash"), F.col(order).alias("detected_at"),
    )


def history(tracked: DataFrame, url="url", order="ts", n: int = fixed.SNAPSHOTS_PER_URL) -> DataFrame:
    """Ordered list of the snapshots kept per URL (at most ``n``)."""
    item = F.struct(F.col(order).alias("created_at"), F.col("current_hash").alias("content_hash"), "changed")
    return keep_last(tracked, url, order, n).groupBy(url).agg(F.array_sort(F.collect_list(item)).alias("history"))


def register_watches(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert ``(url, webhook_url, selectors, enabled)``: new values win, blanks keep the old."""
    c, u = current.alias("c"), updates.alias("u")
    new_hook = F.when(F.col("u.webhook_url") != "", F.col("u.webhook_url"))
    new_sel = F.when(F.size("u.selectors") > 0, F.col("u.selectors"))
    touched = F.col("u.url").isNotNull()
    url = F.coalesce("c.url", "u.url")
    return c.join(u, F.col("c.url") == F.col("u.url"), "full").select(
        url.alias("url"), U.domain(url).alias("domain"),
        F.coalesce(new_hook, F.col("c.webhook_url")).alias("webhook_url"),
        F.coalesce(new_sel, F.col("c.selectors"), F.array().cast("array<string>")).alias("selectors"),
        F.when(touched, True).otherwise(F.coalesce("c.enabled", F.lit(True))).alias("enabled"),
    )


def unwatch(current: DataFrame, removed: DataFrame) -> DataFrame:
    return current.join(removed.select("url"), "url", "left_anti")


def tracker_stats(snapshots: DataFrame, url="url") -> DataFrame:
    return snapshots.agg(F.countDistinct(url).alias("tracked_urls"))


def preview(snapshots: DataFrame, text="text") -> DataFrame:
    return snapshots.withColumn("preview", F.substring(text, 1, fixed.SNAPSHOT_PREVIEW_CHARS)).withColumn(
        "size_bytes", F.octet_length(text)).drop(text)
