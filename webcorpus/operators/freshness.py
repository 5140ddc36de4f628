"""Reuse of stored results within their time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from .segments import last_seen


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _json_string(c: Column) -> Column:
    """JSON text of a string: quotes, backslashes and line breaks escaped."""
    e = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    e = F.replace(F.replace(e, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit('"'), e, F.lit('"'))


def cache_key(url, formats, extra: dict[str, Column] | None = None) -> Column:
    """Hash of the canonical request: lower-cased URL, sorted formats, non-null options.

    The text is compact JSON with sorted keys: extra, formats, url. Option values are JSON
    text (``true``, ``5``, a quoted string).
    """
    fmts = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(_c(formats)), _json_string), ","), F.lit("]"))
    parts = []
    if extra:
        pairs = [
            F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(extra.items())
        ]
        body = F.concat_ws(",", *pairs)
        parts.append(F.when(body != "", F.concat(F.lit('"extra":{'), body, F.lit("}"))))
    parts.append(F.concat(F.lit('"formats":'), fmts))
    parts.append(F.concat(F.lit('"url":'), _json_string(F.trim(F.lower(_c(url))))))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def lookup(requests: DataFrame, stored: DataFrame, key: str = "key", request_id: str = "req_id") -> DataFrame:
    """As-of lookup: the latest entry at or before each request, a hit while its TTL lasts.

    ``requests(key, req_id, req_ts)``, ``stored(key, stored_at, ttl)``. Entries and requests are dealt out together by ranges
    of (key, time), so neither a long TTL nor a key asked for a third of the time makes a large task. Of entries stored at one
    instant that with the longer TTL counts; a request without key or time, or an entry without TTL, gives no hit.
    """
    r = requests.select(
        key, request_id, F.unix_micros("req_ts").alias("_t"), F.lit(None).cast("double").alias("_ttl"), F.lit(1).alias("_side"))
    s = stored.select(
        key, F.lit(None).cast(requests.schema[request_id].dataType).alias(request_id),
        F.unix_micros("stored_at").alias("_t"), F.col("ttl").cast("double").alias("_ttl"), F.lit(0).alias("_side"))
    s = s.filter(F.col(key).isNotNull() & F.col("_t").isNotNull())
    entry = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("_s"), "_ttl"))
    out = last_seen(s.unionByName(r), [key], ["_t", "_side", "_ttl"], entry, "_e").filter("_side = 1")
    # expiry is strict: an entry is still good at the very end of its TTL
    hit = F.coalesce(F.col("_t") <= F.col("_e._s") + F.col("_e._ttl") * 1_000_000, F.lit(False))
    return out.select(
        key, request_id, F.timestamp_micros("_t").alias("req_ts"), hit.alias("hit"),
        F.when(hit, F.timestamp_micros("_e._s")).alias("stored_at"))


def keep_newest(entries: DataFrame, n: int = fixed.CACHE_SIZE, time="stored_at", tie="key") -> DataFrame:
    """Newest ``n`` insertions: a distributed top-k, not a global window."""
    return entries.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


def invalidate(entries: DataFrame, urls: DataFrame | None = None, url="url") -> DataFrame:
    """Entries left after dropping the given URLs, or none at all."""
    if urls is None:
        return entries.filter(F.lit(False))
    return entries.join(urls.select(url).distinct(), url, "left_anti")


def stats(entries: DataFrame, as_of: Column) -> DataFrame:
    late = F.unix_micros(as_of) > F.unix_micros("stored_at") + F.col("ttl") * 1_000_000
    return entries.agg(F.count("*").alias("entries"), F.count_if(late).alias("expired"))


def is_cacheable(actions, headers, cookies, summary, change_tracking, extract) -> Column:
    """Requests with side effects, private headers or derived output always run again."""
    def filled(c):
        return F.coalesce(F.size(_c(c)) > 0, F.lit(False))

    def flag(c):
        return F.coalesce(_c(c), F.lit(False))

    return ~(filled(actions) | filled(headers) | filled(cookies) | flag(summary) | flag(change_tracking)
             | _c(extract).isNotNull())
