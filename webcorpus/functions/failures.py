"""Failure classification expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _has(text: Column, needles) -> Column:
    return text.rlike("|".join(re.escape(n) for n in needles))


def failure(status, error, has_data=None) -> Column:
    """(status, message) of a failed fetch, NULL for a good one. A status that is not a
    number counts as 500; no record at all is a 500 of its own."""
    raw = _c(status).cast("string")
    code = F.when(raw.isNull(), F.lit(200)).otherwise(F.coalesce(raw.try_cast("int"), F.lit(500)))
    msg = F.coalesce(
        F.when(_c(error) != "", _c(error)), F.concat(F.lit("Upstream returned HTTP "), code.cast("string"))
    )
    out = F.when(code >= 400, F.struct(code.alias("status"), msg.alias("message")))
    if has_data is not None:
        missing = F.struct(F.lit(500).alias("status"), F.lit("Scraper returned no data").alias("message"))
        out = F.when(~_c(has_data), missing).otherwise(out)
    return out


def counts_against_host(status, circuit_open=None, has_data=None) -> Column:
    """Only 429 and 5xx say something about the host; 403 or 404 are about one page."""
    raw = _c(status).cast("string")
    code = F.when(raw.isNull(), F.lit(200)).otherwise(raw.try_cast("int"))
    out = F.when(code.isNull(), True).otherwise((code == 429) | (code >= 500))
    if circuit_open is not None:
        out = F.when(F.coalesce(_c(circuit_open), F.lit(False)), False).otherwise(out)
    if has_data is not None:
        out = F.when(~_c(has_data), True).otherwise(out)
    return out


def error_class(message, exception_type=None) -> Column:
    """(type, status) of an error: message words first, then the exception type."""
    m = F.lower(_c(message))
    t = F.lower(F.coalesce(_c(exception_type), F.lit(""))) if exception_type is not None else F.lit("")

    def kind(name, code):
        return F.struct(F.lit(name).alias("error_type"), F.lit(code).alias("status"))

    return (
        F.when(_has(m, fixed.CAPTCHA_WORDS), kind("captcha", 403))
        .when(_has(m, fixed.PAYWALL_WORDS), kind("paywall", 402))
        .when(t == "timeouterror", kind("timeout", 408))
        .when(t.rlike("connection|^oserror$"), kind("connection", 502))
        .when(_has(m, ["429", "too many requests"]), kind("rate_limited", 429))
        .when(_has(m, ["503", "service unavailable"]), kind("server_error", 503))
        .when(_has(m, ["502", "bad gateway"]), kind("server_error", 502))
        .when(_has(m, ["504", "gateway timeout"]), kind("server_error", 504))
        .otherwise(kind("unknown", 500))
    )


def status_code_name(status) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in fixed.STATUS_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, _c(status).cast("int")), F.lit("internal_error"))


def exception_code(exception_name) -> Column:
    n = F.lower(_c(exception_name))
    key, code = fixed.EXCEPTION_CODES[0]
    out = F.when(n.contains(key), F.lit(code))
    for key, code in fixed.EXCEPTION_CODES[1:]:
        out = out.when(n.contains(key), F.lit(code))
    return out.otherwise("navigation_failed")


def proxy_failure_likely(status, message) -> Column:
    hit = _has(F.lower(F.coalesce(_c(message), F.lit(""))), fixed.PROXY_MARKERS)
    return F.coalesce(_c(status).isin(fixed.PROXY_STATUSES), F.lit(False)) | hit


def engine_error(message, exception_type=None) -> Column:
    m = F.lower(_c(message))
    t = F.lower(F.coalesce(_c(exception_type), F.lit(""))) if exception_type is not None else F.lit("")
    return (
        F.when((t == "timeouterror") | m.contains("timeout"), "timeout")
        .when(t.rlike("connection|^oserror$") | m.contains("connection"), "connection_error")
        .when(m.contains("capacity"), "service_unavailable")
        .when(m.contains("captcha") | m.contains("challenge"), "captcha_detected")
        .when(m.contains("navigate"), "navigation_failed")
        .otherwise("upstream_error")
    )


def render_mode(url, headers) -> Column:
    """``full`` for pages that need a browser, else ``light``; headers is a string map."""
    h = _c(headers)
    low = F.transform_keys(h, lambda k, v: F.lower(k))

    def get(name):
        return F.lower(F.coalesce(F.try_element_at(low, F.lit(name)), F.lit("")))

    names = F.map_keys(low)
    prefix = "^(?:" + "|".join(fixed.JS_HEADER_PREFIXES) + ")"
    size = get("content-length").try_cast("long")
    full = (
        _has(get("server"), fixed.JS_SERVERS)
        | F.exists(names, lambda k: k.rlike(prefix))
        | F.exists(names, lambda k: k.isin(fixed.JS_HEADERS))
        | F.coalesce(size < fixed.MIN_STATIC_BYTES, F.lit(False))
        | ((get("content-type") != "") & ~get("content-type").startswith("text/html"))
        | _c(url).contains("/#")
    )
    return F.when(full, "full").otherwise("light")


def retryable(error_type) -> Column:
    return ~_c(error_type).isin(fixed.NO_RETRY_TYPES)


def backoff_seconds(error_type, attempt) -> Column:
    """Wait before the next attempt (attempts count from 0); a rate limit waits one step more."""
    steps = F.array(*[F.lit(s) for s in fixed.RETRY_BACKOFFS])
    extra = F.when(_c(error_type) == "rate_limited", 1).otherwise(0)
    step = F.least(_c(attempt) + extra, F.lit(len(fixed.RETRY_BACKOFFS) - 1))
    return F.when(retryable(error_type), F.element_at(steps, (step + 1).cast("int")))
