"""Audit log, jobs, schedules, endpoint metrics and batch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import failures as E, text as X, urls as U


def endpoint_stats(requests: DataFrame, method="method", path="path", status="status", latency="latency_ms") -> DataFrame:
    """Calls, mean latency and success rate per normalised endpoint; 200-399 is a success."""
    ok = F.col(status).between(200, 399)
    return requests.groupBy(U.endpoint_key(method, path).alias("endpoint")).agg(
        F.count("*").alias("count"),
        F.round(F.avg(latency), 3).alias("avg_latency_ms"),
        F.round(F.avg(ok.cast("double")), 4).alias("success_rate"),
    )


def log_rows(df: DataFrame) -> DataFrame:
    """Audit rows ready to append: error and summary cut to 4096 characters plus an ellipsis."""
    return df.withColumn("error", X.ellipsis("error")).withColumn("response_summary", X.ellipsis("response_summary"))


def list_rows(log: DataFrame, limit: int = 50, offset: int = 0, time="created_at", tie="id", **equals) -> DataFrame:
    """Rows equal to every given filter, newest first, one page."""
    for col, value in equals.items():
        if value:
            log = log.filter(F.col(col) == value)
    return log.orderBy(F.col(time).desc(), F.col(tie).desc()).offset(offset).limit(limit)


def get_row(log: DataFrame, row_id, id_col="id") -> DataFrame:
    return log.filter(F.col(id_col) == row_id)


def log_stats(log: DataFrame) -> DataFrame:
    """Total, per status and per method counts in one pass (grouping sets)."""
    out = log.groupingSets([["status"], ["method"], []], "status", "method").agg(
        F.count("*").alias("n"), F.grouping_id().alias("_g"))
    # grouping id bits: status, method
    kind = F.when(F.col("_g") == 1, "status").when(F.col("_g") == 2, "method").otherwise("total")
    return out.select(kind.alias("kind"), F.coalesce("status", "method", F.lit("all")).alias("value"), "n")


def retained(log: DataFrame, as_of: Column, max_age_hours: int = 168, time="created_at") -> DataFrame:
    return log.filter(F.col(time) >= as_of - F.expr(f"interval {max_age_hours} hours"))


def retention_counts(log: DataFrame, as_of: Column, max_age_hours: int = 168, time="created_at") -> DataFrame:
    """Rows kept and deleted by the retention rule, in one pass."""
    old = F.col(time) < as_of - F.expr(f"interval {max_age_hours} hours")
    return log.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("deleted"))


def expired_count(log: DataFrame, as_of: Column, max_age_hours: int = 168, time="created_at") -> DataFrame:
    old = F.col(time) < as_of - F.expr(f"interval {max_age_hours} hours")
    return log.agg(F.count_if(old).alias("deleted"))


def live_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs left after expiry; a job without an expiry time never expires."""
    return jobs.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def due_schedules(schedules: DataFrame, as_of: Column) -> DataFrame:
    return schedules.filter(F.col("enabled") & F.col("next_run").isNotNull() & (F.col("next_run") <= as_of))


def next_run(as_of: Column, interval_seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(as_of) + F.coalesce(interval_seconds, F.lit(0)).cast("long") * 1_000_000)


def age_seconds(as_of: Column, created_at: Column) -> Column:
    return F.floor((F.unix_micros(as_of) - F.unix_micros(created_at)) / 1_000_000)


def batch_outcomes(requests: DataFrame, open_hosts: DataFrame, cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Outcome per requested URL: invalid, circuit open, cached, failed or fetched, in that order.

    ``open_hosts(host)``, ``cached(url)`` and ``fetched(url, status, error)`` are joined on
    their keys; each holds a key once.
    """
    r = requests.withColumn("host", U.domain("url"))
    j = (
        r.join(open_hosts.select("host").distinct().withColumn("_open", F.lit(True)), "host", "left")
        .join(cached.select("url").distinct().withColumn("_cached", F.lit(True)), "url", "left")
        .join(fetched.select("url", "status", "error", F.lit(True).alias("_got")), "url", "left")
    )
    fail = E.failure("status", "error", F.coalesce("_got", F.lit(False)))
    valid = U.is_valid_http_url("url")
    is_open, is_cached = F.coalesce("_open", F.lit(False)), F.coalesce("_cached", F.lit(False))
    code = (
        F.when(~valid, "invalid_url").when(is_open, "circuit_open").when(is_cached, F.lit(None).cast("string"))
        .when(fail.isNotNull(), E.status_code_name(fail["status"]))
    )
    message = (
        F.when(~valid, F.concat(F.lit("Invalid URL (bad scheme or missing host): "), "url"))
        .when(is_open, F.concat(F.lit("Circuit breaker open for "), "host"))
        .when(is_cached, F.lit(None).cast("string")).when(fail.isNotNull(), fail["message"])
    )
    return j.select(
        "url", code.isNull().alias("success"), code.alias("error_code"), message.alias("error"),
        (valid & ~is_open & is_cached).alias("cached"),
    )


def batch_summary(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    good = F.count_if("success")
    return outcomes.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"), good.alias("success_count"),
        ((good > 0) & (good < F.count("*"))).alias("partial"), (good > 0).alias("success"),
        F.count_if(F.col("error_code").isin("invalid_url", "circuit_open")).alias("warnings"),
    )


def job_status(error, success) -> Column:
    return F.when((F.coalesce(F.col(error), F.lit("")) != "") & ~F.coalesce(F.col(success), F.lit(False)), "failed").otherwise("completed")


def search_failures(attempts: DataFrame, query="query", code="error_code") -> DataFrame:
    """Failure code of queries without results: all engines resting, or unavailable."""
    all_open = F.coalesce(F.bool_and(F.when(F.col(code).isNotNull(), F.col(code) == "circuit_open")), F.lit(False))
    return attempts.groupBy(query).agg(
        F.when(all_open, "circuit_open").otherwise("search_engines_unavailable").alias("error_code"))
