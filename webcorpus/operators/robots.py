"""Robots rules as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U


def _lines(body: Column) -> Column:
    return F.transform(F.split(body, r"\r\n|\n|\r"), lambda s: F.trim(F.regexp_replace(s, r"\t", " ")))


def parse_rules(robots: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """(host, kind, pattern) for the ``User-agent: *`` groups of each document.

    A document is one row, so the group a line belongs to is found inside its own array:
    the last user-agent line at or before it. Nothing is shuffled.
    """
    lines = F.filter(_lines(F.col(body)), lambda s: (s != "") & ~s.startswith("#"))
    agents = F.transform(
        F.col("_lines"),
        lambda s: F.when(F.lower(s).startswith("user-agent:"), F.trim(F.regexp_replace(s, r"^[^:]*:", ""))),
    )
    # running "inside *" flag over the lines of one document
    flags = F.aggregate(
        F.col("_agents"),
        F.array().cast("array<boolean>"),
        lambda acc, a: F.concat(
            acc,
            F.array(F.when(a.isNotNull(), a == "*").otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(False)))),
        ),
    )
    rows = (
        robots.select(F.col(host).alias("host"), lines.alias("_lines"))
        .withColumn("_agents", agents)
        .withColumn("_flags", flags)
        .select("host", F.explode(F.arrays_zip("_lines", "_flags")).alias("r"))
        .filter(F.col("r._flags"))
        .select("host", F.col("r._lines").alias("line"))
    )
    kind = F.lower(F.regexp_extract("line", r"(?i)^(disallow|allow):", 1))
    return (
        rows.select("host", kind.alias("kind"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("pattern"))
        .filter((F.col("kind") != "") & (F.col("pattern") != ""))
    )


def rule_arrays(rules: DataFrame) -> DataFrame:
    """One row per host: its disallow and allow patterns (a robots file is size-bounded)."""
    def side(kind):
        return F.collect_set(F.when(F.col("kind") == kind, F.col("pattern"))).alias(kind)

    return rules.groupBy("host").agg(side("disallow"), side("allow"))


def decide(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allowed``: the longest matching allow beats an equal or shorter disallow.

    The join is an equi join on host against one row per host; the prefix tests run on that
    row's arrays, so a hot host is never paired with its rules row by row.
    """
    p = U.path(url)
    target = F.when(p == "", F.lit("/")).otherwise(p)
    joined = urls.withColumn("host", U.netloc(url)).join(rule_arrays(rules), "host", "left")

    def longest(patterns, match):
        hits = F.filter(F.coalesce(F.col(patterns), F.array().cast("array<string>")), match)
        return F.coalesce(F.array_max(F.transform(hits, F.length)), F.lit(0))

    dis = longest("disallow", lambda x: target.startswith(x) | (x == "/"))
    alw = longest("allow", lambda x: target.startswith(x))
    allowed = ((alw > 0) & (alw >= dis)) | (dis == 0)
    return joined.withColumn("allowed", allowed).drop("disallow", "allow")


def blocked_errors(decided: DataFrame, url: str = "url") -> DataFrame:
    return decided.filter(~F.col("allowed")).select(
        F.col(url).alias("url"), F.concat(F.col(url), F.lit(": blocked by robots.txt")).alias("error")
    )


def sitemap_lines(robots: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """Sitemap locations named in robots files."""
    found = F.filter(_lines(F.col(body)), lambda s: F.lower(s).startswith("sitemap:"))
    return robots.select(
        F.col(host).alias("host"),
        F.explode(F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"^[^:]*:", "")))).alias("sitemap"),
    )
