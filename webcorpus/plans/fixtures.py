"""Fixture tables derived from the given ones, the DataFrame side of ``sqltext``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import html as H, urls as U


def outcomes(t) -> DataFrame:
    """Fetch outcomes: user = host, error event = failure, value = latency."""
    return t("events").select(
        F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"), F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"))


def calls(t) -> DataFrame:
    return outcomes(t).select("host", F.col("id").alias("call_id"), F.col("ts").alias("start_ts"), "ts", "ok")


def node(kind: str, key: str):
    return F.concat(F.lit(f"http://site/{kind}/"), F.col(key).cast("string"))


def edges(t) -> DataFrame:
    """Entity links region -> nation -> customer -> order."""
    def link(df, a, ka, b, kb):
        return df.select(node(a, ka).alias("source"), node(b, kb).alias("target"), F.col(kb).cast("long").alias("pos"))

    return (
        link(t("nation"), "region", "n_regionkey", "nation", "n_nationkey")
        .unionByName(link(t("customer"), "nation", "c_nationkey", "customer", "c_custkey"))
        .unionByName(link(t("orders"), "customer", "o_custkey", "order", "o_orderkey")))


def entity_pages(t) -> DataFrame:
    """A stored page per entity; customers of a nation and segment share their text."""
    def page(df, kind, key, text):
        return df.select(node(kind, key).alias("url"), text.alias("markdown"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"))

    return (
        page(t("region"), "region", "r_regionkey", F.col("r_name"))
        .unionByName(page(t("nation"), "nation", "n_nationkey", F.col("n_name")))
        .unionByName(page(t("customer"), "customer", "c_custkey", F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))))
        .unionByName(page(t("orders"), "order", "o_orderkey", F.concat_ws("-", "o_orderpriority", F.col("o_orderkey").cast("string")))))


def robots(t) -> DataFrame:
    """A robots file per page host, its rules made from the paths of the host."""
    hosts = t("pages").groupBy(U.netloc("url").alias("host")).agg(
        F.min(F.regexp_extract(U.path("url"), r"^(/[^/]*/[0-9])", 1)).alias("lo"), F.max(U.path("url")).alias("hi"))
    return hosts.select("host", F.concat(
        F.lit("User-agent: other\nDisallow: /\n# rules\nUser-agent: *\nDisallow: "), "lo", F.lit("\nAllow: "), "hi",
        F.lit("\nDisallow:\nSitemap: https://"), "host", F.lit("/map.xml")).alias("body"))


def sitemaps(t) -> DataFrame:
    """Sitemap documents of at most 1000 pages per host and page range."""
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    rows = t("pages").select(U.netloc("url").alias("host"), F.floor(F.col("page_id") / 1000).alias("part"), F.struct("page_id", loc.alias("x")).alias("i"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["x"]), "")
    return rows.groupBy("host", "part").agg(F.concat(F.lit("<urlset>"), body, F.lit("</urlset>")).alias("xml"))


def page_links(t) -> DataFrame:
    return t("pages").select("page_id", "url", F.posexplode(H.hrefs("html")).alias("pos", "href"))


def snapshots(t) -> DataFrame:
    """Versions of a watched source: document id is the version."""
    return t("documents").select(F.col("source").alias("url"), F.col("doc_id").alias("version"), "text")
