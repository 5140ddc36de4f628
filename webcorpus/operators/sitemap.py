"""Sitemap documents and site maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from .dedup import union_sources


def locations(xml) -> Column:
    """Every ``<loc>`` of a sitemap or sitemap index, with or without a namespace prefix."""
    c = F.col(xml) if isinstance(xml, str) else xml
    body = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(?:[a-z0-9]+:)?loc>\s*([^<]+?)\s*</(?:[a-z0-9]+:)?loc>"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))


def parse(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    keep = [c for c in sitemaps.columns if c != xml]
    return sitemaps.select(*keep, F.explode(locations(xml)).alias("url"))


def site_map(
    base_domain: str, sitemap_urls: DataFrame, page_links: DataFrame, search: str | None = None,
    include_subdomains: bool = False, limit: int = 5000, sitemap: str = "include",
) -> DataFrame:
    """Sorted URLs of a site. ``only`` limits before it searches, the other modes after."""
    def found(df):
        return df.filter(U.contains_ignore_case("url", search)) if search else df

    if sitemap == "only":
        return found(sitemap_urls.select("url").distinct().orderBy("url").limit(limit))
    urls = page_links.select("url").distinct() if sitemap == "skip" else union_sources(sitemap_urls, page_links)
    urls = found(urls)
    if not include_subdomains:
        urls = urls.filter(U.in_domain(U.netloc("url"), F.lit(base_domain)))
    return urls.orderBy("url").limit(limit)
