"""The flagship plan: clean, deduplicate and count pages per host in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import html as H, text as X, urls as U
from ..session import cut_lineage
from . import sqltext as q
from .registry import query


def clean_pages(pages: DataFrame) -> DataFrame:
    """One narrow row per page: canonical URL, host, title, language, content hash, link count.

    Everything wide (HTML, text) is used up inside the scan stage, so later shuffles carry a
    few dozen bytes per page whatever the size of the page.
    """
    content = H.clean_content("html")
    return pages.select(
        "page_id", U.normalize_url("url").alias("url"), U.domain("url").alias("host"), H.title("html").alias("title"),
        H.language("html").alias("language"), X.content_hash(H.plain_text(content)).alias("hash"),
        F.size(H.hrefs("html")).alias("links"))


def host_report(pages: DataFrame) -> DataFrame:
    """Per host: pages, distinct URLs, pages with content no other page had first, links.

    The narrow rows are stored once; three partial reports read them, each a plain aggregate that combines before its
    shuffle, and meet as rows of hosts. Nothing is joined back to pages.
    """
    rows = cut_lineage(clean_pages(pages).drop("title"))
    none = F.lit(0).cast("long")
    counted = rows.groupBy("host").agg(F.count("*").alias("pages"), F.sum("links").alias("links"), F.size(F.collect_set("language")).cast("long").alias("languages"))
    urls = rows.select("host", "url").distinct().groupBy("host").agg(F.count("*").alias("urls"))
    # the first page of every hash, as its host
    firsts = rows.groupBy("hash").agg(F.min_by("host", "page_id").alias("host")).groupBy("host").agg(F.count("*").alias("unique_pages"))
    names = ["pages", "urls", "unique_pages", "links", "languages"]
    parts = [p.select("host", *(F.col(n) if n in p.columns else none.alias(n) for n in names)) for p in (counted, urls, firsts)]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("host").agg(*(F.sum(n).alias(n) for n in names))


_ROWS = f"""WITH r AS (SELECT page_id, {q.normalize('url')} AS url, {q.domain('url')} AS host, {q.content_hash(q.plain_text(q.clean('html')))} AS hash, len({q.hrefs(q.no_code('html'))}) AS links,
  coalesce(nullif(regexp_extract(html, '(?is)<html\\b[^>]*\\blang\\s*=\\s*["'']?([^"''\\s>]+)', 1), ''), 'en') AS lang FROM pages)"""


@query("flagship_host_report", sql=_ROWS + """, f AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY page_id) AS rn FROM r)
  SELECT host, count(*) AS pages, count(DISTINCT url) AS urls, count(*) FILTER (rn = 1) AS unique_pages, sum(links)::BIGINT AS links, count(DISTINCT lang) AS languages FROM f GROUP BY 1""")
def _(t):
    return host_report(t("pages"))
