"""Link graph and crawl reach over stored pages.

Traversals are level-synchronous. Links are stored once, in buckets by source, and every level is
a table in buckets by URL: a level reads the links once and moves only its own new URLs; what was
seen is dropped bucket by bucket. Caps cut at a running count over range partitions. The tables of a run
are deleted at its end. Only counts reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from ..functions.text import content_hash
from ..session import Workspace, cut_lineage
from . import robots as R
from .segments import exclusive_prefix, top_k


def edges(pages: DataFrame, hrefs: Column, base_domain=None, include_subdomains: bool = False,
          url: str = "url") -> DataFrame:
    """(source, target) of every in-scope link; ``base_domain`` NULL means the page's own."""
    base = U.netloc(url) if base_domain is None else (
        F.lit(base_domain) if isinstance(base_domain, str) else base_domain)
    out = (
        pages.select(F.col(url).alias("source"), base.alias("_base"), F.explode(hrefs).alias("_href"))
        .select("source", "_base", U.resolve_link(F.col("source"), F.col("_href")).alias("target"))
        .filter(F.col("target").isNotNull())
    )
    if not include_subdomains:
        out = out.filter(U.in_domain(U.netloc("target"), F.col("_base")))
    return out.select("source", "target").distinct()


def reach(edge_table: DataFrame, start: DataFrame | str, max_depth: int = 3, limit: int | None = None,
          expandable: Column | None = None) -> DataFrame:
    """(url, depth) of everything at most ``max_depth`` links from the start.

    With ``limit``, pages of a level are taken in URL order and expansion stops with the
    page that brings the number of seen URLs to the limit. ``expandable`` is a test on the
    ``url`` column for pages whose links count (on-domain ones).
    """
    spark = edge_table.sparkSession
    if isinstance(start, str):
        start = spark.range(1).select(F.lit(start).alias("url"))
    with Workspace(spark) as work:
        links = work.bucketed(edge_table.select("source", "target"), "source")
        levels = [work.bucketed(start.select("url").distinct(), "url")]
        for _ in range(max_depth):
            level = levels[-1].filter(expandable) if expandable is not None else levels[-1]
            found = level.join(links, F.col("url") == F.col("source")).select("source", F.col("target").alias("url"))
            # a URL counts for the first page, in URL order, that links to it
            fresh = found.groupBy("url").agg(F.min("source").alias("source"))
            for seen in levels:
                fresh = fresh.join(seen.select("url"), "url", "left_anti")
            if limit is not None:
                fresh = _limited_level(work, fresh, limit - sum(x.count() for x in levels))
            levels.append(work.bucketed(fresh.select("url"), "url"))
            if levels[-1].isEmpty():
                break
        tagged = [x.withColumn("depth", F.lit(i)) for i, x in enumerate(levels)]
        return cut_lineage(reduce(DataFrame.unionByName, tagged))


def _limited_level(work: Workspace, fresh: DataFrame, room: int) -> DataFrame:
    """New URLs of the pages processed before the limit is met.

    A page is processed while fewer than ``room`` new URLs came before it, pages in URL order.
    """
    fresh = work.bucketed(fresh, "source")
    per_page = fresh.groupBy("source").agg(F.count("*").alias("n"))
    taken = exclusive_prefix(per_page, ["source"], "n", "before", work.store).filter(F.col("before") < room)
    return fresh.join(taken.select("source"), "source", "left_semi")


def nodes(reached: DataFrame, pages: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Vertex table: visited pages with title and status, off-domain targets by URL only."""
    visited = reached.join(pages.select("url", "title", "status_code"), "url", "left").select(
        "url", F.coalesce("title", F.lit("")).alias("title"), "status_code", "depth"
    )
    if external is None:
        return visited
    extra = external.select("url").distinct().join(visited.select("url"), "url", "left_anti")
    return visited.unionByName(extra, allowMissingColumns=True)


def totals(node_table: DataFrame) -> DataFrame:
    return node_table.agg(
        F.count("*").alias("total_discovered"), F.count("title").alias("total_crawled")
    )


def depth_profile(reached: DataFrame) -> DataFrame:
    return reached.groupBy("depth").agg(F.count("*").alias("n"))


def host_profile(reached: DataFrame) -> DataFrame:
    return reached.groupBy(U.domain("url").alias("host")).agg(
        F.count("*").alias("n"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth")
    )


def crawl(
    pages: DataFrame, links: DataFrame, start_url: str, max_depth: int = 3, max_pages: int | None = 100,
    allow_external: bool = False, allow_backward: bool = False, include: list[str] | None = None,
    exclude: list[str] | None = None, rules: DataFrame | None = None, skip_duplicates: bool = True,
) -> dict[str, DataFrame]:
    """Crawl over stored pages ``(url, markdown, status, error)`` and ``links(source, pos, target)``.

    Returns ``pages`` (url, depth), ``errors`` (url, error), ``queued`` (norm, url, depth) and
    ``summary``. Pages of one level are processed in queue order: on-domain, short, then URL.
    Duplicate content is dropped from the result but its links are still followed. The page
    cap counts results; the queue cap is twice the page cap. Both are limits of the crawl
    itself; ``max_pages=None`` crawls the whole reach without any ranking.
    """
    spark = pages.sparkSession
    base = U.netloc(F.lit(start_url))
    prefix = F.lit("/") if allow_backward else F.regexp_replace(U.path(F.lit(start_url)), r"/+$", "")
    with Workspace(spark) as work:
        # what a level needs of a page: no text, only its hash; one row per normalised URL
        text = F.coalesce("markdown", F.lit(""))
        store = work.bucketed(top_k(
            pages.select(U.normalize_url("url").alias("norm"), F.col("url").alias("stored_url"), "status", "error",
                         F.when(text != "", content_hash("markdown")).alias("_text_hash")),
            ["norm"], [F.col("stored_url")], 1), "norm")
        out_links = work.bucketed(links.select("source", F.col("pos").alias("_pos"), F.col("target").alias("url")), "source")
        seed = spark.range(1).select(F.lit(start_url).alias("url"))
        queued = [work.bucketed(seed.select(U.normalize_url("url").alias("norm"), "url"), "norm")]
        levels, n_queued, done = [], 1, 0
        for depth in range(max_depth + 1):
            level = _visit(queued[-1].join(store, "norm", "left"), rules, depth, base)
            level = _first_of_content(level, levels) if skip_duplicates else level.withColumn("_new", F.col("_failure").isNull())
            if max_pages is not None:
                level = exclusive_prefix(level.withColumn("_one", F.col("_new").cast("int")), ["_order"], "_one", "_before", work.store)
                level = level.filter(F.col("_before") < max_pages - done).drop("_one", "_before")
            levels.append(work.bucketed(level, "stored_url"))
            if max_pages is not None:
                done += levels[-1].filter("_new").count()
            if depth == max_depth:
                break
            found = (
                levels[-1].filter(F.col("_failure").isNull()).select("_order", F.col("stored_url").alias("source"))
                .join(out_links, "source").withColumn("norm", U.normalize_url("url"))
                .filter(U.should_follow("norm", base, F.lit(depth + 1), max_depth, prefix, allow_external,
                                        allow_backward, include, exclude)))
            # a URL is queued where the first page in queue order links to it first
            fresh = found.groupBy("norm").agg(F.min(F.struct("_order", "_pos", "url")).alias("_f"))
            for seen in queued:
                fresh = fresh.join(seen.select("norm"), "norm", "left_anti")
            if max_pages is not None:
                counted = fresh.withColumn("_place", F.struct("_f._order", "_f._pos", "norm")).withColumn("_one", F.lit(1))
                fresh = exclusive_prefix(counted, ["_place"], "_one", "_before", work.store).filter(F.col("_before") < 2 * max_pages - n_queued)
            # links of the last page still count as discovered
            queued.append(work.bucketed(fresh.select("norm", "_f.url"), "norm"))
            fresh_rows = queued[-1].count()
            n_queued += fresh_rows
            if not fresh_rows or max_pages is not None and done >= max_pages:
                break
        visited = cut_lineage(reduce(DataFrame.unionByName, [x.select("url", "_new", "_failure", F.lit(i).alias("depth")) for i, x in enumerate(levels)]))
        waiting = cut_lineage(reduce(DataFrame.unionByName, [x.withColumn("depth", F.lit(i)) for i, x in enumerate(queued)]))
    results = visited.filter("_new").select("url", "depth")
    errors = visited.filter(F.col("_failure").isNotNull()).select("url", F.concat_ws(": ", "url", "_failure").alias("error"))
    return {"pages": results, "errors": errors, "queued": waiting, "summary": crawl_summary(results, waiting, errors)}


def _visit(level: DataFrame, rules: DataFrame | None, depth: int, base: Column) -> DataFrame:
    """What becomes of each queued URL: ``_failure``, ``_hash`` of a page that is there, and its ``_order``."""
    level = R.decide(level, rules).drop("host") if rules is not None else level.withColumn("allowed", F.lit(True))
    failure = (
        F.when(~F.col("allowed"), F.lit("blocked by robots.txt"))
        .when(F.col("stored_url").isNull(), F.lit("Scraper returned no data"))
        .when(F.coalesce(F.col("status"), F.lit(200)) >= 400,
              F.coalesce("error", F.concat(F.lit("Upstream returned HTTP "), F.col("status").cast("string")))))
    order = U.priority_order("url", F.lit(depth), base)
    return level.select(
        "norm", "url", "stored_url", failure.alias("_failure"), F.when(failure.isNull(), F.col("_text_hash")).alias("_hash"),
        F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("_order"))


def _first_of_content(level: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``_new``: the first page of a hash in this level, and of none of an earlier one. Equal copies are told apart by their order, not by a window."""
    firsts = level.filter(F.col("_hash").isNotNull()).groupBy("_hash").agg(F.min("_order").alias("_first"))
    for seen in levels:
        firsts = firsts.join(seen.filter("_new and _hash is not null").select("_hash"), "_hash", "left_anti")
    new = F.col("_failure").isNull() & (F.col("_hash").isNull() | F.col("_first").isNotNull())
    # met on (hash, order), so a hash that many pages share spreads over tasks
    met = level.join(firsts.withColumnRenamed("_hash", "_h"), (F.col("_hash") == F.col("_h")) & (F.col("_order") == F.col("_first")), "left")
    return met.withColumn("_new", new).drop("_h", "_first")


def crawl_summary(results: DataFrame, queued: DataFrame, errors: DataFrame) -> DataFrame:
    """completed, total discovered and number of errors in one row."""
    tagged = (
        results.select(F.lit("p").alias("k")).unionByName(queued.select(F.lit("q").alias("k")))
        .unionByName(errors.select(F.lit("e").alias("k")))
    )
    return tagged.agg(
        F.count_if(F.col("k") == "p").alias("completed"),
        F.count_if(F.col("k") == "q").alias("total"),
        F.count_if(F.col("k") == "e").alias("errors"),
    )
