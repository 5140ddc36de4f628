"""Queries: duplicates, set operations, link graph, robots, sitemaps and crawl reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H, text as X, urls as U
from ..operators import dedup, graph, robots as R, sitemap as S
from . import fixtures as fx, sqltext as q
from .registry import query

START = "http://site/region/1"


@query("e1_content_hash", sql=f"SELECT doc_id, {q.content_hash('text')} AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", X.content_hash("text").alias("h"))


@query("e2_keep_first", sql=f"""SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY {q.content_hash('text')} ORDER BY doc_id) AS rn
  FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END AS text FROM documents)) WHERE rn = 1 OR text = ''""")
def _(t):
    d = t("documents").select("doc_id", F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("text")).alias("text"))
    return dedup.keep_first(d, "text", [F.col("doc_id")], "doc_id").select("doc_id")


@query("e3_not_visited", sql=f"""SELECT DISTINCT {q.normalize('url')} AS url FROM pages WHERE {q.normalize('url')} NOT IN (SELECT {q.normalize('url')} FROM pages WHERE page_id % 3 = 0)""")
def _(t):
    p = t("pages").select("page_id", "url")
    return dedup.not_visited(p, p.filter("page_id % 3 = 0"))


_RESOLVED = f"SELECT page_id, url AS source, {q.scheme('url')} || '://' || {q.netloc('url')} || href AS target FROM (SELECT page_id, url, unnest({q.hrefs(q.no_code('html'))}) AS href FROM pages)"


def _page_links(t):
    return fx.page_links(t).select(U.resolve_link("url", "href").alias("url"))


def _sitemap_urls(t):
    return S.parse(fx.sitemaps(t)).select("url")


@query("e4_url_union", sql=f"SELECT url FROM pages UNION SELECT target FROM ({_RESOLVED})")
def _(t):
    return dedup.union_sources(_sitemap_urls(t), _page_links(t))


@query("e5_not_explored", sql="SELECT page_id, url FROM pages WHERE lower(trim(url)) NOT IN (SELECT lower(trim(upper(url) || ' ')) FROM pages WHERE page_id % 2 = 0)")
def _(t):
    p = t("pages").select("page_id", "url")
    return dedup.not_explored(p, p.filter("page_id % 2 = 0").select(F.concat(F.upper("url"), F.lit(" ")).alias("url")), "url")


@query("e6_first_occurrences", sql=f"""SELECT host, href, pos FROM (SELECT host, href, pos, row_number() OVER (PARTITION BY host ORDER BY pos, href) AS rn FROM (
  SELECT host, href, min(page_id * 1000 + pos) AS pos FROM (SELECT {q.domain('url')} AS host, page_id, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos
    FROM (SELECT page_id, url, {q.hrefs(q.no_code('html'))} AS hs FROM pages)) GROUP BY 1, 2)) WHERE rn <= 10""")
def _(t):
    links = fx.page_links(t).select(U.domain("url").alias("host"), "href", (F.col("page_id") * 1000 + F.col("pos")).alias("pos"))
    return dedup.first_occurrences(links, ["host"], "href", "pos", 10)


@query("e7_last_write", sql="""SELECT text AS url, max_by(source, doc_id) AS source, max(doc_id) AS doc_id FROM documents GROUP BY 1""")
def _(t):
    return dedup.last_write(t("documents").withColumnRenamed("text", "url"), ["url"], ["doc_id"], ["source", "doc_id"])


@query("e8_sentence_difference", sql=f"""WITH p AS (SELECT a.doc_id, {q.sentence_set('b.text')} AS o, {q.sentence_set('a.text')} AS n FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1)
  SELECT doc_id, len(list_filter(n, lambda x: NOT list_contains(o, x))) AS added, len(list_filter(o, lambda x: NOT list_contains(n, x))) AS removed FROM p""")
def _(t):
    d = t("documents").select("doc_id", "text")
    pairs = d.join(d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old")), "doc_id")
    o, n = X.sentence_set("old"), X.sentence_set("text")
    return pairs.select("doc_id", F.size(F.array_except(n, o)).alias("added"), F.size(F.array_except(o, n)).alias("removed"))


@query("e9_distinct_lists", sql=f"""SELECT page_id, string_agg(href, ' ' ORDER BY pos) AS hrefs FROM (SELECT page_id, href, min(pos) AS pos FROM (
  SELECT page_id, unnest(hs) AS href, generate_subscripts(hs, 1) AS pos FROM (SELECT page_id, {q.hrefs(q.no_code('html'))} AS hs FROM pages)) GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    # exact duplicates inside each page's own list
    u = t("pages").select("page_id", F.array_distinct(H.hrefs("html")).alias("l")).filter(F.size("l") > 0)
    return u.select("page_id", F.array_join("l", " ").alias("hrefs"))


# ---- link graph --------------------------------------------------------------------------

@query("f1_edges", sql=f"SELECT DISTINCT source, target FROM ({_RESOLVED})")
def _(t):
    return graph.edges(t("pages").select("url", "html"), H.hrefs("html"))


_REACH = f"""WITH RECURSIVE {q.EDGES}, walk AS (SELECT '{START}' AS url, 0 AS depth UNION SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.url WHERE w.depth < 3),
  reached AS (SELECT url, min(depth)::BIGINT AS depth FROM walk GROUP BY 1)"""


def _reached(t):
    return graph.reach(fx.edges(t), START, max_depth=3)


@query("f2_nodes", sql=_REACH + """, titled AS (SELECT 'http://site/region/' || r_regionkey AS url, r_name AS title FROM region UNION ALL SELECT 'http://site/nation/' || n_nationkey, n_name FROM nation
    UNION ALL SELECT 'http://site/customer/' || c_custkey, c_mktsegment || '-' || c_nationkey FROM customer UNION ALL SELECT 'http://site/order/' || o_orderkey, o_orderpriority || '-' || o_orderkey FROM orders)
  SELECT url, title, 200::BIGINT AS status_code, depth FROM reached JOIN titled USING (url)
  UNION ALL SELECT DISTINCT 'http://other/' || c_mktsegment, NULL, NULL, NULL FROM customer""")
def _(t):
    pages = fx.entity_pages(t).select("url", F.col("markdown").alias("title"), F.col("status").alias("status_code"))
    external = t("customer").select(F.concat(F.lit("http://other/"), "c_mktsegment").alias("url"))
    return graph.nodes(_reached(t), pages, external)


@query("f3_reach", sql=_REACH + " SELECT url, depth FROM reached")
def _(t):
    return _reached(t)


@query("f4_graph_totals", sql=_REACH + " SELECT count(*) + 5 AS total_discovered, count(*) AS total_crawled FROM reached")
def _(t):
    pages = fx.entity_pages(t).select("url", F.col("markdown").alias("title"), F.col("status").alias("status_code"))
    external = t("customer").select(F.concat(F.lit("http://other/"), "c_mktsegment").alias("url"))
    return graph.totals(graph.nodes(_reached(t), pages, external))


def _crawl(t, **kw):
    e = fx.edges(t)
    return graph.crawl(fx.entity_pages(t), e, START, max_depth=3, allow_backward=True, **kw)


_CRAWLED = _REACH + """, texts AS (SELECT 'http://site/region/' || r_regionkey AS url, r_name AS md FROM region UNION ALL SELECT 'http://site/nation/' || n_nationkey, n_name FROM nation
    UNION ALL SELECT 'http://site/customer/' || c_custkey, c_mktsegment || '-' || c_nationkey FROM customer UNION ALL SELECT 'http://site/order/' || o_orderkey, o_orderpriority || '-' || o_orderkey FROM orders),
  crawled AS (SELECT url, depth FROM (SELECT url, depth, row_number() OVER (PARTITION BY md ORDER BY depth, length(url), url) AS rn FROM reached JOIN texts USING (url)) WHERE rn = 1)"""


@query("f5_crawl", sql=_CRAWLED + " SELECT url, depth FROM crawled")
def _(t):
    return _crawl(t, max_pages=None)["pages"]


_CAP = 40
_ORDER = "length(url), url"


def _capped_level(n: int, sources: str, taken: str, waiting: str) -> str:
    """Level n of the capped crawl: queued in the order of linking pages up to twice the cap, visited in queue order up to the cap."""
    return f"""
  q{n} AS (SELECT url FROM (SELECT e.target AS url, row_number() OVER (ORDER BY length(e.source), e.source, e.pos) AS rn FROM edges e JOIN {sources} s ON e.source = s.url) WHERE rn <= {2 * _CAP} - {waiting} AND {taken} < {_CAP}),
  m{n} AS (SELECT url, row_number() OVER (PARTITION BY md ORDER BY {_ORDER}) = 1 AS fresh FROM q{n} JOIN texts USING (url)),
  b{n} AS (SELECT *, coalesce(sum(fresh::INT) OVER (ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m{n}),
  p{n} AS (SELECT url, fresh FROM b{n} WHERE before < {_CAP} - {taken})"""


_T1 = "(SELECT count(*) + 1 FROM p1)"
_CAPPED = (_CRAWLED.split(",\n  crawled AS")[0] + ", p1 AS (SELECT target AS url FROM edges WHERE source = '" + START + "'),"
           + _capped_level(2, "p1", _T1, _T1) + ","
           + _capped_level(3, "p2", f"({_T1} + (SELECT count(*) FROM p2 WHERE fresh))", f"({_T1} + (SELECT count(*) FROM q2))")
           + f" SELECT '{START}' AS url, 0::BIGINT AS depth UNION ALL SELECT url, 1 FROM p1 UNION ALL SELECT url, 2 FROM p2 WHERE fresh UNION ALL SELECT url, 3 FROM p3 WHERE fresh")


@query("f5_crawl_page_cap", sql=_CAPPED)
def _(t):
    # the page and queue caps of the crawl itself
    return _crawl(t, max_pages=_CAP)["pages"]


# robots rules and path patterns: customers 3... are left out, orders 2... but 20... are forbidden
_SCOPED = _CRAWLED.replace("FROM walk w JOIN edges e ON e.source = w.url WHERE w.depth < 3", "FROM walk w JOIN edges e ON e.source = w.url WHERE w.depth < 3 AND NOT starts_with(e.target, 'http://site/customer/3')")
_SCOPED = _SCOPED.split(",\n  crawled AS")[0] + """, judged AS (SELECT url, depth, md, starts_with(url, 'http://site/order/2') AND NOT starts_with(url, 'http://site/order/20') AS forbidden FROM reached JOIN texts USING (url)),
  crawled AS (SELECT url, depth FROM (SELECT url, depth, row_number() OVER (PARTITION BY md ORDER BY depth, length(url), url) AS rn FROM judged WHERE NOT forbidden) WHERE rn = 1)"""


def _scoped(t):
    # the robots file of the host of the start page
    file = t("region").filter("r_regionkey = 1").select(F.lit("site").alias("host"), F.lit("User-agent: *\nDisallow: /order/2\nAllow: /order/20").alias("body"))
    return _crawl(t, max_pages=None, exclude=["/customer/3*"], include=["/nation/*", "/customer/", "/order/"], rules=R.parse_rules(file))


@query("f5_crawl_scoped", sql=_SCOPED + " SELECT url, depth FROM crawled")
def _(t):
    return _scoped(t)["pages"]


@query("f8_crawl_blocked", sql=_SCOPED + " SELECT url, url || ': blocked by robots.txt' AS error FROM judged WHERE forbidden")
def _(t):
    return _scoped(t)["errors"]


@query("f6_robots_rules", sql=f"WITH {q.ROBOTS} SELECT host, 'disallow' AS kind, lo AS pattern FROM robots WHERE lo <> '' UNION ALL SELECT host, 'allow', hi FROM robots WHERE hi <> ''")
def _(t):
    return R.parse_rules(fx.robots(t))


_DECIDED = f"""WITH {q.ROBOTS}, d AS (SELECT page_id, url, CASE WHEN lo <> '' AND starts_with(p, lo) THEN length(lo) ELSE 0 END AS dl, CASE WHEN hi <> '' AND starts_with(p, hi) THEN length(hi) ELSE 0 END AS al
  FROM (SELECT page_id, url, {q.netloc('url')} AS host, CASE WHEN {q.path('url')} = '' THEN '/' ELSE {q.path('url')} END AS p FROM pages) JOIN robots USING (host))"""


def _decided(t):
    return R.decide(t("pages").select("page_id", "url"), R.parse_rules(fx.robots(t)))


@query("f7_robots_allowed", sql=_DECIDED + " SELECT page_id, url, (al > 0 AND al >= dl) OR dl = 0 AS allowed FROM d")
def _(t):
    return _decided(t).select("page_id", "url", "allowed")


@query("f8_robots_errors", sql=_DECIDED + " SELECT url, url || ': blocked by robots.txt' AS error FROM d WHERE NOT ((al > 0 AND al >= dl) OR dl = 0)")
def _(t):
    return R.blocked_errors(_decided(t))


@query("f9_sitemap_urls", sql="SELECT DISTINCT url FROM pages")
def _(t):
    return _sitemap_urls(t).distinct()


@query("f10_sitemap_lines", sql=f"WITH {q.ROBOTS} SELECT host, 'https://' || host || '/map.xml' AS sitemap FROM robots")
def _(t):
    return R.sitemap_lines(fx.robots(t))


_MAP = f"SELECT url FROM pages UNION SELECT target FROM ({_RESOLVED})"
_IN = "({0} = 'example.com' OR ends_with({0}, '.example.com'))".format(q.netloc("url"))


@query("f11_site_map", sql=f"SELECT url FROM ({_MAP}) WHERE contains(lower(url), 'the') AND {_IN} ORDER BY url LIMIT 5000")
def _(t):
    return S.site_map("example.com", _sitemap_urls(t), _page_links(t), search="The")


@query("f11_site_map_only", sql="SELECT url FROM (SELECT DISTINCT url FROM pages ORDER BY url LIMIT 100) WHERE contains(lower(url), 'th')")
def _(t):
    return S.site_map("example.com", _sitemap_urls(t), _page_links(t), search="th", limit=100, sitemap="only")


@query("f11_site_map_skip", sql=f"SELECT url FROM (SELECT DISTINCT target AS url FROM ({_RESOLVED})) WHERE {_IN} ORDER BY url LIMIT 200")
def _(t):
    return S.site_map("example.com", _sitemap_urls(t), _page_links(t), limit=200, sitemap="skip")


@query("f12_crawl_summary", sql=_CRAWLED + " SELECT (SELECT count(*) FROM crawled) AS completed, (SELECT count(*) FROM reached) AS total, 0::BIGINT AS errors")
def _(t):
    return _crawl(t, max_pages=None)["summary"]


@query("f13_depth_profile", sql=_REACH + " SELECT depth, count(*) AS n FROM reached GROUP BY 1")
def _(t):
    return graph.depth_profile(_reached(t))


@query("f13_host_profile", sql=f"SELECT {q.domain('url')} AS host, count(*) AS n, 0::BIGINT AS min_depth, 1::BIGINT AS max_depth FROM (SELECT url FROM pages UNION SELECT target FROM ({_RESOLVED})) GROUP BY 1 HAVING count(*) > 0")
def _(t):
    p = t("pages").select("url", "html")
    return graph.host_profile(graph.reach(graph.edges(p, H.hrefs("html")), p.select("url"), max_depth=1))
