"""Queries: sources, projections, URLs and page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, html as H, text as X, urls as U
from ..operators import dom, logs, memory, pdf, robots, serp, sitemap
from ..operators.batches import spread
from ..operators.segments import top_k
from ..session import stream_dir
from ..sources import readers, sinks
from . import fixtures as fx, sqltext as q
from .registry import query

_CUT = fixed.LOG_TEXT_CHARS


@query("a1_page_source", sql=f"SELECT page_id, url, length(html) AS chars, {q.domain('url')} AS host FROM pages")
def _(t):
    return t("pages").select("page_id", "url", F.length("html").alias("chars"), U.domain("url").alias("host"))


# ---- files written from the tables and read back ------------------------------------------

@query("a2_url_list", sql="SELECT url FROM pages")
def _(t):
    out = stream_dir(t.spark, "urls")
    # blanks around every URL, a comment and an empty line behind every other
    line = F.concat(F.lit("  "), "url", F.when(F.col("page_id") % 2 == 0, F.lit(" \t\n# seen\n\n")).otherwise(""))
    t("pages").select(line.alias("value")).write.text(out)
    return readers.url_list(t.spark, out)


@query("a3_robots_files", sql=f"WITH {q.ROBOTS} SELECT host, 'disallow' AS kind, lo AS pattern FROM robots WHERE lo <> '' UNION ALL SELECT host, 'allow', hi FROM robots WHERE hi <> ''")
def _(t):
    out = stream_dir(t.spark, "robots")
    fx.robots(t).write.partitionBy("host").text(out)
    return robots.parse_rules(readers.robots_files(t.spark, out)).select("host", "kind", "pattern")


@query("a4_sitemap_files", sql=f"SELECT DISTINCT {q.netloc('url')} AS host, url FROM pages")
def _(t):
    out = stream_dir(t.spark, "sitemaps")
    # documents of one host are files of their own, as a sitemap index lists them
    fx.sitemaps(t).select("host", "part", "xml").write.partitionBy("host", "part").text(out)
    return sitemap.parse(readers.sitemap_files(t.spark, out)).select("host", "url").distinct()


@query("a5_json_output", sql=f"SELECT page_id, url, len({q.hrefs(q.no_code('html'))}) AS links, array_to_string({q.hrefs(q.no_code('html'))}, ' ') AS hrefs FROM pages")
def _(t):
    out = stream_dir(t.spark, "json")
    sinks.write_json(t("pages").select("page_id", "url", H.hrefs("html").alias("hrefs")), out)
    back = t.spark.read.schema("page_id long, url string, hrefs array<string>").json(out)
    return back.select("page_id", "url", F.size("hrefs").alias("links"), F.array_join("hrefs", " ").alias("hrefs"))


@query("a6_csv_output", sql="SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS name, p_retailprice::DOUBLE AS price FROM part")
def _(t):
    out = stream_dir(t.spark, "csv")
    name = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    sinks.write_csv(t("part").select("p_partkey", name.alias("name"), F.col("p_retailprice").cast("double").alias("price")), out)
    return t.spark.read.schema("p_partkey long, name string, price double").option("header", True).csv(out)


@query("a8_log_rows", sql=f"""SELECT doc_id AS id, CASE WHEN length(text) > {_CUT} THEN substr(text, 1, {_CUT}) || '…' ELSE text END AS error,
  CASE WHEN length(source || text) > {_CUT} THEN substr(source || text, 1, {_CUT}) || '…' ELSE source || text END AS response_summary FROM documents""")
def _(t):
    return logs.log_rows(t("documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("error"), F.concat("source", "text").alias("response_summary")))


@query("a9_append_snapshots", sql="""SELECT url, version, length(text) AS chars FROM (
  SELECT source AS url, doc_id AS version, text, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn <= 10""")
def _(t):
    # appended versions followed by the keep-last rule of the store
    from ..operators.changes import keep_last

    d = fx.snapshots(t)
    old, new = d.filter("version % 2 = 0"), d.filter("version % 2 = 1")
    return keep_last(old.unionByName(new), "url", "version").select("url", "version", F.length("text").alias("chars"))


@query("a10_append_items", sql="""SELECT 'finding_' || substr(sha256(text), 1, 16) AS id, substr(text, 1, 2000) AS text, min(source) AS topic
  FROM documents WHERE text <> '' GROUP BY 1, 2""")
def _(t):
    d = t("documents").groupBy("text").agg(F.min("source").alias("topic")).select(
        F.lit("r").alias("report_id"), F.col("text").alias("claim"), "topic", F.lit(0.5).alias("confidence"),
        F.array().cast("array<string>").alias("source_urls"))
    return memory.store(None, memory.finding_items(d, F.lit("2024-01-01").cast("timestamp"))).select("id", "text", "topic")


@query("b1_requested_formats", sql=f"SELECT page_id, {q.plain_text(q.clean('html'))} AS text, array_to_string({q.hrefs(q.clean('html'))}, ' ') AS links FROM pages")
def _(t):
    return t("pages").select("page_id", *H.outputs("html", ["text", "links", "text"])).withColumn("links", F.array_join("links", " "))


_TRIPLE = "replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10))"


@query("b2_blank_lines", sql=rf"SELECT doc_id, {q.strip(rf"regexp_replace({_TRIPLE}, '\n{{3,}}', chr(10) || chr(10), 'g')")} AS md FROM documents")
def _(t):
    wide = F.replace("text", F.lit("\n"), F.lit("\n\n\n\n"))
    return t("documents").select("doc_id", X.collapse_blank_lines(wide).alias("md"))


@query("b3_truncate_large", sql="SELECT doc_id, length(substr(repeat(text, 40), 1, 500000)) AS chars, sha256(substr(repeat(text, 40), 1, 500000)) AS h FROM documents")
def _(t):
    md = X.cap(F.repeat("text", F.lit(40)), fixed.MAX_MARKDOWN_CHARS)
    return t("documents").select("doc_id", F.length(md).alias("chars"), F.sha2(md, 256).alias("h"))


_B64 = "'![x](data:image/png;base64,' || sha256(text) || '==) ' || text || ' data:text/plain;base64,QQ=='"


@query("b4_strip_base64", sql=f"""SELECT doc_id, regexp_replace({_B64}, 'data:image/[a-zA-Z0-9+.\\-]+;base64,[^\\s)"''<>]+', '', 'gi') AS md FROM documents""")
def _(t):
    md = F.concat(F.lit("![x](data:image/png;base64,"), F.sha2("text", 256), F.lit("==) "), "text", F.lit(" data:text/plain;base64,QQ=="))
    return t("documents").select("doc_id", X.strip_base64_images(md).alias("md"))


@query("b5_ellipsis", sql="SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS short FROM documents")
def _(t):
    return t("documents").select("doc_id", X.ellipsis("text", 100).alias("short"))


@query("b6_batch_preview", sql=f"SELECT page_id, {q.strip(q.unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title, substr({q.plain_text(q.clean('html'))}, 1, 2000) AS preview FROM pages")
def _(t):
    return t("pages").select("page_id", H.title("html").alias("title"), X.cap(H.plain_text(H.clean_content("html")), fixed.BATCH_PREVIEW_CHARS).alias("preview"))


@query("b7_snapshot_preview", sql="SELECT doc_id, substr(text, 1, 500) AS preview, octet_length(encode(text))::BIGINT AS size_bytes FROM documents")
def _(t):
    from ..operators.changes import preview

    return preview(t("documents").select("doc_id", "text"))


# ---- URLs --------------------------------------------------------------------------------

@query("c1_normalize_url", sql=f"SELECT page_id, {q.normalize('url')} AS norm FROM pages")
def _(t):
    return t("pages").select("page_id", U.normalize_url("url").alias("norm"))


@query("c2_domain", sql=f"SELECT page_id, {q.domain('url')} AS host FROM pages")
def _(t):
    return t("pages").select("page_id", U.domain("url").alias("host"))


@query("c3_valid_url", sql=r"""SELECT page_id, u, regexp_matches(trim(u), '^(?i:https?)://[^/?#]') AS valid FROM (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http', 'ftp') WHEN 2 THEN regexp_replace(url, '^https?://', '')
    WHEN 3 THEN '  ' || url WHEN 4 THEN 'http:///' || url END AS u FROM pages)""")
def _(t):
    m = F.col("page_id") % 5
    u = (F.when(m == 0, F.col("url")).when(m == 1, F.replace("url", F.lit("http"), F.lit("ftp")))
         .when(m == 2, F.regexp_replace("url", "^https?://", "")).when(m == 3, F.concat(F.lit("  "), "url"))
         .otherwise(F.concat(F.lit("http:///"), "url")))
    return t("pages").select("page_id", u.alias("u")).withColumn("valid", U.is_valid_http_url("u"))


@query("c4_resolve_links", sql=f"""SELECT page_id, href, {q.scheme('url')} || '://' || {q.netloc('url')} || href AS target
  FROM (SELECT page_id, url, unnest({q.hrefs(q.no_code('html'))}) AS href FROM pages) WHERE href LIKE '/%'""")
def _(t):
    return fx.page_links(t).select("page_id", "href", U.resolve_link("url", "href").alias("target")).filter("target IS NOT NULL")


@query("c5_content_extension", sql=rf"""SELECT page_id, NOT regexp_matches(lower({q.path('u')}), '\.({"|".join(e[1:] for e in fixed.SKIP_EXTENSIONS)})$') AS keep
  FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '.html', '.PDF') WHEN page_id % 3 = 1 THEN url ELSE url || '.css' END AS u FROM pages)""")
def _(t):
    m = F.col("page_id") % 3
    u = F.when(m == 0, F.replace("url", F.lit(".html"), F.lit(".PDF"))).when(m == 1, F.col("url")).otherwise(F.concat("url", F.lit(".css")))
    return t("pages").select("page_id", U.has_content_extension(u).alias("keep"))


@query("c6_should_follow", sql=f"""SELECT page_id, {q.netloc('url')} = 'blog.ththan.example.net' AND starts_with({q.path('url')}, '/en')
    AND (regexp_matches({q.path('url')}, '^/en/.*$') OR starts_with({q.path('url')}, '/fr')) AND NOT starts_with({q.path('url')}, '/en/9')
    AND NOT regexp_matches(lower({q.path('url')}), '\\.(pdf|zip|tar|gz|png|jpg|jpeg|gif|svg|mp3|mp4|avi|mov|woff|woff2|ttf|eot|ico|css|js)$') AS follow FROM pages""")
def _(t):
    return t("pages").select("page_id", U.should_follow(
        "url", "blog.ththan.example.net", 1, 3, "/en", include=["/en/*", "/fr"], exclude=["/en/9"]).alias("follow"))


@query("c7_path_match", sql=rf"""SELECT page_id, regexp_matches({q.path('url')}, '^/.*/.*\.html$') AS glob, starts_with({q.path('url')}, '/en/') AS prefix FROM pages""")
def _(t):
    p = U.path("url")
    return t("pages").select("page_id", U.path_match("/*/*.html", p).alias("glob"), U.path_match("/en/", p).alias("prefix"))


@query("c8_subdomains", sql=f"SELECT page_id, {q.netloc('url')} = 'example.com' OR ends_with({q.netloc('url')}, '.example.com') AS inside FROM pages")
def _(t):
    return t("pages").select("page_id", U.in_domain(U.netloc("url"), F.lit("example.com")).alias("inside"))


_C9_HIT = rf"""coalesce(nullif(regexp_extract(pq, '/page/(\d+)', 1), ''), nullif(regexp_extract(pq, '/p/(\d+)', 1), ''), nullif(regexp_extract(pq, '/\?(?:.*[&;]|)page=(\d+)', 1), ''),
  nullif(regexp_extract(pq, '/\?(?:.*[&;]|)p=(\d+)', 1), ''), nullif(regexp_extract(pq, '-page-(\d+)', 1), ''), nullif(regexp_extract(pq, '_(\d+)\.html?', 1), ''))::BIGINT"""


@query("c9_pagination", sql=rf"""WITH l AS (SELECT {q.netloc('url')} AS site, {q.scheme('url')} || '://' || {q.netloc('url')} || '/list' AS b, {q.path('url')} AS p, page_id FROM pages),
  u AS (SELECT site, CASE page_id % 3 WHEN 0 THEN b || p || '/page/' || page_id WHEN 1 THEN b || '/p/' || page_id ELSE b || p || '_' || page_id || '.html' END AS link FROM l),
  h AS (SELECT site, {q.scheme('link')} || '://' || {q.netloc('link')} || regexp_replace({q.path('link')}, '/[^/]*$', '') AS base, {q.path('link')} || '?' || {q.query('link')} AS pq FROM u),
  d AS (SELECT DISTINCT site, base, {_C9_HIT} AS page FROM h WHERE {_C9_HIT} IS NOT NULL),
  c AS (SELECT site, base, count(*) AS n FROM d GROUP BY 1, 2),
  m AS (SELECT site, base, row_number() OVER (PARTITION BY site ORDER BY n DESC, base DESC) AS rn FROM c)
  SELECT d.site, d.base, d.page FROM d JOIN m ON d.site = m.site AND d.base = m.base AND m.rn = 1""")
def _(t):
    m, pid = F.col("page_id") % 3, F.col("page_id").cast("string")
    b, p = F.concat(U.scheme("url"), F.lit("://"), U.netloc("url"), F.lit("/list")), U.path("url")
    link = F.when(m == 0, F.concat(b, p, F.lit("/page/"), pid)).when(m == 1, F.concat(b, F.lit("/p/"), pid)).otherwise(F.concat(b, p, F.lit("_"), pid, F.lit(".html")))
    return U.detect_pagination(t("pages").select(U.netloc("url").alias("site"), link.alias("link")), "link", "site")


@query("c10_crawl_priority", sql=f"""SELECT page_id, row_number() OVER (PARTITION BY host ORDER BY pen, depth, length(url), url) AS pos FROM (
  SELECT page_id, url, {q.domain('url')} AS host, CASE WHEN starts_with({q.netloc('url')}, 'blog') THEN 0 ELSE 100 END AS pen, page_id % 4 AS depth FROM pages) WHERE true QUALIFY pos <= 5""")
def _(t):
    base = F.when(U.netloc("url").startswith("blog"), U.netloc("url")).otherwise("")
    p = t("pages").select("page_id", "url", U.domain("url").alias("host"), (F.col("page_id") % 4).alias("depth"))
    return top_k(p, ["host"], U.priority_order("url", "depth", base), 5, name="pos").select("page_id", "pos")


@query("c11_decode_bing", sql="SELECT page_id, url AS target FROM pages")
def _(t):
    # wrap every page URL the way a result page does, then unwrap it
    b64 = F.regexp_replace(F.translate(F.base64(F.encode("url", "UTF-8")), "+/", "-_"), "[=\r\n]", "")
    wrapped = F.concat(F.lit("https://www.bing.com/ck/a?!&&p=1&u=a1"), b64, F.lit("&ntb=1"))
    return t("pages").select("page_id", U.decode_bing(wrapped).alias("target"))


@query("c12_decode_ddg", sql="SELECT page_id, url AS target FROM pages")
def _(t):
    wrapped = F.concat(F.lit("https://duckduckgo.com/l/?uddg="), F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")), F.lit("&rut=ab"))
    return t("pages").select("page_id", U.decode_ddg(wrapped).alias("target"))


@query("c13_result_url", sql="SELECT page_id, regexp_replace(url, '#.*$', '') AS link FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, '' FROM pages WHERE page_id % 2 = 1")
def _(t):
    href = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/ck/a?u=zz"), F.col("page_id").cast("string")))
    return t("pages").select("page_id", U.result_url(href, "https://www.bing.com/search", bing=True).alias("link"))


@query("c14_public_url", sql="""WITH h AS (SELECT event_id, user_id % 256 AS a, (event_id * 7) % 256 AS b, event_id % 256 AS c FROM events)
  SELECT event_id, NOT (a = 10 OR a = 127 OR a = 0 OR a >= 240 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
    OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS public FROM h""")
def _(t):
    ip = F.concat_ws(".", (F.col("user_id") % 256).cast("string"), ((F.col("event_id") * 7) % 256).cast("string"), (F.col("event_id") % 256).cast("string"), F.lit("1"))
    return t("events").select("event_id", U.is_public_url(F.concat(F.lit("http://"), ip, F.lit(":80/x"))).alias("public"))


@query("c15_ad_filter", sql=f"""WITH l AS (SELECT page_id, pos, CASE (page_id + pos) % 4 WHEN 0 THEN 'https://static.doubleclick.net/x' WHEN 1 THEN 'https://notcriteo.com/' ELSE 'https://' || {q.netloc('url')} || href END AS link
    FROM (SELECT page_id, url, unnest({q.hrefs(q.no_code('html'))}) AS href, generate_subscripts({q.hrefs(q.no_code('html'))}, 1) - 1 AS pos FROM pages))
  SELECT page_id, pos::BIGINT AS pos, link FROM l WHERE NOT regexp_matches({q.netloc('link')}, '(^|\\.)({"|".join(h.replace('.', chr(92) + '.') for h in fixed.AD_HOSTS if '/' not in h)})$')""")
def _(t):
    m = (F.col("page_id") + F.col("pos")) % 4
    link = (F.when(m == 0, "https://static.doubleclick.net/x").when(m == 1, "https://notcriteo.com/")
            .otherwise(F.concat(F.lit("https://"), U.netloc("url"), "href")))
    return fx.page_links(t).select("page_id", "pos", link.alias("link")).filter(~U.is_ad_host("link"))


@query("c16_pdf", sql="SELECT page_id, page_id % 7 IN (0, 1) OR ends_with(lower(u), '.pdf') AS pdf FROM (SELECT page_id, replace(url, '.html', '.Pdf') AS u FROM pages)")
def _(t):
    m = F.col("page_id") % 7
    ct = F.when(m == 0, "Application/PDF").when(m == 1, "application/octet-stream").otherwise("text/html")
    return t("pages").select("page_id", U.is_pdf(ct, F.replace("url", F.lit(".html"), F.lit(".Pdf"))).alias("pdf"))


_SEG_ID = r"(length(s) >= 8 AND (length(s) - length(replace(s, '-', '')) >= 2 OR (regexp_matches(regexp_replace(s, '[-_]', '', 'g'), '^[\p{L}\p{Nd}]+$') AND NOT regexp_matches(s, '^\p{L}+$'))))"


@query("c17_endpoint_key", sql=rf"""SELECT event_id, upper(event_type) || ' /' || array_to_string(list_transform(string_split(trim(p, '/'), '/'), lambda s: CASE WHEN {_SEG_ID} THEN '{{id}}' ELSE s END), '/') AS endpoint
  FROM (SELECT event_id, event_type, '/v1/' || CASE event_id % 4 WHEN 0 THEN 'jobs/' || (event_id + 100000000) WHEN 1 THEN 'a-b-c-d-e/x' WHEN 2 THEN 'research/' ELSE 'u' || user_id || '/abcdefgh' END AS p FROM events)""")
def _(t):
    m = F.col("event_id") % 4
    p = F.concat(F.lit("/v1/"), F.when(m == 0, F.concat(F.lit("jobs/"), (F.col("event_id") + 100000000).cast("string"))).when(m == 1, "a-b-c-d-e/x")
                 .when(m == 2, "research/").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/abcdefgh"))))
    return t("events").select("event_id", U.endpoint_key("event_type", p).alias("endpoint"))


@query("c18_urls_in_text", sql=rf"""WITH x AS (SELECT page_id, 'see ' || url || ' and <' || url || '> or https:///bad http://a.b/' || page_id || ' ' || html AS body FROM pages),
  f AS (SELECT page_id, unnest(regexp_extract_all(body, '(https?://[^\s<>"'']+)', 1)) AS u, generate_subscripts(regexp_extract_all(body, '(https?://[^\s<>"'']+)', 1), 1) AS i FROM x),
  g AS (SELECT page_id, u, min(i) AS i FROM f WHERE {q.netloc('u')} <> '' GROUP BY 1, 2)
  SELECT page_id, string_agg(u, ' ' ORDER BY i) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn FROM g) WHERE rn <= 5 GROUP BY page_id""")
def _(t):
    body = F.concat(F.lit("see "), "url", F.lit(" and <"), "url", F.lit("> or https:///bad http://a.b/"), F.col("page_id").cast("string"), F.lit(" "), "html")
    return t("pages").select("page_id", F.array_join(U.urls_in_text(body, 5), " ").alias("urls"))


@query("c19_url_search", sql="SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog')")
def _(t):
    return t("pages").filter(U.contains_ignore_case("url", "BLOG")).select("page_id", "url")


# ---- pages -------------------------------------------------------------------------------

_TITLE = q.strip(q.unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
_LANG = """coalesce(nullif(regexp_extract(html, '(?is)<html\\b[^>]*\\blang\\s*=\\s*["'']?([^"''\\s>]+)', 1), ''), 'en')"""


@query("d1_title", sql=f"SELECT page_id, {_TITLE} AS title FROM pages")
def _(t):
    return t("pages").select("page_id", H.title("html").alias("title"))


def _with_meta():
    """Pages with description and property tags put into their head."""
    return F.replace("html", F.lit("</title>"), F.concat(
        F.lit('</title><meta name="description" content="About '), "url", F.lit('"><meta property="og:type" content="page"><meta property="og:type" content="'),
        F.col("page_id").cast("string"), F.lit('">')))


@query("d2_description", sql="SELECT page_id, 'About ' || url AS description FROM pages")
def _(t):
    return t("pages").select("page_id", H.description(_with_meta()).alias("description"))


@query("d3_language", sql=f"SELECT page_id, {_LANG} AS language FROM pages")
def _(t):
    return t("pages").select("page_id", H.language("html").alias("language"))


@query("d4_meta_map", sql="SELECT page_id, 'About ' || url AS description, page_id::VARCHAR AS og_type, 2::BIGINT AS entries FROM pages")
def _(t):
    m = H.meta_map(_with_meta())
    return t("pages").select("page_id", m.alias("m")).select(
        "page_id", F.col("m")["description"].alias("description"), F.col("m")["og:type"].alias("og_type"), F.size("m").alias("entries"))


@query("d5_headings", sql=rf"""SELECT page_id, i AS pos, regexp_extract(b, '(?i)^<h([1-6])', 1)::BIGINT AS level, substr({q.inner_text('b')}, 1, 500) AS text
  FROM (SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) - 1 AS i FROM (SELECT page_id, regexp_extract_all({q.no_code('html')}, '(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)', 1) AS bs FROM pages))""")
def _(t):
    return t("pages").select("page_id", F.posexplode(H.headings("html")).alias("pos", "h")).select("page_id", "pos", "h.level", "h.text")


_ALL_LINKS = f"SELECT page_id, url, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM (SELECT page_id, url, {q.hrefs(q.no_code('html'))} AS hs FROM pages)"


@query("d6_links", sql=f"SELECT page_id, href, pos FROM ({_ALL_LINKS})")
def _(t):
    return fx.page_links(t).select("page_id", "href", "pos")


@query("d7_main_links", sql=f"SELECT page_id, len({q.hrefs(q.clean('html'))}) AS main_links, len({q.hrefs(q.no_code('html'))}) AS all_links FROM pages")
def _(t):
    return t("pages").select("page_id", F.size(H.main_links("html")).alias("main_links"), F.size(H.hrefs("html")).alias("all_links"))


@query("d8_link_records", sql=rf"""SELECT page_id, i AS pos, regexp_extract(b, '(?is)href\s*=\s*"([^"]*)"', 1) AS href, substr({q.inner_text('b')}, 1, 200) AS text, '' AS rel
  FROM (SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) - 1 AS i FROM (SELECT page_id, regexp_extract_all({q.no_code('html')}, '(?is)(<a\b[^>]*\bhref\s*=[^>]*>.*?)</a\s*>', 1) AS bs FROM pages))""")
def _(t):
    return t("pages").select("page_id", F.posexplode(H.link_records("html")).alias("pos", "l")).select("page_id", "pos", "l.href", "l.text", "l.rel")


@query("d9_unique_links", sql=f"""SELECT DISTINCT {q.domain('url')} AS host, {q.scheme('url')} || '://' || {q.netloc('url')} || href AS link FROM ({_ALL_LINKS})""")
def _(t):
    links = fx.page_links(t).select(U.domain("url").alias("host"), U.resolve_link("url", "href").alias("link"))
    return links.filter(U.domain("link") == F.col("host")).distinct()


@query("d10_main_content", sql=f"SELECT page_id, length({q.main_content('html')}) AS chars, sha256({q.main_content('html')}) AS h FROM pages")
def _(t):
    m = H.main_content("html")
    return t("pages").select("page_id", F.length(m).alias("chars"), F.sha2(m, 256).alias("h"))


_BODY = f"coalesce({q.element(q.no_code('html'), 'body')}, {q.no_code('html')})"


@query("d11_noise_tags", sql=f"SELECT page_id, sha256({q.no_noise_tags(_BODY)}) AS h FROM pages")
def _(t):
    return t("pages").select("page_id", F.sha2(H.without_noise_tags(H.body_content("html")), 256).alias("h"))


_CLASS = "replace(lower(event_type), 'view', 'ad') || CASE event_id % 4 WHEN 0 THEN '-slot' WHEN 1 THEN '_top main-nav' WHEN 2 THEN 'header' ELSE ' lead mysidenav' END"


@query("d12_noise_class", sql=rf"""SELECT event_id, cls, list_bool_or(list_transform(string_split_regex(lower(cls), '[-_\s]+'), lambda w: list_contains(['{"','".join(fixed.NOISE_CLASS_WORDS)}'], w)
  OR ends_with(w, 'sidenav') OR ends_with(w, 'subnav') OR ends_with(w, 'topnav'))) AS noise FROM (SELECT event_id, {_CLASS} AS cls FROM events)""")
def _(t):
    m = F.col("event_id") % 4
    cls = F.concat(F.replace(F.lower("event_type"), F.lit("view"), F.lit("ad")), F.when(m == 0, "-slot").when(m == 1, "_top main-nav").when(m == 2, "header").otherwise(" lead mysidenav"))
    return t("events").select("event_id", cls.alias("cls")).withColumn("noise", H.is_noise_class("cls"))


@query("d13_noise_elements", sql=f"SELECT page_id, sha256({q.no_noise_classes(q.no_noise_tags(_BODY))}) AS h FROM pages")
def _(t):
    return t("pages").select("page_id", F.sha2(H.clean_content("html", only_main=False), 256).alias("h"))


# ---- nested content: pages built around stored ones, so that every part of them is known ----

def _nested(t):
    """Elements in elements of one name, a page that is never closed in every third place, open elements between closed ones."""
    deep = F.expr("cast(page_id % 7 as int)")
    shell = [
        F.lit("<html><body class=x><NAV a=1>menu<nav>sub</nav>more</NAV><aside>open<main id='m'><div>"), F.repeat(F.lit("<div>"), deep), F.replace("url", F.lit("&"), F.lit("+")), F.repeat(F.lit("</div>"), deep),
        F.lit("</div><main>inner "), F.col("page_id").cast("string"), F.lit("</main><div class='card sidebar'>s<div>t<div>u</div></div>v</div><a href='/in'>end</a></main><main>late</main><footer>f<footer>g</footer></footer>"),
        F.when(F.col("page_id") % 3 == 0, "").otherwise("</body>"), F.lit("</html>")]
    return t("pages").select("page_id", F.concat(*shell).alias("html"))


_HEAD, _DEEP, _END = "'<main id=''m''><div>'", "repeat('<div>', page_id % 7) || replace(url, '&', '+') || repeat('</div>', page_id % 7) || '</div><main>inner ' || page_id || '</main>'", "'<a href=''/in''>end</a></main>'"
_SIDE = "'<div class=''card sidebar''>s<div>t<div>u</div></div>v</div>'"
_LATE = "'<main>late</main>' || CASE WHEN page_id % 3 = 0 THEN '</html>' ELSE '</body>' END"
_FRONT = "CASE WHEN page_id % 3 = 0 THEN '<html>' ELSE '' END || '<body class=x><aside>open'"


@query("d10_nested_content", sql=f"SELECT page_id, {_HEAD} || {_DEEP} || {_SIDE} || {_END} AS content FROM pages")
def _(t):
    return _nested(t).select("page_id", H.main_content("html").alias("content"))


@query("d11_nested_tags", sql=f"SELECT page_id, {_FRONT} || {_HEAD} || {_DEEP} || {_SIDE} || {_END} || {_LATE} AS content FROM pages")
def _(t):
    return _nested(t).select("page_id", H.without_noise_tags(H.body_content("html")).alias("content"))


@query("d13_nested_noise", sql=f"SELECT page_id, {_FRONT} || {_HEAD} || {_DEEP} || {_END} || {_LATE} AS content FROM pages")
def _(t):
    return _nested(t).select("page_id", H.clean_content("html", only_main=False).alias("content"))


@query("d17_nested_text", sql="SELECT page_id, trim(regexp_replace(replace(url, '&', '+'), '\\s+', ' ', 'g')) || ' inner ' || page_id || ' end' AS text, 1::BIGINT AS links FROM pages")
def _(t):
    return _nested(t).select("page_id", H.plain_text(H.clean_content("html")).alias("text"), F.size(H.main_links("html")).alias("links"))


@query("d14_include_selectors")
def _(t):
    return dom.extract(t("pages"), "page_id", "html", ["text", "links"], include=["h1", "p > b"]).withColumn("links", F.array_join("links", " "))


@query("d15_exclude_selectors")
def _(t):
    return dom.extract(t("pages"), "page_id", "html", ["text"], only_main=False, exclude=["h1", "ul li"])


@query("d16_content_html")
def _(t):
    return dom.extract(t("pages"), "page_id", "html", ["content_html"])


@query("d17_plain_text", sql=f"SELECT page_id, {q.plain_text(q.clean('html'))} AS text FROM pages")
def _(t):
    return t("pages").select("page_id", H.plain_text(H.clean_content("html")).alias("text"))


@query("d18_markdown")
def _(t):
    return dom.scrape(t("pages"), formats=["markdown"])


@query("d19_markdown_rules", sql=f"""SELECT page_id, {q.inner_text("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
  length({q.plain_text(q.clean('html'))}) > 0 AS has_text FROM pages""")
def _(t):
    # the first heading of every page, read back from its Markdown
    md = dom.scrape(t("pages"), formats=["markdown"])
    return md.select("page_id", X.strip_space(F.regexp_extract("markdown", r"(?m)^# (.*)$", 1)).alias("heading"), (F.length("markdown") > 0).alias("has_text"))


@query("d20_largest_block")
def _(t):
    bare = t("pages").withColumn("html", F.regexp_replace("html", r"(?i)<(/?)article", "<$1section"))
    return dom.extract(bare, "page_id", "html", ["text"], largest=True)


@query("d21_header_block", sql=f"SELECT page_id, '# ' || {_TITLE} || chr(10) || chr(10) || {q.plain_text(q.clean('html'))} AS block FROM pages WHERE {_TITLE} <> ''")
def _(t):
    p = t("pages").filter(H.title("html") != "")
    return p.select("page_id", H.header_block(H.title("html"), F.lit(""), H.plain_text(H.clean_content("html"))).alias("block"))


@query("d22_metadata", sql=f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {q.normalize('url')} ELSE url END AS url, url AS source_url, page_id % 3 = 0 AND {q.normalize('url')} <> url AS redirected,
  {_TITLE} AS title, '' AS description, {_LANG} AS language, CASE WHEN page_id % 2 = 0 THEN 404 ELSE 200 END::BIGINT AS status_code, page_id % 2 = 0 AS status_code_reported FROM pages""")
def _(t):
    landed = F.when(F.col("page_id") % 3 == 0, U.normalize_url("url"))
    status = F.when(F.col("page_id") % 2 == 0, 404)
    return t("pages").select("page_id", H.page_metadata("url", "html", status, landed).alias("m")).select("page_id", "m.*")


@query("d23_challenge_page", sql=f"""SELECT page_id, regexp_matches(lower(body), '{"|".join(fixed.CHALLENGE_PHRASES)}') AS challenge FROM (
  SELECT page_id, {_TITLE} || ' ' || {q.plain_text(q.clean('html'))} || CASE WHEN page_id % 5 = 0 THEN ' Just a Moment' ELSE '' END AS body FROM pages)""")
def _(t):
    body = F.concat(H.plain_text(H.clean_content("html")), F.when(F.col("page_id") % 5 == 0, " Just a Moment").otherwise(""))
    return t("pages").select("page_id", H.is_challenge_page(H.title("html"), body).alias("challenge"))


@query("d24_thin_content", sql="SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) <= 200 THEN 'thin' ELSE 'ok' END AS size_class FROM documents")
def _(t):
    return t("documents").select("doc_id", H.content_size_class("text").alias("size_class"))


def _result_page(block, wrap):
    """A result page per stored page: its links as result blocks."""
    return lambda t: fx.page_links(t).groupBy("page_id", "url").agg(
        F.array_sort(F.collect_list(F.struct("pos", "href"))).alias("ls")).select(
        "page_id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("ls", lambda l: block(wrap(F.col("url"), l["href"]), l["href"])), ""), F.lit("</body></html>")).alias("html"))


def _absolute(u, h):
    return F.concat(U.scheme(u), F.lit("://"), U.netloc(u), h)


_SERP_SQL = f"""WITH l AS (SELECT page_id, href, {q.scheme('url')} || '://' || {q.netloc('url')} || href AS link, min(pos) AS pos FROM ({_ALL_LINKS}) GROUP BY ALL)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank, 'T ' || href AS title, link, 'S ' || href AS snippet FROM l QUALIFY rank <= 10"""


@query("d25_serp_bing", sql=_SERP_SQL)
def _(t):
    from ..operators import serp

    def wrap(u, h):
        b64 = F.regexp_replace(F.translate(F.base64(F.encode(_absolute(u, h), "UTF-8")), "+/", "-_"), "[=\r\n]", "")
        return F.concat(F.lit("https://www.bing.com/ck/a?p=1&amp;u=a1"), b64)

    def block(link, h):
        return F.concat(F.lit('<li class="b_algo"><h2><a href="'), link, F.lit('">T <b>'), h, F.lit('</b></a></h2><div class="b_caption"><p>S '), h, F.lit("</p></div></li>"))

    return serp.results(_result_page(block, wrap)(t), "bing")


@query("d26_serp_brave", sql=_SERP_SQL)
def _(t):
    from ..operators import serp

    def block(link, h):
        return F.concat(F.lit('<div class="snippet" data-type="web"><div><a href="'), link, F.lit('#frag" class="x l1"><div class="search-snippet-title">T '), h,
                        F.lit('</div></a><div class="generic-snippet"><div class="content">S '), h, F.lit("</div></div></div></div>"))

    return serp.results(_result_page(block, _absolute)(t), "brave")


@query("d27_serp_ddg", sql=_SERP_SQL)
def _(t):
    from ..operators import serp

    def wrap(u, h):
        return F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode(_absolute(u, h)), F.lit("&amp;rut=1"))

    def block(link, h):
        return F.concat(F.lit('<div class="result results_links web-result"><a class="result__a" href="'), link, F.lit('">T '), h, F.lit('</a><a class="result__snippet">S '), h, F.lit("</a></div>"))

    return serp.results(_result_page(block, wrap)(t), "duckduckgo")


@query("d28_pdf_pages", sql="""SELECT conv_id AS doc_id, string_agg(CASE WHEN turn % 5 = 4 THEN '[Page ' || (turn + 1) || ': no extractable text]' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY 1""")
def _(t):
    p = t("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("text")).alias("text"))
    return pdf.join_pages(p)


@query("p3_registered_engine", sql="SELECT p_partkey AS page_id, 1::BIGINT AS rank, p_name AS title, 'https://parts.example/' || p_partkey AS link, p_brand AS snippet FROM part")
def _(t):
    serp.register_engine("parts", serp.Engine("https://parts.example/", "div.hit", ("a.u",), ("h4",), ("p.s",)))
    key = F.col("p_partkey").cast("string")
    block = lambda href, title: F.concat(F.lit("<div class='hit'><h4>"), title, F.lit("</h4><a class='u' href='"), href, F.lit("'>to</a><p class='s'>"), F.col("p_brand"), F.lit("</p></div>"))
    page = F.concat(F.lit("<body>"), block(F.lit("javascript:x"), F.lit("none")), block(F.concat(F.lit("/"), key), F.col("p_name")), block(F.concat(F.lit("https://parts.example/"), key), F.lit("again")))
    # a row of the table is far shorter than the work on its page
    parts = spread(t("part").select("p_partkey", "p_name", "p_brand"))
    return serp.results(parts.select(F.col("p_partkey").alias("page_id"), page.alias("html")), "parts")
