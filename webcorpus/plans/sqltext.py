"""Pieces of the SQL twins: DuckDB expressions for URLs, page text and fixture tables."""

from ..functions import fixed

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def scheme(u):
    return f"lower(regexp_extract({u}, '{_URL}', 1))"


def netloc(u):
    return f"regexp_extract({u}, '{_URL}', 2)"


def path(u):
    return f"regexp_extract({u}, '{_URL}', 3)"


def query(u):
    return f"regexp_extract({u}, '{_URL}', 4)"


def domain(u):
    return f"coalesce(nullif(lower({netloc(u)}), ''), 'unknown')"


def normalize(u):
    p = f"rtrim({path(u)}, '/')"
    return (
        f"({scheme(u)} || '://' || {netloc(u)} || CASE WHEN {p} = '' THEN '/' ELSE {p} END"
        f" || CASE WHEN {query(u)} = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split({query(u)}, '&')), '&') END)"
    )


def unescape(x):
    for a, b in fixed.ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, a, b.replace("'", "''"))
    return x


def squash(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def no_code(h):
    h = f"regexp_replace({h}, '(?s)<!--.*?-->', '', 'g')"
    for t in ("script", "style"):
        h = rf"regexp_replace({h}, '(?is)<{t}\b[^>]*>.*?</{t}\s*>', '', 'g')"
    return h


def element(h, tag):
    return rf"nullif(regexp_extract({h}, '(?is)(<{tag}\b[^>]*>.*?</{tag}\s*>)', 1), '')"


def main_content(h):
    h = no_code(h)
    return f"coalesce({element(h, 'main')}, {element(h, 'article')}, {element(h, 'body')}, {h})"


def no_noise_tags(h):
    for t in fixed.NOISE_TAGS:
        h = rf"regexp_replace({h}, '(?is)<{t}\b[^>]*>.*?</{t}\s*>', '', 'g')"
    return h


def no_noise_classes(h):
    words = "|".join(fixed.NOISE_CLASS_WORDS)
    for t in ("div", "section", "ul", "span", "p"):
        h = (rf"regexp_replace({h}, '(?is)<{t}\b[^>]*\bclass\s*=\s*\"(?:[^\"]*[-_\s])?(?:{words})(?:[-_\s][^\"]*)?\"[^>]*>.*?</{t}\s*>', '', 'g')")
    return h.replace('\\"', '"')


def clean(h):
    return no_noise_classes(no_noise_tags(main_content(h)))


def plain_text(x):
    return squash(unescape(rf"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')"))


def inner_text(x):
    return strip(unescape(rf"regexp_replace({x}, '(?s)<[^>]+>', '', 'g')"))


HREF = r"(?is)<a\b[^>]*\bhref\s*=\s*\"([^\"]*)\"".replace('\\"', '"')


def hrefs(h):
    return f"regexp_extract_all({h}, '{HREF}', 1)"


def content_hash(x):
    return f"substr(sha256(lower({squash(x)})), 1, 16)"


def diff_norm(x):
    x = f"lower({x})"
    for pat, mark in ((fixed.DIFF_URL, "[URL]"), (fixed.DIFF_DATE, "[DATE]"), (fixed.DIFF_TIME, "[TIME]")):
        x = f"regexp_replace({x}, '{pat}', '{mark}', 'g')"
    return squash(x)


def change_hash(x):
    return f"substr(sha256({diff_norm(x)}), 1, 16)"


def sentences(x):
    parts = rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))"
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: length(s) > {fixed.SENTENCE_MIN_CHARS})"


def norm_sentence(s):
    t = rf"regexp_replace({strip(f'lower({s})')}, '\s+', ' ', 'g')"
    return rf"substr(regexp_replace({t}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), 1, {fixed.DIFF_SENTENCE_CHARS})"


def sentence_set(x):
    return f"list_distinct(list_transform({sentences(x)}, lambda s: {norm_sentence('s')}))"


# ---- fixture tables derived from the given ones -----------------------------------------

OUTCOMES = """outcomes AS (SELECT 'h' || user_id AS host, event_id AS id, ts, event_type <> 'error' AS ok,
  value AS latency_ms FROM events)"""

EDGES = """edges AS (
  SELECT 'http://site/region/' || n_regionkey AS source, 'http://site/nation/' || n_nationkey AS target, n_nationkey::BIGINT AS pos FROM nation
  UNION ALL SELECT 'http://site/nation/' || c_nationkey, 'http://site/customer/' || c_custkey, c_custkey FROM customer
  UNION ALL SELECT 'http://site/customer/' || o_custkey, 'http://site/order/' || o_orderkey, o_orderkey FROM orders)"""

# every page host with rules made from its own paths
ROBOTS = f"""robots AS (
  SELECT host, 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) || '# rules' || chr(10) || 'User-agent: *' || chr(10)
    || 'Disallow: ' || lo || chr(10) || 'Allow: ' || hi || chr(10) || 'Disallow:' || chr(10) || 'Sitemap: https://' || host || '/map.xml' AS body, lo, hi
  FROM (SELECT {netloc('url')} AS host, min(regexp_extract({path('url')}, '^(/[^/]*/[0-9])', 1)) AS lo, max({path('url')}) AS hi
        FROM pages GROUP BY 1))"""

SITEMAPS = f"""sitemaps AS (
  SELECT host, part, '<urlset>' || string_agg('<url><loc> ' || replace(url, '&', '&amp;') || ' </loc></url>', '' ORDER BY page_id) || '</urlset>' AS xml
  FROM (SELECT {netloc('url')} AS host, page_id // 1000 AS part, page_id, url FROM pages) GROUP BY host, part)"""
