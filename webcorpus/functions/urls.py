"""URL expressions. Every function maps string columns to a column, so a whole URL
pipeline stays inside one code-generated stage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed
from .bind import let

# scheme, authority, path, query and fragment as in RFC 3986 appendix B
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parts(url) -> Column:
    """[scheme, authority, path, query, fragment] by a single match."""
    return F.split(F.regexp_replace(_c(url), _PARTS, "$1\u0000$2\u0000$3\u0000$4\u0000$5"), "\u0000")


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _PARTS, 1))


def netloc(url) -> Column:
    return F.regexp_extract(_c(url), _PARTS, 2)


def raw_path(url) -> Column:
    return F.regexp_extract(_c(url), _PARTS, 3)


def path(url) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(raw_path(url), r";[^/]*$", "")


def query(url) -> Column:
    return F.regexp_extract(_c(url), _PARTS, 4)


def fragment(url) -> Column:
    return F.regexp_extract(_c(url), _PARTS, 5)


def hostname(url) -> Column:
    """Lower-cased host without user info, port or brackets."""
    auth = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^/?#:\[]*))"
    u = _c(url)
    return F.lower(F.concat(F.regexp_extract(u, auth, 1), F.regexp_extract(u, auth, 2)))


def normalize_url(url) -> Column:
    """Deduplication key: no fragment, no trailing slash, sorted query parts."""
    def build(u):
        p = F.regexp_replace(F.regexp_replace(u[2], r";[^/]*$", ""), r"/+$", "")
        return F.concat(
            F.lower(u[0]), F.lit("://"), u[1], F.when(p == "", F.lit("/")).otherwise(p),
            F.when(u[3] == "", F.lit("")).otherwise(
                F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(u[3], "&")), "&"))),
        )

    return let(parts(url), build)


def domain(url) -> Column:
    d = F.lower(netloc(url))
    return F.when(d.isNull() | (d == ""), F.lit("unknown")).otherwise(d)


def is_valid_http_url(url) -> Column:
    u = F.trim(_c(url))
    return F.coalesce(scheme(u).isin("http", "https") & (netloc(u) != ""), F.lit(False))


def _fold_dots(segments: Column) -> Column:
    """Remove ``.`` and ``..`` segments; a final dot segment leaves a trailing slash."""
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)


def resolve(base, ref) -> Column:
    """Absolute form of ``ref`` on page ``base`` (RFC 3986 section 5)."""

    def mark(sign, value):
        return F.when(value != "", F.concat(F.lit(sign), value)).otherwise("")

    def fold(merged):
        # ".." may climb past the root: the path still starts at it
        folded = F.regexp_replace(F.array_join(_fold_dots(F.split(merged, "/")), "/"), "^(?!/)", "/")
        return F.when(merged.rlike(r"(^|/)\.{1,2}(/|$)"), folded).otherwise(merged)

    def build(x):
        b, r = x["b"], x["r"]
        root = F.concat(F.lower(b[0]), F.lit("://"), b[1])
        tail = F.concat(mark("?", r[3]), mark("#", r[4]))
        # keep the base directory, then drop empty inner segments before folding dots
        folder = F.regexp_replace(b[2], r"[^/]*$", "")
        joined = F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), r[2]), r"/{2,}", "/")
        merged = F.when(r[2].startswith("/"), r[2]).otherwise(joined)
        same_page = F.concat(root, b[2], F.when(r[3] != "", F.concat(F.lit("?"), r[3])).otherwise(mark("?", b[3])), mark("#", r[4]))
        return (
            F.when(x["ref"] == "", x["base"])
            .when((r[0] != "") & (F.lower(r[0]) != F.lower(b[0])), x["ref"])
            .when(r[1] != "", F.concat(F.lower(b[0]), F.lit("://"), r[1], r[2], tail))
            .when(r[2] == "", same_page)
            .otherwise(F.concat(root, let(merged, fold), tail))
        )

    bound = F.struct(parts(base).alias("b"), parts(ref).alias("r"), _c(ref).alias("ref"), _c(base).alias("base"))
    return let(bound, build)


def resolve_link(base, href) -> Column:
    """Absolute http(s) link, or NULL for blank, script, fragment and mail links."""
    h = F.trim(_c(href))
    skip = h.isNull() | (h == "") | h.rlike(r"^(?:javascript:|#|mailto:)")
    return F.when(~skip, let(resolve(base, h), lambda u: F.when(u.rlike(r"^(?i:https?):"), u)))


def has_content_extension(url) -> Column:
    """False for suffixes that are never pages (images, archives, style sheets, ...)."""
    suffix = "|".join(e[1:] for e in fixed.SKIP_EXTENSIONS)
    return ~F.lower(path(url)).rlike(rf"\.(?:{suffix})$")


def glob_regex(pattern: str) -> str:
    return "^" + pattern.replace(".", r"\.").replace("*", ".*") + "$"


def path_match(pattern: str, p: Column) -> Column:
    """Prefix test, or a whole-path glob when the pattern holds ``*``."""
    return p.rlike(glob_regex(pattern)) if "*" in pattern else p.startswith(pattern)


def _any(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds)


def in_domain(host: Column, base: Column) -> Column:
    """The base domain itself or one of its subdomains."""
    return (host == base) | host.endswith(F.concat(F.lit("."), base))


def should_follow(
    url, base_domain, depth, max_depth: int, path_prefix="", allow_external: bool = False,
    allow_backward: bool = False, include: list[str] | None = None, exclude: list[str] | None = None,
) -> Column:
    """Scope test for a discovered link."""
    u = _c(url)
    p = path(u)
    d = F.lit(depth) if isinstance(depth, int) else _c(depth)
    base = F.lit(base_domain) if isinstance(base_domain, str) else base_domain
    prefix = F.lit(path_prefix) if isinstance(path_prefix, str) else path_prefix
    ok = (d <= max_depth) & scheme(u).isin("http", "https") & has_content_extension(u)
    if not allow_external:
        ok = ok & (netloc(u) == base)
    if not allow_backward:
        ok = ok & ((prefix == "") | p.startswith(prefix))
    if include:
        ok = ok & _any([p.startswith(i) | path_match(i, p) for i in include])
    if exclude:
        ok = ok & ~_any([p.startswith(e) | path_match(e, p) for e in exclude])
    return ok


def page_number(url) -> Column:
    """Number of the first pagination pattern that matches, else NULL."""
    u = _c(url)

    def first(target):
        return F.coalesce(*[
            F.when(target.rlike(p), F.regexp_extract(target, p, 1).cast("long")) for p in fixed.PAGINATION_PATTERNS])

    return let(F.concat(path(u), F.lit("?"), query(u)), first)


def page_base(url) -> Column:
    """Parent path that groups the pages of one listing."""
    u = _c(url)
    return F.concat(scheme(u), F.lit("://"), netloc(u), F.regexp_replace(path(u), r"/[^/]*$", ""))


def detect_pagination(links: DataFrame, url: str, site: str) -> DataFrame:
    """Per site, the listing with most distinct page numbers, one row per page.

    Distinct (listing, page) pairs are reduced before the shuffle; the winning listing is
    picked from counts, so no list of pages is ever built in one group.
    """
    pages = (
        links.select(F.col(site), page_base(url).alias("base"), page_number(url).alias("page"))
        .filter(F.col("page").isNotNull())
        .distinct()
    )
    counts = pages.groupBy(site, "base").agg(F.count("*").alias("n"))
    best = counts.groupBy(site).agg(
        F.max(F.struct(F.col("n"), F.col("base"))).alias("_m")
    ).select(site, F.col("_m.base").alias("base"))
    return pages.join(best, [site, "base"]).select(site, "base", "page")


def priority_order(url, depth, base_domain) -> list[Column]:
    """Sort keys of the crawl queue: on-domain first, shallow first, short first, then URL."""
    u = _c(url)
    base = F.lit(base_domain) if isinstance(base_domain, str) else base_domain
    return [F.when(netloc(u) == base, 0).otherwise(100), _c(depth), F.length(u), u]


def _query_value(q: Column, key: str) -> Column:
    return F.regexp_extract(q, rf"(?:^|&){key}=([^&]*)", 1)


def _percent_decode(s: Column) -> Column:
    """Decode %XX once; ``+`` stays ``+``."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(s, r"\+", "%2B")), s)


def decode_bing(href) -> Column:
    """Target of a result wrapper whose ``u`` parameter is ``a1`` + url-safe base64."""
    h = _c(href)

    def target(u):
        b64 = F.translate(F.substr(u, F.lit(3)), "-_", "+/")
        padded = F.rpad(b64, F.length(b64) + F.pmod(-F.length(b64), F.lit(4)).cast("int"), F.lit("="))
        return F.when(u.startswith("a1"), F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"))

    return F.when(h.contains("bing.com/ck/a"), F.coalesce(let(_query_value(query(h), "u"), target), h)).otherwise(h)


def decode_ddg(href) -> Column:
    """Target of an ``/l/?uddg=`` wrapper, decoded exactly once; "" when not http(s)."""
    h = _c(href)
    wrapped = netloc(h).contains("duckduckgo.com") & (path(h) == "/l/")
    candidate = F.when(wrapped, _percent_decode(_query_value(query(h), "uddg"))).otherwise(h)
    return let(candidate, lambda c: F.when(c.rlike(r"^(?i:https?):"), c).otherwise(""))


def result_url(href, base_url: str, bing: bool = False, ddg: bool = False) -> Column:
    """Safe absolute destination of a search-result link, "" when there is none."""
    cand = resolve(F.lit(base_url), F.trim(F.coalesce(_c(href), F.lit(""))))
    if bing:
        cand = let(cand, decode_bing)
    if ddg:
        cand = let(cand, decode_ddg)

    def check(c):
        ok = c.rlike(r"^(?i:https?)://(?:[^/?#]*@)?[^/?#:]")
        if bing:
            # an unresolved wrapper is not a destination
            ok = ok & ~c.rlike(r"^(?i)https?://(?:[^/?#]*@)?(?:[^/?#]*\.)?bing\.com(?::\d*)?/ck/a(?:[?#;]|$)")
        return F.when(ok, F.regexp_replace(c, r"(?s)#.*$", "")).otherwise("")

    return let(cand, check)


def _ipv4_number(host: Column) -> Column:
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    valid = host.rlike(rf"^{octet}(\.{octet}){{3}}$")
    parts = F.split(host, r"\.")
    value = sum((F.get(parts, i).cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(valid, value)


def _cidr_bounds(cidr: str) -> tuple[int, int]:
    addr, bits = cidr.split("/")
    start = sum(int(o) * 256 ** (3 - i) for i, o in enumerate(addr.split(".")))
    return start, start + 2 ** (32 - int(bits)) - 1


def _non_global_ipv4(n: Column) -> Column:
    inside = _any([n.between(lo, hi) for lo, hi in map(_cidr_bounds, fixed.NON_GLOBAL_IPV4)])
    exceptions = [_cidr_bounds(f"{a}/32")[0] for a in fixed.GLOBAL_IPV4_EXCEPTIONS]
    return inside & ~n.isin(exceptions)


def _nat64_number(host: Column) -> Column:
    """IPv4 number embedded in 64:ff9b::/96, dotted or hexadecimal."""
    dotted = _ipv4_number(F.regexp_extract(host, r"^(?:64|0064):ff9b:(?:(?:0{1,4}:){4}|:)(\d+\.\d+\.\d+\.\d+)$", 1))
    hexa = r"^(?:64|0064):ff9b:(?:(?:0{1,4}:){4}|:)([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    hi, lo = (F.conv(F.regexp_extract(host, hexa, i), 16, 10).cast("long") for i in (1, 2))
    low_only = r"^(?:64|0064):ff9b::([0-9a-f]{1,4})$"
    lo2 = F.conv(F.regexp_extract(host, low_only, 1), 16, 10).cast("long")
    return (
        F.when(dotted.isNotNull(), dotted)
        .when(host.rlike(hexa), hi * 65536 + lo)
        .when(host.rlike(low_only), lo2)
        .when(host.rlike(r"^(?:64|0064):ff9b::$"), F.lit(0).cast("long"))
    )


# text forms of loopback, unspecified, unique-local, link-local, documentation,
# discard-only, protocol-assignment and 6to4 prefixes
_NON_GLOBAL_IPV6 = (
    r"^(?:::1?|(?:0{1,4}:){7}0{0,3}[01]|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|2001:0?db8:.*"
    r"|100::.*|2002:.*|64:ff9b:1:.*|3fff:0?[0-9a-f]{0,3}:.*|2001:(?::|0{0,2}[01]?[0-9a-f]{1,2}:).*)$"
)
_MAPPED_IPV4 = r"^::ffff:(\d+\.\d+\.\d+\.\d+)$"


def is_public_url(url) -> Column:
    """Literal part of the target check: scheme, reserved names and non-global addresses."""

    def numbers(host):
        bare = F.regexp_replace(host, r"%.*$", "")
        v6 = bare.contains(":")
        return F.struct(
            host.alias("host"), bare.alias("bare"), v6.alias("v6"),
            F.coalesce(_ipv4_number(bare), F.when(v6, _ipv4_number(F.regexp_extract(bare, _MAPPED_IPV4, 1)))).alias("v4"),
            F.when(v6, _nat64_number(bare)).alias("nat"))

    def check(x):
        return ~(
            x["host"].isin(fixed.BLOCKED_HOSTS) | x["host"].endswith(".localhost") | (x["host"] == "")
            | F.coalesce(_non_global_ipv4(x["v4"]), F.lit(False)) | F.coalesce(_non_global_ipv4(x["nat"]), F.lit(False))
            | (x["v6"] & x["nat"].isNull() & x["bare"].rlike(_NON_GLOBAL_IPV6)))

    public = let(let(F.regexp_replace(hostname(url), r"\.+$", ""), numbers), check)
    return F.coalesce(scheme(url).isin("http", "https") & public, F.lit(False))


def is_ad_url(url, hosts: list[str] | None = None) -> Column:
    """True when a host (or host + path prefix) of the list occurs at a ``/`` boundary."""
    names = "|".join(re.escape(h) for h in (hosts or fixed.AD_HOSTS))
    return _c(url).rlike(rf"/(?:{names})/")


def is_ad_host(url, hosts: list[str] | None = None) -> Column:
    """True when the host is a listed one or below it."""
    names = "|".join(re.escape(h) for h in (hosts or fixed.AD_HOSTS) if "/" not in h)
    return hostname(url).rlike(rf"(?:^|\.)(?:{names})$")


def is_pdf(content_type, url) -> Column:
    ct = F.lower(F.coalesce(_c(content_type), F.lit("")))
    return ct.contains("pdf") | ct.contains("application/octet-stream") | F.lower(_c(url)).endswith(".pdf")


def _looks_like_id(s: Column) -> Column:
    bare = F.regexp_replace(s, r"[-_]", "")
    alnum = bare.rlike(r"^[\p{L}\p{Nd}]+$")
    alpha = s.rlike(r"^\p{L}+$")
    dashes = F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit("")))
    return (F.length(s) >= 8) & ((dashes >= 2) | (alnum & ~alpha))


def endpoint_key(method, request_path) -> Column:
    """``METHOD /path`` with identifier-like segments replaced by ``{id}``."""
    stripped = F.regexp_replace(_c(request_path), r"^/+|/+$", "")
    parts = F.transform(F.split(stripped, "/"), lambda s: F.when(_looks_like_id(s), F.lit("{id}")).otherwise(s))
    return F.concat(F.upper(_c(method)), F.lit(" /"), F.array_join(parts, "/"))


def urls_in_text(text, limit: int | None = None) -> Column:
    """URLs of a text in order of first occurrence."""
    found = F.regexp_extract_all(_c(text), F.lit(f"({fixed.URL_IN_TEXT})"), F.lit(1))
    kept = F.array_distinct(F.filter(found, lambda u: netloc(u) != ""))
    return F.slice(kept, 1, limit) if limit else kept


def contains_ignore_case(url, needle: str) -> Column:
    return F.lower(_c(url)).contains(needle.lower())
