"""HTML expressions: no parser, no Python worker.

Everything here is an expression over the page string and prunes like any other column. Where
elements of one name nest, a page is split once at the tags of that name and their running sum
gives the depth: no pattern looks at the text between two tags, so time grows with the page
alone, whatever is left open. What nobody closes needs the document tree of ``operators.dom``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed
from .bind import let, scan
from .references import decode_references
from .text import collapse_space, strip_space


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def unescape(text) -> Column:
    """Decode all character references."""
    return decode_references(_c(text))


def _up_to_last(h: Column, end: str) -> Column:
    """The text up to the last match of ``end``: in it, everything that begins finds an end."""
    return F.regexp_extract(h, rf"(?is)^(.*{end})", 1)


def _replace_closed(h: Column, begin: str, end: str) -> Column:
    """Drops all stretches from ``begin`` to the next ``end``; open ones stay."""
    return let(_up_to_last(h, end), lambda head: F.concat(F.regexp_replace(head, rf"(?is){begin}.*?{end}", ""), F.substring(h, F.length(head) + 1, F.length(h))))


def without_comments(html) -> Column:
    def cut(h):
        # up to the last end, every comment that begins is closed
        closed = F.length(h) - F.length(F.substring_index(h, "-->", -1))
        dropped = let(closed, lambda n: F.concat(F.regexp_replace(F.substring(h, F.lit(1), n), r"(?s)<!--.*?-->", ""), F.substring(h, n + 1, F.length(h))))
        return F.when(h.contains("<!--"), dropped).otherwise(h)

    return let(_c(html), cut)


def without_code(html) -> Column:
    """Page without comments, scripts and styles: what tag patterns may look at."""
    def without(h, name):
        return let(h, lambda x: F.when(x.rlike(f"(?i)</{name}"), _replace_closed(x, rf"<{name}\b[^>]*>", rf"</{name}\s*>")).otherwise(x))

    return without(without(without_comments(html), "script"), "style")


def title(html) -> Column:
    return strip_space(unescape(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def description(html) -> Column:
    name_first = r"""(?is)<meta\b[^>]*(?<=\s)name\s*=\s*["']?description(?=["'\s/>])["']?[^>]*(?<=["'\s])content\s*=\s*["']([^"']*)["']"""
    content_first = r"""(?is)<meta\b[^>]*(?<=\s)content\s*=\s*["']([^"']*)["'][^>]*(?<=["'\s])name\s*=\s*["']?description["'\s/>]"""
    h = _c(html)
    return unescape(
        F.coalesce(
            _nullif_empty(F.regexp_extract(h, name_first, 1)),
            _nullif_empty(F.regexp_extract(h, content_first, 1)),
            F.lit(""),
        )
    )


def language(html) -> Column:
    lang = F.regexp_extract(_c(html), r"""(?is)<html\b[^>]*(?<=\s)lang\s*=\s*["']?([^"'\s>]+)""", 1)
    return F.coalesce(_nullif_empty(lang), F.lit("en"))


def _attr(tag: Column, name: str) -> Column:
    dq = F.regexp_extract(tag, rf"""(?is)(?<=\s){name}\s*=\s*"([^"]*)\"""", 1)
    sq = F.regexp_extract(tag, rf"(?is)(?<=\s){name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"""(?is)(?<=\s){name}\s*=\s*([^"'\s>]+)""", 1)
    return F.coalesce(_nullif_empty(dq), _nullif_empty(sq), _nullif_empty(bare), F.lit(""))


def meta_map(html) -> Column:
    """name / property / http-equiv to content; the last of equal names wins."""
    tags = F.regexp_extract_all(_c(html), F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    pairs = F.transform(
        tags,
        lambda t: F.struct(
            F.coalesce(
                _nullif_empty(_attr(t, "name")), _nullif_empty(_attr(t, "property")),
                _nullif_empty(_attr(t, "http-equiv")), F.lit(""),
            ).alias("k"),
            unescape(_attr(t, "content")).alias("v"),
        ),
    )
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    # build the map from the last pair of every name, so no duplicate key is left
    last = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))),
        lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["k"] == p["k"]),
    )
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def inner_text(html) -> Column:
    return strip_space(unescape(F.regexp_replace(_c(html), r"(?s)<[^>]+>", "")))


def headings(html) -> Column:
    """level, text (at most 500 characters) and id of every heading in order."""
    pat = r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)"
    blocks = F.regexp_extract_all(_up_to_last(without_code(html), r"</h[1-6]\s*>"), F.lit(pat), F.lit(1))
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.regexp_extract(b, r"(?i)^<h([1-6])", 1).cast("int").alias("level"),
            F.substring(inner_text(b), 1, 500).alias("text"),
            _attr(F.regexp_extract(b, r"(?s)^(<[^>]*>)", 1), "id").alias("id"),
        ),
    )


_A_HREF = r"""(?is)<a\b[^>]*?(?<=\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""


def hrefs(html) -> Column:
    """``href`` of every anchor in document order."""
    h = without_code(html)
    tags = F.regexp_extract_all(h, F.lit(r"(?is)(<a\b[^>]*(?<=\s)href\s*=[^>]*>)"), F.lit(1))
    return F.transform(tags, lambda t: unescape(_attr(t, "href")))


def link_records(html) -> Column:
    """href, anchor text (at most 200 characters) and rel; script links dropped."""
    pat = r"(?is)(<a\b[^>]*\bhref\s*=[^>]*>.*?)</a\s*>"
    blocks = F.regexp_extract_all(_up_to_last(without_code(html), r"</a\s*>"), F.lit(pat), F.lit(1))
    recs = F.transform(
        blocks,
        lambda b: F.struct(
            unescape(_attr(F.regexp_extract(b, r"(?s)^(<[^>]*>)", 1), "href")).alias("href"),
            F.substring(inner_text(b), 1, 200).alias("text"),
            _attr(F.regexp_extract(b, r"(?s)^(<[^>]*>)", 1), "rel").alias("rel"),
        ),
    )
    return F.filter(recs, lambda r: (r["href"] != "") & ~r["href"].startswith("javascript:"))


def _at_tags(h: Column, name: Column) -> Column:
    """The page split before every start and end tag of a name."""
    return F.split(h, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s/>])")))


def _tag(piece: Column) -> Column:
    """The tag at the head of a piece, all of it where nothing ends the tag."""
    return let(F.instr(piece, ">"), lambda n: F.when(n > 0, F.substring(piece, F.lit(1), n)).otherwise(piece))


def _behind_tag(piece: Column) -> Column:
    return let(F.instr(piece, ">"), lambda n: F.when(n > 0, F.substring(piece, n + 1, F.length(piece))).otherwise(""))


def _balanced(tail: Column, name: Column) -> Column:
    """The element whose start tag begins ``tail``, to its own end tag.

    Tags of the same name inside are counted. Without any end tag there is no element (None); with too few it goes to the end of the page.
    """
    def cut(pieces):
        def step(s, p):
            closing = p.startswith("</")
            depth = s["depth"] + F.when(closing, -1).otherwise(1)
            return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), (depth <= 0).alias("done"), (s["closed"] | closing).alias("closed")))

        zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"), F.lit(False).alias("closed"))
        return let(F.aggregate(pieces, zero, step), lambda s: F.when(s["done"], F.concat(F.array_join(F.slice(pieces, 1, s["n"] - 1), ""), _tag(F.get(pieces, s["n"] - 1)))).when(s["closed"], tail))

    return let(_at_tags(tail, name), cut)


def _from_tag(h: Column, name: str) -> Column:
    """The page from the first start tag of a name on, None where there is none."""
    return F.get(F.split(F.concat(F.lit(" "), h), rf"(?i)(?=<{name}[\s/>])", 2), 1)


def _element(h: Column, tag: str) -> Column:
    """The first element of a name, None where there is none."""
    return let(_from_tag(h, tag), lambda tail: F.when(tail.isNotNull(), _balanced(tail, F.lit(tag))))


def _role_main(h: Column) -> Column:
    role = r"""(?is)(<[a-z][a-z0-9-]*\b[^>]*(?<=\s)role\s*=\s*(?:"main"|'main'|main(?=[\s/>]))[^>]*>)"""
    name = lambda start: F.regexp_extract(start, r"(?s)^<([A-Za-z0-9-]+)", 1)
    return let(F.regexp_extract(h, role, 1), lambda start: F.when(start != "", let(F.substring(h, F.instr(h, start), F.length(h)), lambda tail: _balanced(tail, name(start)))))


def main_content(html) -> Column:
    """First of main, article, role=main, body; else the page."""
    def pick(h):
        # the cheap substring test spares pages without the element the pattern
        low = F.lower(h)
        return F.coalesce(
            F.when(low.contains("<main"), _element(h, "main")), F.when(low.contains("<article"), _element(h, "article")),
            F.when(low.contains("role"), _role_main(h)), _element(h, "body"), h)

    return let(without_code(html), pick)


def body_content(html) -> Column:
    return let(without_code(html), lambda h: F.coalesce(_element(h, "body"), h))


def _without(html: Column, start_tag: str) -> Column:
    """Drops every element whose start tag matches, with all it holds.

    Name by name: only tags of the names that occur in such start tags are looked at. An element that is not closed stays, start tag and all.
    """
    def tags(h):
        found = F.regexp_extract_all(h, F.lit(rf"(?is)({start_tag})"), F.lit(1))
        return F.array_distinct(F.transform(found, lambda t: F.lower(F.regexp_extract(t, r"(?s)^<([A-Za-z0-9-]+)", 1))))

    return let(html, lambda h: F.aggregate(tags(h), h, lambda page, name: _without_named(page, name, rf"(?is)^(?:{start_tag})")))


#: Depth of no element.
_OPEN_NOWHERE = -(1 << 30)


def _without_named(page: Column, name: Column, start_tag: str) -> Column:
    """Drops the closed elements of one name whose start tag matches."""
    def split(pieces):
        # only the first piece may begin with something else than a tag of the name
        def mark(p, i):
            tag = (i > 0) | F.rlike(p, F.concat(F.lit("(?i)^</?"), name, F.lit(r"[\s/>]")))
            return F.struct(F.when(~tag, 0).when(p.startswith("</"), -1).otherwise(1).alias("sign"), (tag & p.rlike(start_tag)).alias("begins"))

        # from the last piece back: the sum of signs from a piece on, and its greatest value behind the piece. An element is closed if that reaches its own
        zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("behind"), F.lit(0).alias("most"), F.lit(False).alias("begins"))

        def back(s, m):
            now = s["sum"] + m["sign"]
            return F.struct(now.alias("sum"), s["most"].alias("behind"), F.greatest(s["most"], now).alias("most"), m["begins"].alias("begins"))

        # the depth behind a piece is its sum of signs less its own sign: the ``sum`` of the next piece
        def forth(s, m):
            open_ = s["level"] != _OPEN_NOWHERE
            ended = open_ & (m["sum"] == s["level"])
            starts = ~(open_ & ~ended) & m["begins"]
            closed = starts & ~name.isin(_VOID) & (m["behind"] >= m["sum"])
            level = F.when(closed, m["sum"]).when(open_ & ~ended, s["level"]).otherwise(_OPEN_NOWHERE)
            return F.struct(level.cast("int").alias("level"), ended.alias("ended"), (starts & name.isin(_VOID)).alias("void"))

        states = scan(F.reverse(scan(F.reverse(F.transform(pieces, mark)), zero, back)), F.struct(F.lit(_OPEN_NOWHERE).alias("level"), F.lit(False).alias("ended"), F.lit(False).alias("void")), forth)
        return let(states, lambda st: F.array_join(kept(pieces, st), ""))

    def kept(pieces, states):
        # the end tag is the last piece inside its element: what follows it stays
        def one(p, i):
            inside = F.get(states, i)["level"] != _OPEN_NOWHERE
            last = F.coalesce(F.get(states, i + 1)["ended"], inside & (i == F.size(pieces) - 1))
            return F.when(~inside & ~F.get(states, i)["void"], p).when(~inside | last, _behind_tag(p)).otherwise("")

        return F.transform(pieces, one)

    return let(_at_tags(page, name), split)


#: Elements that hold nothing and have no end tag.
_VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


_NOISE_TAG = rf"<(?:{'|'.join(fixed.NOISE_TAGS)})(?=[\s/>])[^>]*>"


def without_noise_tags(html) -> Column:
    return _without(_c(html), _NOISE_TAG)


def is_noise_class(css_class) -> Column:
    """Whole-word test of a class attribute against the page-furniture words."""
    parts = F.split(F.lower(F.coalesce(_c(css_class), F.lit(""))), r"[-_\s]+")
    return F.exists(
        parts,
        lambda w: w.isin(fixed.NOISE_CLASS_WORDS)
        | reduce(lambda a, b: a | b, [w.endswith(s) for s in fixed.NOISE_CLASS_SUFFIXES]),
    )


def _noise_word_regex() -> str:
    suffix = "|".join(fixed.NOISE_CLASS_SUFFIXES)
    return rf"(?:{'|'.join(fixed.NOISE_CLASS_WORDS)}|[^\s\"'_-]*(?:{suffix}))"


def _noise_class_tag() -> str:
    word = _noise_word_regex()
    quoted = "|".join(rf"{q}(?:[^{q}]*[-_\s])?{word}(?:[-_\s][^{q}]*)?{q}" for q in ('"', "'"))
    bare = rf"(?:[^\s\"'>]*[-_])?{word}(?:[-_][^\s\"'>]*)?(?=[\s/>])"
    return rf"<[a-z][a-z0-9-]*\b[^>]*(?<=\s)class\s*=\s*(?:{quoted}|{bare})[^>]*>"


def without_noise_classes(html) -> Column:
    """Drop elements whose class is page furniture, with all they hold."""
    return _without(_c(html), _noise_class_tag())


def clean_content(html, only_main: bool = True) -> Column:
    """Content element without page furniture, by tag or by class."""
    h = main_content(html) if only_main else body_content(html)
    return _without(h, f"(?:{_NOISE_TAG}|{_noise_class_tag()})")


def plain_text(content) -> Column:
    """Text of an HTML fragment: tags to blanks, references decoded, white space collapsed."""
    bare = F.regexp_replace(without_code(content), r"(?s)<[^>]+>", " ")
    return F.trim(collapse_space(unescape(bare)))


def main_links(html) -> Column:
    return hrefs(clean_content(html))


def header_block(title_col, description_col, body) -> Column:
    """``# title``, ``> description`` and body, skipping what is missing."""
    def line(prefix, c):
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(prefix), c, F.lit("\n")))

    b = _c(body)
    return F.concat_ws(
        "\n", line("# ", _c(title_col)), line("> ", _c(description_col)),
        F.when(F.coalesce(b, F.lit("")) != "", b),
    )


def page_metadata(url, html, status=None, final_url=None) -> Column:
    landed = F.coalesce(_c(final_url), _c(url)) if final_url is not None else _c(url)
    code = _c(status).cast("int") if status is not None else F.lit(None).cast("int")
    return F.struct(
        landed.alias("url"),
        _c(url).alias("source_url"),
        (landed != _c(url)).alias("redirected"),
        title(html).alias("title"),
        description(html).alias("description"),
        language(html).alias("language"),
        F.coalesce(code, F.lit(200)).alias("status_code"),
        code.isNotNull().alias("status_code_reported"),
    )


def is_challenge_page(title_col, text) -> Column:
    page = F.lower(F.concat_ws(" ", _c(title_col), _c(text)))
    return page.rlike("|".join(fixed.CHALLENGE_PHRASES))


def content_size_class(markdown) -> Column:
    n = F.length(F.coalesce(_c(markdown), F.lit("")))
    return F.when(n == 0, "empty").when(n <= fixed.THIN_CONTENT_CHARS, "thin").otherwise("ok")


FORMATS = {
    "raw_html": lambda h: _c(h),
    "html": lambda h: clean_content(h),
    "text": lambda h: plain_text(clean_content(h)),
    "links": lambda h: main_links(h),
    "all_links": lambda h: hrefs(h),
}


def outputs(html, formats: list[str]) -> list[Column]:
    """Only the requested outputs, each its own expression so others are pruned."""
    return [FORMATS[f](html).alias(f) for f in dict.fromkeys(formats)]
