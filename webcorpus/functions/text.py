"""Text expressions: hashing, truncation, change normalisation, sentences, scoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .bind import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_BLANKS = r"(?U)\s+"


def collapse_space(text) -> Column:
    return F.regexp_replace(_c(text), _BLANKS, " ")


# every character that counts as white space at the ends of a text
_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip_space(text) -> Column:
    """Trim any Unicode white space, not only blanks."""
    return F.btrim(_c(text), F.lit(_SPACE))


def content_hash(text) -> Column:
    """16 hex digits over lower-cased text with collapsed white space."""
    return F.substring(F.sha2(F.lower(F.trim(collapse_space(text))), 256), 1, 16)


def collapse_blank_lines(md) -> Column:
    return strip_space(F.regexp_replace(_c(md), r"\n{3,}", "\n\n"))


def cap(text, n: int) -> Column:
    return F.substring(_c(text), 1, n)


def strip_base64_images(md) -> Column:
    return F.regexp_replace(_c(md), fixed.BASE64_IMAGE, "")


def ellipsis(text, limit: int = fixed.LOG_TEXT_CHARS) -> Column:
    t = _c(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def normalize_for_diff(text) -> Column:
    """Text with the parts that change without meaning replaced by markers."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    marked = F.regexp_replace(t, fixed.DIFF_URL, "[URL]")
    marked = F.regexp_replace(marked, fixed.DIFF_DATE, "[DATE]")
    marked = F.regexp_replace(marked, fixed.DIFF_TIME, "[TIME]")
    # an address, a date and a time all hold a colon or a slash; a search for bytes is far cheaper than the patterns
    spaced = collapse_space(F.when(t.contains(":") | t.contains("/"), marked).otherwise(t))
    joiner = t.contains("\u200b") | t.contains("\u200c") | t.contains("\u200d")
    return F.trim(F.when(joiner, F.regexp_replace(spaced, r"[\u200b\u200c\u200d]", "")).otherwise(spaced))


def change_hash(text) -> Column:
    return F.sha2(normalize_for_diff(text), 256)


def split_sentences(text) -> Column:
    parts = F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"(?U)(?<=[.!?])\s+"), strip_space)
    return F.filter(parts, lambda s: F.length(s) > fixed.SENTENCE_MIN_CHARS)


def normalize_sentence(s) -> Column:
    return _normalize_stripped(strip_space(_c(s)))


def _normalize_stripped(s) -> Column:
    t = F.regexp_replace(collapse_space(F.lower(s)), r"(?U)[^\w\s]", "")
    return F.substring(t, 1, fixed.DIFF_SENTENCE_CHARS)


def sentence_set(text) -> Column:
    return F.array_distinct(F.transform(split_sentences(text), _normalize_stripped))


def sentence_changes(old, new) -> Column:
    """Sorted added, then sorted removed sentences, first 50."""
    return set_changes(sentence_set(old), sentence_set(new))


def set_changes(old, new) -> Column:
    """``sentence_changes`` of texts whose sentence sets are known."""
    def side(a, b, label):
        long_ones = F.filter(F.array_except(a, b), lambda s: F.length(s) > fixed.DIFF_MIN_CHARS)
        return F.transform(
            F.array_sort(long_ones),
            lambda s: F.concat(F.lit(label), F.substring(s, 1, fixed.DIFF_SENTENCE_CHARS)),
        )

    both = F.struct(_c(old).alias("o"), _c(new).alias("n"))
    return let(both, lambda x: F.slice(
        F.concat(side(x["n"], x["o"], "+ Added: "), side(x["o"], x["n"], "- Removed: ")), 1, fixed.DIFF_MAX_CHANGES))


def words(text) -> Column:
    """Distinct lower-cased words split on white space."""
    return F.array_distinct(
        F.filter(F.split(F.lower(_c(text)), _BLANKS), lambda w: w != "")
    )


def _matched(content, question, score) -> Column:
    """``score(x)`` over body, question, number of matching words and number of words."""
    sides = F.struct(F.lower(_c(content)).alias("body"), F.lower(_c(question)).alias("q"), words(question).alias("w"))
    counted = let(sides, lambda x: F.struct(
        x["body"].alias("body"), x["q"].alias("q"), F.size(x["w"]).cast("double").alias("n"),
        F.size(F.filter(x["w"], lambda w: x["body"].contains(w))).cast("double").alias("hit")))
    return let(counted, score)


def relevance(content, question) -> Column:
    """Share of question words in the content, plus phrase and length bonuses, at most 1."""

    def score(x):
        share = x["hit"] / x["n"]
        phrase = F.when(x["body"].contains(x["q"]), F.least(F.lit(1.0), share + 0.3)).otherwise(share)
        bonus = F.least(F.lit(0.1), F.length(_c(content)) / F.lit(50000.0))
        return F.when(x["n"] == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), phrase + bonus))

    return _matched(content, question, score)


def word_overlap(content, query) -> Column:
    """Share of query words in the content, 0 for an empty side."""

    def score(x):
        empty = (F.coalesce(x["body"], F.lit("")) == "") | (F.coalesce(x["n"], F.lit(0.0)) == 0)
        return F.when(empty, F.lit(0.0)).otherwise(F.least(x["hit"] / x["n"], F.lit(1.0)))

    return _matched(content, query, score)


def relevant_quote(content, question) -> Column:
    """Sentence sharing most words with the question (first on ties), at most 500 chars."""
    body = _c(content)
    sentences = F.filter(F.transform(F.split(body, r"[.!?]+"), strip_space), lambda s: F.length(s) > 30)

    def best(q):
        scored = F.transform(
            sentences,
            lambda s, i: F.struct(F.size(F.array_intersect(q, words(s))).alias("n"), (-i).alias("p"), s.alias("s")),
        )
        return F.array_max(scored).getField("s")

    return F.when(F.coalesce(body, F.lit("")) == "", F.lit("")).otherwise(
        F.substring(F.coalesce(let(words(question), best), body), 1, 500)
    )


def first_paragraph(markdown, max_length: int = 300) -> Column:
    """First line longer than 50 characters, else the start of the text."""
    md = F.coalesce(_c(markdown), F.lit(""))
    lines = F.filter(F.transform(F.split(md, "\n"), strip_space), lambda s: F.length(s) > 50)
    return F.substring(F.coalesce(F.get(lines, 0), md), 1, max_length)


def long_words(text, min_len: int = 5, first: int = 3) -> Column:
    """Words longer than four characters, first three, with their case."""
    parts = F.filter(F.split(_c(text), _BLANKS), lambda w: F.length(w) >= min_len)
    return F.slice(parts, 1, first)


def confidence_label(confidence) -> Column:
    c = _c(confidence)
    out = F
    for bound, label in fixed.CONFIDENCE_LABELS:
        out = out.when(c >= bound, label)
    return out.otherwise("UNVERIFIED")
