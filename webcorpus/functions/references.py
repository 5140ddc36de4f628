"""Character references of HTML as a Spark expression."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

from .bind import let

_PIECE = r"(&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?|&|[^&]+)"
#: Names that browsers also know without a semicolon, the longest first.
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


#: Marks in the table of names: before a name, between it and its value.
_BEFORE, _BETWEEN = "\x01", "\x02"
#: Names that make up nearly all references in pages; they need no search.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;")
_RARE = f"&(?!(?:{'|'.join(_COMMON)}))[#A-Za-z]"


def _value(name: str) -> str:
    # a space that does not break counts as a space
    return " " if html5[name] == "\xa0" else html5[name]


#: One string literal: plans with a map of all names take seconds to analyse.
_TABLE = "".join(f"{_BEFORE}{n}{_BETWEEN}{_value(n)}" for n in sorted(html5)) + _BEFORE
_WINDOWS = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160))


def _named(name: Column) -> Column:
    """The value of a name, None for unknown ones."""
    behind = F.call_function("substring_index", F.lit(_TABLE), F.concat(F.lit(_BEFORE), name, F.lit(_BETWEEN)), F.lit(-1))
    return let(behind, lambda rest: F.when(F.length(rest) < len(_TABLE), F.substring_index(rest, _BEFORE, 1)))


def _windows(code: Column) -> Column:
    """Numbers 128 to 159 mean the characters of the Windows code page."""
    return F.substring(F.lit(_WINDOWS), code.cast("int") - 127, F.lit(1))


def _numbered(code: Column) -> Column:
    """The character of a decimal number; what no text may hold becomes U+FFFD or nothing."""
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    bad = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    no_text = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.when(bad, F.lit("�")).when(code.between(128, 159), _windows(code)).when(code == 160, " ").when(code == 13, "\r").when(no_text, "").otherwise(wide)


def _one(piece: Column) -> Column:
    digits = F.regexp_extract(piece, r"^&#(?:0*([0-9]{1,9});?$)", 1)
    hexed = F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]{1,8});?$", 1)
    number = let(F.when(hexed != "", F.conv(hexed, 16, 10).cast("long")).when(digits != "", digits.cast("long")), _numbered)
    zero = F.when(piece.rlike(r"^&#(?:[xX]0+|0+);?$"), F.lit("�"))

    def name(n: Column) -> Column:
        # the whole name or, for names known without a semicolon, its longest beginning
        open_ = let(F.regexp_extract(n, f"^({_OPEN_NAMES})", 1), lambda s: F.when(s != "", F.concat(_named(s), F.substring(n, F.length(s) + 1, F.length(n)))))
        return F.coalesce(_named(n), open_, piece)

    out = F
    for n in _COMMON:
        out = out.when(piece == f"&{n}", _value(n))
    return out.when(~piece.startswith("&") | (piece == "&"), piece).when(piece.startswith("&#"), F.coalesce(zero, number)).otherwise(let(F.substring(piece, 2, F.length(piece)), name))


def decode_references(text: Column) -> Column:
    """Text with all named and numbered character references decoded once, from left to right."""
    def decode(t):
        plain = t
        # none of these values but the last holds a "&", so one after the other is the same as once from left to right
        for n in sorted(_COMMON, key=lambda n: n == "amp;"):
            plain = F.replace(plain, F.lit(f"&{n}"), F.lit(_value(n)))
        pieces = F.transform(F.regexp_extract_all(t, F.lit(_PIECE), F.lit(1)), _one)
        return F.when(~t.contains("&"), t).when(t.rlike(_RARE), F.array_join(pieces, "")).otherwise(plain)

    return let(text, decode)
