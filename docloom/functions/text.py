"""Text expressions with JavaScript's idea of white space and length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that trim() and \s take as white space in JavaScript.
WS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WS_CHARS = "\t\n\x0b\f\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"


# A run is matched from its first character only (none of its kind before it) and never given back, so time is linear.
_BLANK = WS.replace(r"\n", "")  # within a line
TRAIL = rf"{_BLANK}(?<!{_BLANK}{_BLANK}){_BLANK}*+(?=\n|\z)"
_END = rf"{WS}(?<!{WS}{WS}){WS}*+\z"
TRIM = rf"\A{WS}++|{_END}"
_INK = WS.replace("[", "[^", 1)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, _END, "")


def is_blank(c: Column) -> Column:
    """Whether trimming leaves nothing. What starts with a visible character of ASCII isn't matched at all."""
    return ~((c >= "!") & (c < "\x7f")) & ~F.rlike(c, F.lit(_INK))


def normalize(markdown: Column) -> Column:
    """Each line right-trimmed, then three or more newlines made two; the document itself isn't trimmed."""
    return F.regexp_replace(F.regexp_replace(markdown, TRAIL, ""), "\n{3,}+", "\n\n")


def utf16_length(c: Column) -> Column:
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def decode_utf8(content: Column) -> Column:
    """Bytes to text: invalid ones become U+FFFD, one byte order mark is dropped."""
    return F.regexp_replace(F.call_function("make_valid_utf8", content.cast("string")), r"\A\x{feff}", "")


def or_else(c: Column, other: Column) -> Column:
    """`other` where c is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


# Fixed value: where a page's title is looked for.
TITLE = r"(?i)<title[^>]*>([^<]*)</title>"


def html_title(html: Column) -> Column:
    """Text of the first title tag of the raw source, trimmed, entities kept; null without one."""
    pattern = TITLE
    return F.when(html.rlike(pattern), trim(F.regexp_extract(html, pattern, 1)))
