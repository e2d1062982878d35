"""Markdown from tables, sheets, pages, slides, lists and messages held in arrays and structs.

A lambda here never uses the variable of a lambda around it, but gets what it needs in the array that it is applied
to: Spark can't pass the result of one that does to a Python function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import is_blank, or_else, trim

NO_SHEETS = "*No data could be extracted from this spreadsheet.*"
NO_PAGES = "*No text content could be extracted from this PDF.*"
NO_SLIDES = "*No text content could be extracted from this presentation.*"


def escape_cell(cell: Column) -> Column:
    """| escaped, newlines made blanks, carriage returns deleted; null is empty."""
    c = F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit(r"\|"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


BLOCKS = "struct<tag:array<string>,text:array<string>,href:array<string>,cells:array<array<array<string>>>>"
#: What stands before and after the text of an element; elements without an entry are their text.
MARKS = {
    **{f"h{k}": ("#" * k + " ", "\n\n") for k in range(1, 7)},
    "p": ("", "\n\n"), "blockquote": ("> ", "\n\n"), "pre": ("```\n", "\n```\n\n"), "code": ("`", "`"),
    "strong": ("**", "**"), "b": ("**", "**"), "em": ("*", "*"), "i": ("*", "*"), "br": ("\n", ""),
}


def blocks(b: Column) -> Column:
    """Markdown of the blocks of an HTML body (see BLOCKS), before its line ends are normalized.

    A list or table in another block is only that block's text, cells aren't escaped or padded, a list item outside a
    list is nothing, and texts between elements are followed by a blank.
    """
    marks = [F.create_map(*(F.lit(x) for tag, pair in MARKS.items() for x in (tag, pair[side]))) for side in (0, 1)]
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    inked = lambda cells: F.transform(cells, trim)

    def grid(rows: Column) -> Column:
        rule = lambda row: line(F.transform(row, lambda _: F.lit("---")))
        each = F.transform(rows, lambda row, k: F.concat(line(inked(row)), F.when(k == 0, rule(row)).otherwise("")))
        return F.concat(F.array_join(each, ""), F.lit("\n"))

    def listed(items: Column, mark) -> Column:
        return F.concat(F.array_join(F.transform(items, lambda i, k: F.concat(mark(k), trim(F.get(i, F.lit(0))), F.lit("\n"))), ""), F.lit("\n"))

    def piece(block: Column) -> Column:
        tag, raw, href, cells = (block[c] for c in ("tag", "text", "href", "cells"))
        text, target = trim(raw), F.nullif(href, F.lit(""))
        return (
            F.when(tag == "#text", F.when(text == "", "").otherwise(F.concat(text, F.lit(" "))))
            .when(tag == "a", F.coalesce(F.concat(F.lit("["), text, F.lit("]("), target, F.lit(")")), text))
            .when(tag == "img", F.coalesce(F.concat(F.lit("!["), raw, F.lit("]("), target, F.lit(")\n\n")), F.lit("")))
            .when(tag == "li", "")
            .when(tag == "ul", listed(cells, lambda k: F.lit("- ")))
            .when(tag == "ol", listed(cells, lambda k: F.concat((k + 1).cast("string"), F.lit(". "))))
            .when(tag == "table", grid(cells))
            .otherwise(F.concat(F.coalesce(marks[0][tag], F.lit("")), text, F.coalesce(marks[1][tag], F.lit(""))))
        )

    return F.array_join(F.transform(F.arrays_zip(b["tag"], b["text"], b["href"], b["cells"]), piece), "")


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table(rows: Column) -> Column:
    """array<array<string>>: the first row is the header; rows are padded to the widest."""
    width = F.array_max(F.transform(rows, F.size))
    pads = F.zip_with(rows, F.array_repeat(width, F.size(rows)), lambda r, w: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r))))
    rule = lambda r: F.concat(F.lit("\n"), _row(F.transform(r, lambda _: F.lit("---"))))
    return F.array_join(F.transform(pads, lambda r, k: F.concat(_row(F.transform(r, escape_cell)), F.when(k == 0, rule(r)).otherwise(""))), "\n")


def workbook(sheets: Column) -> Column:
    """array<struct<name, rows>>: a heading for each sheet if there are several; sheets without rows are skipped."""
    head = lambda s: F.when(F.size(sheets) > 1, F.concat(F.lit("## "), s["name"], F.lit("\n\n"))).otherwise("")
    parts = F.transform(F.filter(sheets, lambda s: F.size(s["rows"]) > 0), lambda s: F.concat(head(s), table(s["rows"]), F.lit("\n\n")))
    return or_else(trim(F.array_join(parts, "")), F.lit(NO_SHEETS))


def pages(pages: Column) -> Column:
    """array<struct<n, items>>: blank items dropped, the rest joined by blanks; headings if there are several pages."""

    def written(pages: Column) -> Column:
        texts = F.transform(pages, lambda p: F.struct(p["n"].alias("n"), F.array_join(F.filter(p["items"], lambda i: ~is_blank(i)), " ").alias("text")))
        inked = F.filter(texts, lambda p: p["text"] != "")
        headed = F.transform(inked, lambda p: F.concat(F.lit("## Page "), p["n"].cast("string"), F.lit("\n\n"), p["text"], F.lit("\n\n")))
        return F.array_join(F.when(F.size(pages) > 1, headed).otherwise(inked["text"]), "")

    # in an array of one, so that the pages are made once, and not again for each page that asks for their number
    return or_else(trim(F.get(F.transform(F.array(pages), written), F.lit(0))), F.lit(NO_PAGES))


def deck(slides: Column) -> Column:
    """array<struct<name, texts>>: slides in the order of their names, each text a paragraph; empty ones only count."""
    texts = F.transform(F.array_sort(slides), lambda s, k: F.struct((k + 1).alias("n"), F.transform(F.filter(s["texts"], lambda t: ~is_blank(t)), trim).alias("texts")))
    parts = F.transform(F.filter(texts, lambda s: F.size(s["texts"]) > 0), lambda s: F.concat(F.lit("## Slide "), s["n"].cast("string"), F.lit("\n\n"), F.array_join(s["texts"], "\n\n"), F.lit("\n\n")))
    return or_else(trim(F.array_join(parts, "")), F.lit(NO_SLIDES))


def email(mail: Column) -> Column:
    """A struct of subject, sender_name, sender_email, sender_smtp, recipients (recip_type, email, name), submit_time, body_html, body."""
    get = lambda name: F.nullif(mail[name], F.lit(""))
    name, address, smtp = get("sender_name"), get("sender_email"), get("sender_smtp")
    sender = F.when(name.isNotNull(), F.concat(name, F.coalesce(F.concat(F.lit(" <"), address, F.lit(">")), F.lit("")))).otherwise(F.coalesce(smtp, address))

    def people(kind: str, label: str) -> Column:
        chosen = F.filter(F.coalesce(mail["recipients"], F.array()), lambda r: r["recip_type"] == kind)
        names = F.filter(F.transform(chosen, lambda r: F.coalesce(F.nullif(r["email"], F.lit("")), r["name"], F.lit(""))), lambda x: x != "")
        return F.when(F.size(names) > 0, F.concat(F.lit(f"**{label}:** "), F.array_join(names, "; ")))

    body = F.coalesce(get("body_html"), trim(F.replace(get("body"), F.lit("\r\n"), F.lit("\n"))))
    lines = F.concat_ws(
        "\n",
        F.lit("# Email Message"),
        F.when(get("subject").isNotNull(), F.concat(F.lit("\n**Subject:** "), get("subject"))),
        F.concat(F.lit("**From:** "), sender),
        people("to", "To"),
        people("cc", "Cc"),
        people("bcc", "Bcc"),
        F.concat(F.lit("**Date:** "), get("submit_time")),
        F.lit("\n## Content\n"),
        body,
    )
    return trim(F.regexp_replace(lines, "\n{3,}", "\n\n"))
