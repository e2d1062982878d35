"""Workbooks that are texts: delimited lines, and tables of HTML, under the name of a workbook."""

from __future__ import annotations

import csv
import io
import re

from docloom.functions.text import WS_CHARS
from docloom.sources.office import MAX_CELLS, number_text

DELIMITERS = ",;\t|"
csv.field_size_limit(1 << 29)
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def text_of(content: bytes) -> str | None:
    """The text in UTF-8, UTF-16 with a mark, or else windows-1252; None for what isn't text."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    if re.search(rb"[\x00-\x08\x0e-\x1a\x1c-\x1f]", content):
        return None
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def delimiter(text: str) -> str | None:
    """The delimiter that the first line has most often outside of quotes, of equal ones the first; None without any."""
    first = re.sub(r'"[^"]*"', "", text.lstrip("\r\n")).partition("\n")[0]
    best = max(DELIMITERS, key=first.count)
    return best if first.count(best) else None


def _cell(text: str) -> str:
    """Zero and false are empty, as in other workbooks, and numbers are written as they are there."""
    if _NUMBER.fullmatch(text.strip()):
        x = float(text)
        return number_text(x) if x and abs(x) != float("inf") else "" if not x else text
    return {"TRUE": "true", "FALSE": ""}.get(text.strip().upper(), text)


def sheets(content: bytes) -> list[dict] | None:
    """(name, rows) as `office.sheets`: a sheet a table of HTML, or one of delimited lines; None for what is neither.

    A single line without a delimiter is neither. A table in another's cell is part of that cell.
    """
    text = text_of(content)
    if text is None:
        return None
    if re.match(r"\s*<(?:!doctype|html|head|body|table|meta|\?xml|!--|style|div)", text, re.I):
        return _tables(text)
    mark = delimiter(text)
    if mark is None and "\n" not in text.strip():
        return None
    rows, n = [], 0
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=mark or ","):
        n += len(row)
        if n > MAX_CELLS:
            raise ValueError(f"Sheet Sheet1 spans more than {MAX_CELLS} cells")
        rows.append([_cell(c) for c in row])
    while rows and not any(rows[-1]):
        rows.pop()
    return [{"name": "Sheet1", "rows": rows}]


def _tables(text: str) -> list[dict]:
    from docloom.sources import html

    out, stack = [], [html.parse(text)]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            continue
        if n.tag != "table":
            stack.extend(reversed(n.children))
            continue
        rows = []
        for row in n.find({"tr"}):
            cells: list[str] = []
            for c in row.find({"td", "th"}):
                span = c.attrs.get("colspan", "1")
                cells += [_cell(re.sub(r"\s+", " ", c.text()).strip(WS_CHARS)), *[""] * (min(int(span), 1000) - 1 if span.isdigit() else 0)]
            rows.append(cells)
        out.append({"name": f"Sheet{len(out) + 1}", "rows": rows})
    if not out:
        raise ValueError("Invalid HTML: could not find <table>")
    return out
