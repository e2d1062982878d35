"""Which converters take a document, in which order; compiled to one native expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.detect import MIME_TYPES, extension_matches, mimetype_matches

SPECIFIC, GENERIC = 0.0, 10.0
UNSUPPORTED = "Could not convert file to Markdown. No converter supports this file type."


@dataclass(frozen=True)
class Converter:
    """`read` turns bytes into fields of a parsed document (see `convert.PARSED`); it runs inside tasks."""

    name: str
    extensions: tuple[str, ...]
    mime_prefixes: tuple[str, ...]
    read: Callable[..., dict] | None = None
    charset: bool = False  # whether `read` also takes the declared charset

    def accepts(self, ext: Column, mime: Column) -> Column:
        by_mime = [mimetype_matches(mime, p) for p in self.mime_prefixes]
        out = extension_matches(ext, list(self.extensions))
        for m in by_mime:
            out = out | m
        return F.coalesce(out, F.lit(False))


@dataclass
class Registry:
    """Converters with priorities: lower ones first, and of equal ones the one registered last."""

    entries: list[tuple[Converter, float]] = field(default_factory=list)

    def register(self, converter: Converter, priority: float = SPECIFIC) -> Registry:
        self.entries.insert(0, (converter, priority))
        return self

    def names(self) -> list[str]:
        """In the order in which lookups see them before sorting by priority: the last registered first."""
        return [c.name for c, _ in self.entries]

    def ordered(self) -> list[Converter]:
        return [c for c, _ in sorted(self.entries, key=lambda e: e[1])]

    def accepts(self, ext: Column, mime: Column) -> Column:
        """Whether any converter accepts; without a lambda, so Spark folds it where names are constants."""
        return reduce(Column.__or__, (c.accepts(ext, mime) for c in self.ordered()), F.lit(False))

    def candidates(self, ext: Column, mime: Column) -> Column:
        """array<string>: names of the converters that accept, in the order in which they are tried."""
        each = [F.when(c.accepts(ext, mime), F.lit(c.name)) for c in self.ordered()]
        none = F.array().cast("array<string>")
        return F.filter(F.array(*each), lambda n: n.isNotNull()) if each else none


def all_failed(attempts: Column) -> Column:
    """The message for array<struct<converter, error>>."""
    return F.concat(F.lit("All converters failed: "), F.array_join(F.transform(attempts, lambda a: F.concat(a["converter"], F.lit(": "), a["error"])), "; "))


def _read_html(content: bytes, charset: str | None = None) -> dict:
    from docloom.sources import html

    text = html.decoded(content, charset)
    return {"blocks": html.blocks(text), "html": text}


def _read_workbook(content: bytes) -> dict:
    """By the first bytes: a compound file, an archive, or a text with delimiters or tables of HTML."""
    from docloom.sources import delimited, office, xls

    if content[:4] == b"\xd0\xcf\x11\xe0":
        return {"sheets": xls.sheets(content)}
    found = None if content[:2] == b"PK" else delimited.sheets(content)
    return {"sheets": office.sheets(content) if found is None else found}


def builtins() -> Registry:
    from docloom.sources import html, mail, office, pdf

    r = Registry()
    r.register(Converter("OutlookMsgConverter", (".msg",), (MIME_TYPES[".msg"],), lambda b: {"mail": mail.message(b)}))
    r.register(Converter("PptxConverter", (".pptx",), (MIME_TYPES[".pptx"],), lambda b: {"slides": office.slides(b)}))
    r.register(Converter("XlsxConverter", (".xlsx", ".xls"), (MIME_TYPES[".xlsx"], MIME_TYPES[".xls"]), _read_workbook))
    r.register(Converter("PdfConverter", (".pdf",), (MIME_TYPES[".pdf"],), lambda b: {"pages": pdf.pages(b)}))
    r.register(Converter("DocxConverter", (".docx",), (MIME_TYPES[".docx"],), lambda b: {"blocks": html.blocks(office.docx_html(b), strip=False)}))
    r.register(Converter("HtmlConverter", (".html", ".htm"), ("text/html", "application/xhtml"), _read_html, charset=True), GENERIC)
    return r
