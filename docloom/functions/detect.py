"""File types from names and declared types; contents are never looked at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import or_else

OFFICE = "application/vnd.openxmlformats-officedocument."
# Extension to MIME type.
MIME_TYPES = {
    ".html": "text/html",
    ".htm": "text/html",
    ".docx": OFFICE + "wordprocessingml.document",
    ".xlsx": OFFICE + "spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
    ".pptx": OFFICE + "presentationml.presentation",
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".json": "application/json",
    ".xml": "application/xml",
    ".msg": "application/vnd.ms-outlook",
}


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(filename: Column) -> Column:
    """From the last dot on, lower case, with the dot; empty without one."""
    return F.lower(F.regexp_extract(filename, r"(\.[^.]*)\z", 1))


def mimetype(filename: Column, declared: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return or_else(declared, F.coalesce(F.try_element_at(known, extension(filename)), F.lit("application/octet-stream")))


def mimetype_matches(mime: Column, prefix: str) -> Column:
    return F.lower(mime).startswith(prefix.lower())


def extension_matches(ext: Column, extensions: list[str]) -> Column:
    return F.lower(ext).isin([e.lower() for e in extensions])


def output_name(filename: Column) -> Column:
    """The name without its last extension, and .md."""
    return F.concat(F.regexp_replace(filename, r"\.[^/.]+\z", ""), F.lit(".md"))
