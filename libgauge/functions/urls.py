"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import filled, path_suffix

# File extensions by content type.
EXTENSIONS = {
    "application/pdf": ".pdf",
    "text/html": ".html",
    "application/xhtml+xml": ".html",
    "text/plain": ".txt",
    "text/csv": ".csv",
    "application/csv": ".csv",
    "application/json": ".json",
    "application/xml": ".xml",
    "text/xml": ".xml",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/zip": ".zip",
}


def extension_map() -> Column:
    return F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit(""))


def is_web(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), F.lit(False))


def guess_extension(content_type: Column, url: Column) -> Column:
    """By content type, else the URL path's suffix, else .bin."""
    return F.coalesce(F.try_element_at(extension_map(), content_type), filled(F.lower(path_suffix(url_path(url)))), F.lit(".bin"))


def host(url: Column) -> Column:
    """The host in lower case, "" where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))
