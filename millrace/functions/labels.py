"""Names, kinds and modes derived from a few columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# File types with a parser, those fetched rather than rendered, kinds of sources, and content types.
PARSED = ("txt", "md", "html", "htm", "docx", "pptx", "epub", "rtf", "pdf")
SOURCE_TYPES = {"web_site": "web_site", "web_links": "web_links", "local_files": "local_files", "web sitesi": "web_site", "web bağlantıları": "web_links", "yerel dosyalar": "local_files"}
CONTENT_TYPES = (
    ("pdf", "pdf"), ("wordprocessingml", "docx"), ("presentationml", "pptx"), ("rtf", "rtf"), ("epub", "epub"),
    ("markdown", "md"), ("html", "html"), ("text/plain", "txt"),
)


def extension(path: Column) -> Column:
    """Lower-case extension of the last part of a path, empty if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def source_type(label: Column) -> Column:
    """The code of a source type or of its label; null for others."""
    low = F.lower(F.trim(label))
    found = F.lit(None).cast("string")
    for name, code in SOURCE_TYPES.items():
        found = F.when(low == name, code).otherwise(found)
    return found


def default_source_name(kind: Column, address: Column) -> Column:
    """A name by kind, for web sites the host."""
    return (
        F.when(kind == "local_files", "Yerel Dosyalar")
        .when(kind == "web_links", "Web Bağlantıları")
        .otherwise(F.coalesce(F.nullif(urls.host(address), F.lit("")), F.lit("Web Sitesi")))
    )


def safe_file_name(name: Column, fallback: str = "document") -> Column:
    """The last part of a path with characters that file systems refuse as underscores."""
    base = F.trim(F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1))
    return F.coalesce(F.nullif(F.regexp_replace(base, r'[\x00-\x1f<>:"|?*]', "_"), F.lit("")), F.lit(fallback))


def download_name(url: Column, content_type: Column, title: Column) -> Column:
    """The URL's file name if its type has a parser, else the title with an extension by content type."""
    name = F.regexp_extract(urls.path(url), r"([^/]*)$", 1)
    kind = F.when(extension(name).isin(*PARSED), extension(name)).otherwise("txt")
    for part, ext in reversed(CONTENT_TYPES):
        kind = F.when(F.contains(F.lower(content_type), F.lit(part)), ext).otherwise(kind)
    bare = F.trim(F.regexp_replace(F.regexp_replace(title, r'[\x00-\x1f<>:"/\\|?*]+', "-"), "^-+|-+$", ""))
    stem = F.coalesce(F.nullif(bare, F.lit("")), F.lit("web-document"))
    return F.when(extension(name).isin(*PARSED), name).otherwise(F.concat(stem, F.lit("."), kind))


def is_html(content_type: Column) -> Column:
    low = F.lower(F.coalesce(F.trim(content_type), F.lit("")))
    return (low == "") | F.contains(low, F.lit("html")) | F.contains(low, F.lit("xml"))


def is_utility(url: Column) -> Column:
    return F.lower(urls.path(url)).isin("/robots.txt", "/sitemap.xml")


def addition_mode(kind: Column) -> Column:
    return F.when(kind == "web_site", "automatic").otherwise("manual")


def open_mode(kind: Column) -> Column:
    return F.when(kind == "local_files", "document_viewer").otherwise("external")


def retry_seconds(attempt: Column, base: int = 5, most: int = 60) -> Column:
    """Delay before a retry, doubling up to ``most``; the caller adds jitter."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt))
