"""URL functions as column expressions."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PARTS = r"^(?i)(https?)://([^/?#]*)([^?#]*)"

# Extensions of files that no crawl follows.
STATIC = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".css", ".js", ".ico", ".xml", ".pdf", ".zip", ".mp4", ".webm")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), _PARTS, 1))


def host(url: Column) -> Column:
    """Host in lower case, without user, port and ``www.``; empty if the URL isn't http or https."""
    authority = F.lower(F.regexp_replace(F.regexp_extract(F.trim(url), _PARTS, 2), "^.*@", ""))
    return F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"^www\.", "")


def _port(url: Column) -> Column:
    port = F.regexp_extract(F.regexp_extract(F.trim(url), _PARTS, 2), r":(\d+)$", 1)
    default = F.when(scheme(url) == "https", "443").otherwise("80")
    return F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port))


def path(url: Column) -> Column:
    raw = F.regexp_extract(F.trim(url), _PARTS, 3)
    return F.regexp_replace(F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), "/{2,}", "/"), "/$", "")


def canonical(url: Column, with_path: bool = True) -> Column:
    """Lower-case scheme and host without ``www.``, default port, query, fragment or closing slash.

    Texts that are no http or https URL come back trimmed.
    """
    root = F.concat(scheme(url), F.lit("://"), host(url), _port(url))
    whole = F.concat(root, path(url)) if with_path else root
    return F.when(host(url) == "", F.trim(url)).otherwise(whole)


def key_of(url: Column) -> Column:
    """What stands for a URL in the store: canonical, without case."""
    return F.lower(canonical(url))


def is_allowed_host(url_host: Column, site_host: Column, subdomains: bool = True) -> Column:
    same = url_host == site_host
    return same | url_host.endswith(F.concat(F.lit("."), site_host)) if subdomains else same


def title_of(url: Column) -> Column:
    """Last path segment with ``-`` and ``_`` as spaces, decoded; else the host."""
    last = F.trim(F.element_at(F.split(path(url), "/"), -1))
    words = F.replace(F.translate(last, "-_", "  "), F.lit("+"), F.lit("%2B"))
    return F.when(last == "", host(url)).otherwise(F.trim(F.coalesce(F.try_url_decode(words), words)))


def topic_of(url: Column) -> Column:
    """Last path segment as words, the first letter of each in upper case."""
    parts = F.filter(F.split(F.element_at(F.split(path(url), "/"), -1), "-"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))), " ")


def resolve(link: Column, base: Column, site: Column) -> Column:
    """Links as the crawl follows them, null for those it doesn't: see `follow`."""

    @F.pandas_udf(StringType())
    def run(links: pd.Series, bases: pd.Series, sites: pd.Series) -> pd.Series:
        return pd.Series([follow(*x) for x in zip(links, bases, sites, strict=True)], dtype=object)

    return run(link, base, site)


def follow(link: str | None, base: str, site: str) -> str | None:
    """``link`` made absolute: https pages of the site or its subdomains, without port, query and fragment."""
    link = (link or "").strip()
    if not link or link.startswith("#") or link.lower().startswith(("mailto:", "tel:", "data:", "javascript:")):
        return None
    try:
        at = urlsplit(urljoin(base, link))
        found = (at.hostname or "").removeprefix("www.")
        root = (urlsplit(site).hostname or "").removeprefix("www.")
    except ValueError:
        return None
    if at.scheme != "https" or not (found == root or found.endswith("." + root)):
        return None
    clean = at.path.replace("\\", "/")
    while "//" in clean:
        clean = clean.replace("//", "/")
    clean = clean.rstrip("/") or "/"
    if posixpath.splitext(clean)[1].lower() in STATIC:
        return None
    return unquote(f"https://{found}{clean}")
