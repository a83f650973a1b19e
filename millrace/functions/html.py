"""HTML to text, titles and links.

Patterns are native; what needs entities or a parse runs in Arrow UDFs over the
standard library's parser, as no built-in does.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_white = re.compile(r"\s+")


class _Text(HTMLParser):
    def __init__(self, dropped: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.dropped, self.depth, self.parts = dropped, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.dropped:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in self.dropped and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


# Elements whose text is no content, on pages and in uploaded files.
PAGE_DROPS = frozenset({"script", "style"})
FILE_DROPS = frozenset({"script", "style", "noscript", "svg", "nav", "header", "footer"})


def text_of(markup: str | None, dropped: frozenset[str] = PAGE_DROPS) -> str:
    """Inner text with entities decoded and white space, line ends included, collapsed."""
    parser = _Text(dropped)
    parser.feed(markup or "")
    parser.close()
    return _white.sub(" ", "".join(parser.parts)).strip()


#: Texts that are held as Python's at once.
_AT_ONCE = 256


def _each(texts: pa.Array, one: Callable[[str | None], str | None]) -> pa.Array:
    """``one`` of each text: a batch stays in Arrow, and only a few of its texts are Python's at a time."""
    parts = [pa.array([one(t) for t in texts.slice(k, _AT_ONCE).to_pylist()], pa.string()) for k in range(0, len(texts), _AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def html_to_text(markup: pa.Array) -> pa.Array:
    return _each(markup, text_of)


@F.arrow_udf(StringType())
def decode_entities(text: pa.Array) -> pa.Array:
    return _each(text, lambda t: None if t is None else html.unescape(t))


def _clean(text: Column) -> Column:
    bare = decode_entities(F.regexp_replace(text, "<[^>]*>", ""))
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def title(markup: Column) -> Column:
    """The first heading's text, else that of the title element; null where there is neither."""
    heading = F.regexp_extract(markup, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1)
    named = F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1)
    # a heading without text of its own, as of an image, gives way to the title
    return F.coalesce(F.nullif(_clean(heading), F.lit("")), F.nullif(_clean(named), F.lit("")))


def links(markup: Column) -> Column:
    """Anchors, JSON hrefs and URLs, quoted paths and sitemap locations, in this order, repeats kept."""
    # What stands before and around a link.
    patterns = (
        r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']""",
        r'(?i)"(?:href|url)"\s*:\s*"([^"]+)"',
        r"""["'](/[A-Za-z0-9][^"'\s<>]*)["']""",
        r"(?i)<loc>\s*([^<\s]+)\s*</loc>",
    )
    found = F.concat(*[F.regexp_extract_all(markup, F.lit(p), F.lit(1)) for p in patterns])
    return F.filter(found, lambda x: F.trim(x) != "")
