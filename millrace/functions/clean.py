"""Cleaning of extracted text, line by line, with array functions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_white, cut_at_word, let

# Terms that lead navigation lines, lines that are navigation or section titles, starts of
# footer lines, and parts of error messages of client-side applications.
LEADING = (
    "Anasayfa", "Hakkımızda", "Bize Ulaşın", "İletişim", "Yasal Uyarı", "Kişisel Verilerin Korunması",
    "Aydınlatma Metni", "Çerez Politikası",
)
EXACT = (
    "anasayfa", "hakkımızda", "bize ulaşın", "iletişim", "yasal uyarı", "kişisel verilerin korunması",
    "aydınlatma metni", "çerez politikası", "çözümler", "teknolojilerimiz", "referanslarımız", "politikalarımız",
    "bilgi güvenliği politikası", "hizmet yönetim politikası", "iş sürekliliği politikası",
    "yapay zeka yönetim sistemi politikası",
)
FOOTERS = ("© ", "tüm hakları saklıdır", "bu sitedeki deneyiminizi çerezlere izin vererek")
CLIENT_ERRORS = ("application error:", "a client-side exception has occurred", "browser console for more information")

#: Lines shorter than this are kept once in a document.
SHORT = 80


def once_if_short(lines: Column) -> Column:
    """Lines without repeats, ignoring case, of the short ones; the first stays."""

    def first_places(lines: Column) -> Column:
        # sorted by key and place, so a repeat stands behind its first
        entry = lambda x, i: F.struct(F.when(F.char_length(x) < SHORT, F.upper(x)).alias("key"), i.alias("i"))
        places = F.sort_array(F.transform(lines, entry))
        kept = let(places, lambda p: F.filter(p, lambda e, j: F.coalesce(e["key"] != F.get(p, j - 1)["key"], F.lit(True))))
        return F.sort_array(F.transform(kept, lambda e: e["i"]))

    return let(lines, lambda x: F.transform(first_places(x), lambda i: F.get(x, i)))


def _is_boilerplate(low: Column, exact: Sequence[str], footers: Sequence[str]) -> Column:
    found = low.isin(*exact)
    for start in footers:
        found = found | low.startswith(start.strip().lower())
    for part in CLIENT_ERRORS:
        found = found | F.contains(low, F.lit(part))
    return found


def lines_of(text: Column, leading: Sequence[str] = (), exact: Sequence[str] = (), footers: Sequence[str] = ()) -> Column:
    """The clean lines of a text; tenants may add terms of their own."""
    terms = "|".join(re.escape(t) for t in (*LEADING, *leading))
    lead = rf"(?iu)^(?:(?:{terms})\s*)+"
    raw = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), "\n")
    stripped = F.transform(raw, lambda x: F.trim(F.regexp_replace(collapse_white(x), lead, "")))
    kept = F.filter(
        stripped,
        lambda x: (x != "") & ~let(F.lower(x), lambda low: _is_boilerplate(low, (*EXACT, *map(str.lower, exact)), (*FOOTERS, *footers))),
    )
    return once_if_short(kept)


def clean(text: Column) -> Column:
    return F.array_join(lines_of(text), "\n")


def clean_preview(text: Column, length: int = 220) -> Column:
    """Useful clean lines, of 24 characters or more, joined and cut at a word; all lines if none is useful."""
    useful = lambda lines: F.filter(lines, lambda x: F.char_length(x) >= 24)
    chosen = let(lines_of(text), lambda x: let(useful(x), lambda u: F.when(F.size(u) > 0, u).otherwise(x)))
    return cut_at_word(F.array_join(chosen, " "), min(max(length, 80), 500))
