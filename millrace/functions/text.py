"""Text functions as column expressions; one Arrow UDF where no built-in is exact.

Lengths are code points. Null in, null out, unless said otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The letter that is searched as another without having a mark.
DOTLESS = ("ı", "i")
#: The first character that decomposes into several without their marks, and all after it.
_FROM_SEVERAL = r"[\x{9CB}-\x{10FFFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


#: Entries that `sums_before` adds up at once.
_BLOCK = 64


def sums_before(values: Column) -> Column:
    """For each entry of an array of integers the sum of those before it, by blocks: no sum is made of all entries again."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    in_block = lambda k: F.floor(k / F.lit(_BLOCK)).cast("int")

    def within(before: Column) -> Column:
        return F.transform(values, lambda _, i: F.get(before, in_block(i)) + total(F.slice(values, in_block(i) * _BLOCK + 1, i % _BLOCK)))

    blocks = F.transform(F.sequence(F.lit(0), in_block(F.size(values))), lambda b: total(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))))
    sums = F.aggregate(blocks, F.array(F.lit(0)), lambda out, b: F.concat(out, F.array(F.element_at(out, -1) + b)))
    return let(sums, within)


def collapse_spaces(text: Column) -> Column:
    """Line ends are spaces, runs of spaces one; tabs and other white space stay."""
    return F.trim(F.regexp_replace(F.translate(text, "\r\n", "  "), " +", " "))


def collapse_white(text: Column) -> Column:
    """Runs of any Unicode white space are one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def collapse_lines(text: Column) -> Column:
    """As `collapse_white` in each line; blank lines go, line ends stay."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), collapse_white)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def cut(text: Column, length: int) -> Column:
    """Texts over ``length`` end in three dots."""
    return let(
        text,
        lambda t: F.when(F.char_length(t) <= length, t).otherwise(
            F.concat(F.rtrim(F.substring(t, 1, length)), F.lit("..."))
        ),
    )


def preview(content: Column, title: Column, fallback: str, length: int = 260) -> Column:
    """The content collapsed and cut; the title, or a fixed text, where there is none."""
    named = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit(fallback))
    collapsed = collapse_spaces(F.coalesce(content, F.lit("")))
    return cut(let(collapsed, lambda t: F.when(t != "", t).otherwise(named)), length)


def cut_at_word(text: Column, length: int, least: int = 80) -> Column:
    """Cut at the last space up to ``length``, or at ``length`` if that leaves under ``least``."""

    def shorten(t: Column) -> Column:
        head = F.substring(t, 1, length + 1)
        place = F.locate(" ", F.reverse(head))
        at = F.char_length(head) - place
        at = F.when((place == 0) | (at < least), F.lit(length)).otherwise(at)
        return F.when(F.char_length(t) <= length, t).otherwise(
            F.concat(F.rtrim(F.substring(t, F.lit(1), at)), F.lit("..."))
        )

    return let(text, shorten)


def sha256(text: Column, upper: bool = False) -> Column:
    digest = F.sha2(text, 256)
    return F.upper(digest) if upper else digest


def guid_of(text: Column) -> Column:
    """A guid from the first 16 bytes of a text's SHA-256; its first three groups are little-endian."""
    d = F.sha2(text, 256)
    byte = lambda i: F.substring(d, 2 * i + 1, 2)
    return F.concat_ws(
        "-",
        F.concat(*map(byte, (3, 2, 1, 0))),
        F.concat(*map(byte, (5, 4))),
        F.concat(*map(byte, (7, 6))),
        F.substring(d, 17, 4),
        F.substring(d, 21, 12),
    )


@cache
def _marks() -> dict[int, None]:
    """All non-spacing marks, for str.translate."""
    return {c: None for c in range(0x300, 0x110000) if unicodedata.category(chr(c)) == "Mn"}


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    """Canonical decomposition without non-spacing marks: no built-in does this."""
    marks = _marks()
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFD", t).translate(marks))


@cache
def _folds() -> tuple[str, str, str]:
    """Characters that are one other without its marks, these others, and a pattern of those that decompose into several.

    Marks by themselves are at the end of the first, without a counterpart.
    """
    one, other, several = [], [], []
    for c in map(chr, range(0xC0, 0x2FA20)):
        if unicodedata.category(c) in ("Mn", "Cs") or (whole := unicodedata.normalize("NFD", c)) == c:
            continue
        left = [x for x in whole if unicodedata.category(x) != "Mn"]
        if len(left) == 1:
            one.append(c)
            other.append(left[0])
        else:
            several.append(ord(c))
    starts = [c for k, c in enumerate(several) if not k or several[k - 1] != c - 1]
    ends = [c for k, c in enumerate(several) if k + 1 == len(several) or several[k + 1] != c + 1]
    pattern = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"
    return "".join(one) + "".join(map(chr, _marks())), "".join(other), pattern


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def strip_marks(text: Column) -> Column:
    """``text`` decomposed, without non-spacing marks; only texts with characters that decompose into several leave the JVM."""
    one, other, several = _folds()
    return F.coalesce(_decomposed(F.when(_any_several(text, several), text)), F.translate(text, one, other))


def _any_several(text: Column, several: str) -> Column:
    """Whether a character of ``text`` decomposes into several: the pattern is searched only where one is as high as the first of them."""
    return ~is_ascii(text) & text.rlike(_FROM_SEVERAL) & text.rlike(several)


def search_text(text: Column) -> Column:
    """Letters and digits only, lower case, without marks, parted by single spaces.

    ASCII is only put in lower case. Elsewhere one table takes marks and the
    dotless i: the other Turkish letters are those without their marks, and no
    character that decomposes into several has a case.
    """
    one, other, several = _folds()
    lower = F.lower(text)
    rare = F.translate(_decomposed(F.when(_any_several(text, several), lower)), *DOTLESS)
    folded = F.when(is_ascii(text), lower).otherwise(F.coalesce(rare, F.translate(lower, DOTLESS[0] + one, DOTLESS[1] + other)))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{Nd}]+", " "))


def search_terms(text: Column) -> Column:
    """Distinct search words of three letters or more, or all digits."""
    words = F.array_distinct(F.split(search_text(text), " "))
    return F.filter(words, lambda w: (F.char_length(w) >= 3) | w.rlike(r"^\p{Nd}+$"))


def citation_text(text: Column) -> Column:
    """Letters, digits and single spaces of a label."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{Nd}\s]", ""), r"(?U)\s+", " "))


def normalize_question(text: Column) -> Column:
    """A question without Markdown, ending in a question mark."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1"), "[*_~]", "")
    bare = F.btrim(F.regexp_replace(plain, r"(?U)\s+", " "), F.lit(" \"'`-*."))
    return F.when((bare == "") | bare.endswith("?"), bare).otherwise(F.concat(bare, F.lit("?")))


def relative_path(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` parts, with slashes."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda p: ~F.trim(p).isin("", ".", "..")), "/")


def folder_path(path: Column) -> Column:
    """The folder of a relative path, ``/`` at the top."""
    parts = F.split(relative_path(path), "/")
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))


def refresh_minutes(period: Column) -> Column:
    """Minutes of a period such as ``2 hours``; null where it isn't valid."""
    pattern = r"(?i)^\s*(\d+)\s*(minute|hour|day|week)s?\s*$"
    count = F.try_to_number(F.nullif(F.regexp_extract(period, pattern, 1), F.lit("")), F.lit("999999999")).cast("int")
    unit = F.lower(F.regexp_extract(period, pattern, 2))
    most, size = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, limit, minutes in (("minute", 60, 1), ("hour", 24, 60), ("day", 4, 1440), ("week", 4, 10080)):
        most = F.when(unit == name, limit).otherwise(most)
        size = F.when(unit == name, minutes).otherwise(size)
    return F.when((count >= 1) & (count <= most), count * size)


def minutes_as_unit(minutes: Column) -> Column:
    """value and unit of a period: the largest unit that divides it, else minutes from 1 to 60."""
    found = F.struct(F.least(F.greatest(minutes, F.lit(1)), F.lit(60)).alias("value"), F.lit("minute").alias("unit"))
    for name, limit, size in (("hour", 24, 60), ("day", 4, 1440), ("week", 4, 10080)):
        value = F.floor(minutes / size).cast("int")
        fits = (minutes % size == 0) & (value >= 1) & (value <= limit)
        found = F.when(fits, F.struct(value.alias("value"), F.lit(name).alias("unit"))).otherwise(found)
    return found
