"""Actions in answers: e-mail addresses, links, places and phone numbers found in text, and made Markdown links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, sums_before
from .answers import _answers, phone
from .edits import without_overlaps

# Shapes of contact details and the words near them. A word character is a letter, mark, digit or connector.
W = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
DOT = rf"\s*(?:\[dot\]|\(dot\)|(?<!{W})dot(?!{W}))\s*"
HIDDEN = rf"(?i)([A-Z0-9._%+-]+)\s*(?:\[at\]|\(at\)|(?<!{W})at(?!{W}))\s*([A-Z0-9-]+(?:{DOT}[A-Z0-9-]+)*){DOT}([A-Z]{{2,}})"
EMAIL = rf"(?i)(?<!{W}|[.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}(?!{W}|[.-])"
TOP = "com\\.tr|org\\.tr|net\\.tr|gov\\.tr|edu\\.tr|com|net|org|io|ai|co|biz|info|tr"
LINK = rf"(?i)(?<!@|{W})(?:(?:https?://|www\.)[^\s<>()]+|(?:[A-Z0-9](?:[A-Z0-9-]{{0,61}}[A-Z0-9])?\.)+(?:{TOP})(?:/[^\s<>()]*)?)"
PLACE = r"(?iu)(?<![\p{L}\p{N}])(?:Adres|Konum|Lokasyon|Ofis|Merkez|Şube|Sube|Yerleşke|Yerleske)(?:\s*\([^)]+\))?\s*:\s*([^\r\n<]{8,220})"
POINT = r"(?<!\p{Nd})-?(?:[0-8]?\p{Nd}(?:\.\p{Nd}+)?|90(?:\.0+)?)\s*,\s*-?(?:1[0-7]\p{Nd}(?:\.\p{Nd}+)?|[0-9]?\p{Nd}(?:\.\p{Nd}+)?|180(?:\.0+)?)(?!\p{Nd})"
PHONE = rf"(?<!{W})(?:\+?\d{{1,3}}[\s.-]?)?(?:\(?0?\d{{3}}\)?[\s.-]?\d{{3}}[\s.-]?\d{{2}}[\s.-]?\d{{2}}|444[\s.-]?\d[\s.-]?\d{{3}})(?!{W})"
ADDRESS_WORD = rf"(?iu)(?<!{W})(?:Mah\.?|Mahallesi|Cad\.?|Caddesi|Sok\.?|Sokağı|Sk\.?|Bulvar|Blv\.?|No\s*:|Kat\s*:|İstanbul|Istanbul|Ankara|İzmir|Izmir|Türkiye|Turkey|Plaza|Blok|Daire)(?!{W})"
PHONE_WORD = rf"(?iu)(?<!{W})(?:Telefon|Tel|GSM|Mobil|Cep|Çağrı|Cagri|Faks|Fax|WhatsApp|SMS|Mesaj)(?!{W})"
WHATSAPP_WORD = rf"(?i)(?<!{W})WhatsApp(?!{W})"
SMS_WORD = rf"(?i)(?<!{W})(?:SMS|Mesaj)(?!{W})"
MAP = "https://www.google.com/maps/search/?api=1&query="
#: Letters before a number, and in all, where words about it are looked for.
BEFORE, NEAR = 40, 96
#: Markdown that is left as it is: code and links.
TAKEN = r"(?s)```.*?```|`[^`\n]*`|!?\[[^\]\n]*\]\([^)\n]*\)"

SPAN = "struct<start: int, length: int, priority: int, kind: string, visible: string, href: string>"


def map_url(place: Column) -> Column:
    """A map search for the place, percent-encoded."""
    form = F.url_encode(place)
    return F.concat(F.lit(MAP), F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def _bare(value: Column) -> Column:
    """Without punctuation that ends a sentence."""
    return F.rtrim(F.trim(value), F.lit(".,;:!?)]"))


def _matches(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """start (from 0) and value of every match: what stands between the matches tells where they are.

    ``needs``: what holds for every text with a match; others aren't searched.
    A text is taken apart only if it has a match, as Spark compiles the pattern for that anew each time.
    """

    def placed(found: Column) -> Column:
        pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value")), lambda p: p["value"].isNotNull())
        sizes = F.transform(pairs, lambda p: F.char_length(p["gap"]) + F.char_length(p["value"]))
        at = lambda before: F.transform(
            pairs, lambda p, i: F.struct((F.get(before, i) + F.char_length(p["gap"])).alias("start"), p["value"].alias("value"))
        )
        return let(sums_before(sizes), at)

    none = F.array().cast("array<struct<start: int, value: string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs is not None:
        found = F.when(needs, found).otherwise(F.array().cast("array<string>"))
    return let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none))


def candidates(text: Column) -> Column:
    """All spans of ``text`` that may be linked: start, length, priority, kind, visible text and target.

    Null text has none. A labelled place needs a word of addresses or a pair of
    coordinates; a number a word about phones near it, or a sign of dialling
    within. Positions are code points from 0.
    """
    return let(F.coalesce(text, F.lit("")), _candidates)


def _candidates(text: Column) -> Column:
    def spans(pattern: str, kind: str, priority: int, visible, href, keep=None, needs=None) -> Column:
        def one(m: Column) -> Column:
            seen = visible(m["value"])
            start = m["start"] if kind != "place" else m["start"] + F.char_length(m["value"]) - F.char_length(F.regexp_extract(m["value"], PLACE, 1))
            return F.struct(
                start.alias("start"), F.char_length(seen).alias("length"), F.lit(priority).alias("priority"),
                F.lit(kind).alias("kind"), seen.alias("visible"), href(m, seen).alias("href"),
            ).cast(SPAN)

        found = F.filter(F.transform(_matches(text, pattern, needs), one), lambda s: s["length"] > 0)
        return F.filter(found, keep) if keep else found

    same = lambda v: v
    mail = lambda to: F.concat(F.lit("mailto:"), to)
    hidden = lambda v: F.concat(
        F.regexp_extract(v, HIDDEN, 1), F.lit("@"),
        F.replace(F.regexp_replace(F.regexp_extract(v, HIDDEN, 2), "(?i)" + DOT, "."), F.lit(" "), F.lit("")), F.lit("."), F.regexp_extract(v, HIDDEN, 3),
    )

    def near(m: Column, word: str) -> Column:
        begin = F.greatest(F.lit(0), m["start"] - BEFORE)
        return F.substring(text, begin + 1, F.lit(NEAR)).rlike(word)

    def dial(m: Column, seen: Column) -> Column:
        to = phone(seen)
        signal = near(m, PHONE_WORD) | seen.rlike(r"[+() .-]")
        target = (
            F.when(near(m, WHATSAPP_WORD), F.concat(F.lit("https://wa.me/"), F.ltrim(to, F.lit("+"))))
            .when(near(m, SMS_WORD), F.concat(F.lit("sms:"), to))
            .otherwise(F.concat(F.lit("tel:"), to))
        )
        return F.when(signal, target)

    scheme = lambda m, v: F.when(v.rlike("(?i)^https?://"), v).otherwise(F.concat(F.lit("https://"), v))
    return F.concat(
        spans(HIDDEN, "email", 10, same, lambda m, v: mail(hidden(v)), needs=text.rlike("(?i)dot")),
        spans(EMAIL, "email", 20, same, lambda m, v: mail(v), needs=F.contains(text, F.lit("@"))),
        spans(LINK, "link", 30, _bare, scheme),
        spans(
            PLACE, "place", 40, lambda v: _bare(F.regexp_extract(v, PLACE, 1)), lambda m, v: map_url(v),
            lambda s: (s["length"] >= 8) & (s["visible"].rlike(ADDRESS_WORD) | s["visible"].rlike(POINT)),
            F.contains(text, F.lit(":")),
        ),
        spans(POINT, "point", 50, same, lambda m, v: map_url(v), needs=text.rlike(r"\p{Nd}\s*,")),
        spans(PHONE, "phone", 60, same, dial, lambda s: s["href"].isNotNull(), text.rlike(r"\d")),
    )


def actions(text: Column) -> Column:
    """The spans to link: of overlapping ones the first, by priority and then the longest; none in code or links.

    Code and links of the Markdown take part as spans without a target.
    """
    still = F.transform(
        _matches(F.coalesce(text, F.lit("")), TAKEN),
        lambda m: F.struct(
            m["start"].alias("start"), F.char_length(m["value"]).alias("length"), F.lit(0).alias("priority"),
            F.lit("taken").alias("kind"), m["value"].alias("visible"), F.lit(None).cast("string").alias("href"),
        ).cast(SPAN),
    )
    return F.filter(without_overlaps(F.concat(still, candidates(text)), SPAN), lambda s: s["href"].isNotNull())


def linked(text: Column, spans: Column) -> Column:
    """``text`` with its ``spans`` (ordered, apart) as Markdown links."""
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.concat(acc["out"], before, F.lit("["), s["visible"], F.lit("]("), s["href"], F.lit(")"))
        return F.struct((s["start"] + s["length"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, none, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))


def q_contact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an outer one, so that no filter on its size has the candidates made twice
    found = _answers(spark, sf_dir).select("answer_id", F.inline_outer(candidates(F.col("markdown"))))
    return found.where("start is not null")


def q_linked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _answers(spark, sf_dir).select("answer_id", "markdown", actions(F.col("markdown")).alias("spans"))
    return found.select("answer_id", F.size("spans").alias("links"), F.sha2(linked(F.col("markdown"), F.col("spans")), 256).alias("linked_hash"))


QUERIES = {"contact_candidates": q_contact_candidates, "linked_answers": q_linked_answers}
ORACLES: dict[str, str] = {}
