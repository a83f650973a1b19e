"""Contact details in answers against plain Python, and Markdown links made of them."""

import urllib.parse

import pytest
import regex
from pyspark.sql import functions as F

from millrace.operators import answers, links

HARD = [
    "Yaz: ali [at] ornek [dot] com, info@site.com.tr. veya veli (at) a dot b dot org!",
    "Bak www.site.com/x(y). ve site.com.tr/yol?a=1, https://s.io/a), x@y.com, sadece.kelime",
    "Adres: Büyük Cad. No: 5 İstanbul.\nKonum (merkez): 41.01, 28.97\nOfis: burada değil",
    "Tel 02125551234 ve 5551234567\n" + "x" * 60 + "\n2125551234 WhatsApp +90 532 111 22 33, " + "y" * 99 + " SMS: 0532 111 22 33",
    "[info@a.com](mailto:info@a.com) `b@c.com` d@e.com ```\nf@g.com\n``` 444 1 222",
    "a@b.co" * 3 + " çş@x.com ış.com 12, 13; -91, 20", "", " ", "a@b.com " * 400,
]


def plain(text):
    """The candidates of one text, by search with positions."""
    bare = lambda v: v.strip(" ").rstrip(".,;:!?)]")
    place = lambda v: links.MAP + urllib.parse.quote(v, safe="~")
    out = []
    for m in regex.finditer(links.HIDDEN, text):
        domain = regex.sub("(?i)" + links.DOT, ".", m[2]).replace(" ", "")
        out.append((m.start(), len(m[0]), 10, "email", m[0], f"mailto:{m[1]}@{domain}.{m[3]}"))
    out += [(m.start(), len(m[0]), 20, "email", m[0], "mailto:" + m[0]) for m in regex.finditer(links.EMAIL, text)]
    for m in regex.finditer(links.LINK, text):
        v = bare(m[0])
        out.append((m.start(), len(v), 30, "link", v, v if regex.match("(?i)https?://", v) else "https://" + v))
    for m in regex.finditer(links.PLACE, text):
        v = bare(m[1])
        if len(v) >= 8 and (regex.search(links.ADDRESS_WORD, v) or regex.search(links.POINT, v)):
            out.append((m.start(1), len(v), 40, "place", v, place(v)))
    out += [(m.start(), len(m[0]), 50, "point", m[0], place(m[0])) for m in regex.finditer(links.POINT, text)]
    for m in regex.finditer(links.PHONE, text):
        begin = max(0, m.start() - links.BEFORE)
        window, digits = text[begin : begin + links.NEAR], regex.sub(r"\D", "", m[0])
        if not 7 <= len(digits) <= 15 or not (regex.search(links.PHONE_WORD, window) or regex.search("[+() .-]", m[0])):
            continue
        if digits.startswith("00"):
            to = "+" + digits[2:]
        elif "+" in m[0]:
            to = "+" + digits
        elif digits[0] == "0" and len(digits) == 11:
            to = "+90" + digits[1:]
        elif len(digits) == 10 and digits[0] in "23458":
            to = "+90" + digits
        elif digits.startswith("90") and len(digits) == 12:
            to = "+" + digits
        else:
            to = digits
        if regex.search(links.WHATSAPP_WORD, window):
            href = "https://wa.me/" + to.lstrip("+")
        else:
            href = ("sms:" if regex.search(links.SMS_WORD, window) else "tel:") + to
        out.append((m.start(), len(m[0]), 60, "phone", m[0], href))
    return out


def test_candidates_are_those_of_a_plain_search(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(99, None)], "id long, text string")
    got = {r.id: [tuple(s) for s in r.found] for r in texts.select("id", links.candidates(F.col("text")).alias("found")).collect()}
    assert got.pop(99) == []
    for i, t in enumerate(HARD):
        assert got[i] == plain(t), t
    kinds = {s[3] for found in got.values() for s in found}
    assert kinds == {"email", "link", "place", "point", "phone"}


def test_candidates_of_the_whole_table(spark):
    found = answers._answers(spark, "/root/testdata/sf0.001").select("markdown", links.candidates(F.col("markdown")).alias("found")).collect()
    assert found and all([tuple(s) for s in r.found] == plain(r.markdown) for r in found)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Yaz: info@a.com, olur. x@y.com.", "Yaz: [info@a.com](mailto:info@a.com), olur. x@y.com."),  # none that a full stop follows
        ("[x@a.com](mailto:x@a.com) `y@a.com`", "[x@a.com](mailto:x@a.com) `y@a.com`"),
        ("Adres: Ata Cad. 5 www.a.com", f"Adres: [Ata Cad. 5 www.a.com]({links.MAP}Ata%20Cad.%205%20www.a.com)"),
        ("Tel: 0212 555 12 34, www.a.com", "Tel: [0212 555 12 34](tel:+902125551234), [www.a.com](https://www.a.com)"),
        ("", ""),
    ],
)
def test_linked(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string")
    assert row.select(links.linked(F.col("t"), links.actions(F.col("t")))).first()[0] == want
