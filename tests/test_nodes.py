"""Nodes and links of HTML against the standard library's parser."""

import html
import re
from html.parser import HTMLParser

import pytest
import regex
from pyspark.sql import functions as F

from millrace.operators import links, nodes

from .test_links import plain

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SF = "/root/testdata/sf0.001"
HARD = [
    None, "", "plain a@b.com", "<p>one<p>two a@b.com<b>x</p>y</b></i>", "<a>x@y.com <b>z@y.com</b></a> w@y.com", "<script>var x='<p>q@q.com</p>'</script>t@t.com",
    "<li><b>Adres:</b> Büyük Cad. No: 5 İstanbul, <i>kat</i></li>", "<li>Adres: <p>Büyük Cad. No: 5 İstanbul</p> Ofis: Plaza Sok. No: 7</li>",
    "<p>Adres: Uzun Mah. 1. Sok. No: 3, tel 0212 555 12 34</p>", "<li>Konum: <code>41.01, 28.97</code> 41.02, 28.98</li>", "<!-- a@b.com --><br>5 &lt; 6 &amp; c@d.com<img alt='e@f.com'>",
    "<ul><li>Adres:<li>Büyük Cad. No: 5</ul>", "<P>Adres: <A HREF='x'>Büyük Cad. No: 5</A></P>", "<p>" * 30 + "deep a@b.com", "<li>" + "x@y.com " * 50 + "</li>",
]


class Plain(HTMLParser):
    """Texts with the names of what they are in, and list items and paragraphs with the texts in them."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.texts, self.boxes, self.links, self.held, self.n_elements = [], [], [], [], "", 0

    def flush(self):
        if self.held:
            self.texts.append((html.unescape(self.held) if not any(n in ("script", "style") for n, _ in self.stack) else self.held, [b for _, b in self.stack], [n for n, _ in self.stack]))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.n_elements += 1
        if tag in ("li", "p") and self.stack and self.stack[-1][0] == tag:
            self.stack.pop()
        if tag in VOID:
            return
        box = (len(self.boxes), tag)
        self.boxes.append(box)
        if tag == "a":
            self.links.append([b for _, b in self.stack])
        self.stack.append((tag, box))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.held += data

    def handle_entityref(self, name):
        self.held += f"&{name};"

    def handle_charref(self, name):
        self.held += f"&#{name};"

    def handle_comment(self, data):
        self.flush()

    handle_decl = unknown_decl = handle_pi = handle_comment


def resolved(found):
    out = []
    for c in sorted(found, key=lambda c: (c[0], c[2], -c[1])):
        if not out or all(c[0] >= o[0] + o[1] or o[0] >= c[0] + c[1] for o in out):
            out.append(c)
    return out


def expected(markup):
    """(text, spans) of each text outside the skipped elements that gets links."""
    parser = Plain()
    parser.feed(markup or "")
    parser.close()
    parser.flush()
    free = [k for k, (_, _, names) in enumerate(parser.texts) if not set(names) & set(nodes.SKIPPED)]
    placed = {}
    for box in parser.boxes:
        if box[1] not in ("li", "p") or any(box in inside for inside in parser.links):
            continue
        mine = [k for k in free if box in parser.texts[k][1]]
        if any(k in placed for k in mine):
            continue
        whole = "".join(parser.texts[k][0] for k in mine)
        m = regex.search(links.PLACE, whole)
        if not m:
            continue
        seen = m[1].strip(" ").rstrip(".,;:!?)]")
        found = [c for c in plain(m[0]) if c[3] == "place"]
        at = m.start(1)
        for k in mine:
            n = len(parser.texts[k][0])
            if 0 <= at and at + len(seen) <= n and found:
                placed[k] = (at, len(seen), 40, "place", seen, found[0][5])
                break
            at -= n
    out = []
    for k in free:
        text = parser.texts[k][0]
        if k in placed:
            s = placed[k]
            end = s[0] + s[1]
            spans = resolved(plain(text[: s[0]])) + [s] + [(c[0] + end, *c[1:]) for c in resolved(plain(text[end:]))]
        else:
            spans = resolved(plain(text))
        if spans:
            out.append((text, [tuple(s) for s in spans]))
    return out, len(parser.texts), parser.n_elements


@pytest.fixture(scope="module")
def tables(spark):
    hard = spark.createDataFrame(list(enumerate(HARD)), "key long, html string")
    return hard, nodes._keyed(spark, SF)


def test_links_equal_a_plain_parser(spark, tables):
    for table in tables:
        rows = dict(table.collect())
        found = nodes.nodes(table).cache()
        got = {}
        for r in nodes.linked_texts(found).collect():
            got.setdefault(r.key, []).append((r.left, r.text, [tuple(s) for s in r.spans]))
        sizes = found.groupBy("key").agg(F.count_if(F.col("name").isNull()).alias("texts"), F.count("name").alias("elements"))
        counts = {r.key: (r.texts, r.elements) for r in sizes.collect()}
        for key, markup in rows.items():
            want, texts, elements = expected(markup)
            assert [x[1:] for x in sorted(got.get(key, []))] == want, markup[:200]
            assert counts.get(key, (0, 0)) == (texts, elements)


def test_markup_is_spliced(spark, tables):
    hard, pages = tables
    for table in (hard, pages):
        for r in nodes.linked_html(table).collect():
            want, _, _ = expected(r.html)
            assert r.links == sum(len(s) for _, s in want)
            if not r.links:
                assert r.linked == r.html
                continue
            # without the new anchors the text is what it was
            strip = lambda m: html.unescape(re.sub(r'<a href="(?:mailto|tel|sms|https?):[^"]*">((?:(?!<).)*)</a>', r"\1", m))
            assert strip(r.linked) == strip(r.html)
            again, _, _ = expected(r.linked)
            assert not [s for _, spans in again for s in spans if s[3] in ("email", "link")]


def test_intervals_nest():
    for markup in HARD:
        found = nodes.intervals(markup or "")
        numbers = [x for n in found for x in n[:2]]
        assert sorted(numbers) == list(range(len(numbers)))
        for a in found:
            for b in found:
                assert a[1] < b[0] or b[1] < a[0] or (a[0] <= b[0] and b[1] <= a[1]) or (b[0] <= a[0] and a[1] <= b[1])
