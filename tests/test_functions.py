"""Unit vectors of functions and operators that the tables don't exercise."""

import hashlib
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import clean, html, text, urls
from millrace.operators import answers, questions, store
from millrace.sources import files


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'long' if isinstance(v, int) else 'string'}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([values], schema).select(column(*map(F.col, names)).alias("r")).first().r


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (text.collapse_spaces, " a\r\n b\tc  d ", "a b\tc d"),
        (text.collapse_white, "a\u00a0\u2003b\n c ", "a b c"),
        (text.collapse_lines, "a  b\r\n\n c ", "a b\nc"),
        (text.search_text, "IŞIK Çağrı'nın 2024 café—Ä", "isik cagri nin 2024 cafe a"),
        (text.citation_text, "Kaynak  (A) - Belge: 1", "Kaynak A Belge 1"),
        (text.normalize_question, "**Ne [zaman](http://x)** açık.", "Ne zaman açık?"),
        (text.relative_path, "a\\..\\.//b/ c.txt", "a/b/ c.txt"),
        (text.folder_path, "a/b/c.txt", "/a/b"),
        (text.folder_path, "c.txt", "/"),
        (text.refresh_minutes, "2 Hours", 120),
        (text.refresh_minutes, "25 hours", None),
        (text.refresh_minutes, "often", None),
        (lambda c: text.cut_at_word(c, 100), "w" * 90 + " " + "v" * 50, "w" * 90 + "..."),
        (lambda c: text.cut_at_word(c, 100), "w" * 50 + " " + "v" * 80, "w" * 50 + " " + "v" * 49 + "..."),
        (urls.canonical, "HTTPS://www.Example.com:443//a//b/?q=1#f", "https://example.com/a/b"),
        (urls.canonical, "http://example.com:8080", "http://example.com:8080"),
        (urls.canonical, " not a url ", "not a url"),
        (urls.title_of, "https://x.com/a/my-page_one%20two+c", "my page one two+c"),
        (urls.topic_of, "https://x.com/a/our-great-TEAM", "Our Great TEAM"),
        (html.title, "<title>T</title><h2 class='a'>A &amp; <b>B</b></h2>", "A & B"),
        (clean.clean, "Anasayfa Hakkımızda  Giriş metni\nÇÖZÜMLER\nApplication error: x\nkısa\nKISA\n© 2024", "Giriş metni\nkısa"),
        (answers.phone, "0212 555 12 34", "+902125551234"),
        (answers.phone, "0049 30 1234567", "+49301234567"),
        (answers.phone, "12345", None),
        (answers.strip_fence, "```html\n<p>x</p>\n```", "<p>x</p>\n"),
    ],
)
def test_vectors(spark, function, value, want):
    assert one(spark, function, value) == want


def test_guid_groups_are_little_endian(spark):
    d = hashlib.sha256(b"x").digest()
    want = "-".join((d[3::-1].hex(), d[5:3:-1].hex(), d[7:5:-1].hex(), d[8:10].hex(), d[10:16].hex()))
    assert one(spark, text.guid_of, "x") == want


def test_links_are_followed_as_a_crawl_does():
    base = "https://www.site.com/a/b"
    assert urls.follow("../c?x=1#y", base, "https://site.com") == "https://site.com/c"
    assert urls.follow("//sub.site.com:8443/d%20e/", base, "https://site.com") == "https://sub.site.com/d e"
    for link in ("", "#x", "mailto:a@b", "http://site.com/a", "https://other.com/", "/a.PDF", "javascript:x", "https://[bad"):
        assert urls.follow(link, base, "https://site.com") is None


def test_links_of_all_kinds(spark):
    markup = """<a class="x" href='/one'>1</a> {"url":"https://x/two"} '/three' <loc> https://x/four </loc>"""
    assert one(spark, html.links, markup) == ["/one", "https://x/two", "/one", "/three", "https://x/four"]


def test_answers(spark):
    md = "Body\n**Kaynak:** A - one; two | B - three\n## Önerilen sorular\n- **Soru bir?**\n* soru BİR?\n1. [Soru iki?](http://x)\nnone"
    assert one(spark, answers.source_line, md) == "A - one; two | B - three"
    assert one(spark, answers.body, md) == "Body"
    assert one(spark, lambda c: answers.suggestions(c, 9), md)[0] == "Soru bir?"
    blocks = spark.createDataFrame([(1, "A - one"), (2, "A - two"), (3, "B - three"), (4, "a - ONE")], "document_id long, label string")
    line = spark.createDataFrame([(7, "A - one; two | B - three")], "answer_id long, line string")
    assert [r.document_id for r in answers.cite(line, blocks).orderBy("rank").collect()] == [3, 1, 2]


def test_parse_questions_drops_unknown_short_and_repeated(spark):
    text_ = "1. 5, 6 | Bu soru yeterince uzun mu\n- 5: kısa\n99 | Bilinmeyen belge sorusu?\n* documents: 6 - BU SORU YETERİNCE UZUN MU?\n5 – Bu soru yeterince uzun mu?"
    docs = spark.createDataFrame([(5, 1), (6, 1), (7, None)], "id long, source_id long")
    got = questions.parse(spark.createDataFrame([(1, text_)], "response_id long, text string"), docs).collect()
    assert [(r.rank, r.question, r.documents) for r in got][0] == (1, "Bu soru yeterince uzun mu?", "5,6")


def test_seed_sources(spark):
    schema = "id long, seed_key string, name string, address string, is_enabled boolean, is_archived boolean"
    now = spark.createDataFrame([(1, "k1", "one", "a1", True, False), (2, "k2", "two", "a2", True, False), (3, None, "three", "a3", True, False)], schema)
    seeds = spark.createDataFrame([("k1", "uno", "b1"), ("k3", "tres", "a3"), ("k4", "four", "a4")], "seed_key string, name string, address string")
    got = {r.address: (r.id, r.seed_key, r.name, r.is_enabled, r.is_archived) for r in store.seed_sources(now, seeds).collect()}
    assert got == {"b1": (1, "k1", "uno", True, False), "a2": (2, "k2", "two", False, True), "a3": (3, "k3", "tres", True, False), "a4": (None, "k4", "four", True, False)}


def test_files(spark, tmp_path):
    def zipped(**entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in entries.items():
                z.writestr(name, body)
        return out.getvalue()

    pdf = b"%PDF stream\n" + zlib.compress(b"BT (A plain sentence of more than forty \\(40\\) characters) Tj [(in) -2 (two)] TJ ET") + b"endstream"
    given = {
        "a.txt": "düz metin".encode(), "b.html": b"<nav>no</nav><p>yes &amp; more</p><script>x</script>",
        "c.docx": zipped(**{"word/document.xml": "<w><t>Word</t><t>text</t></w>"}), "d.epub": zipped(**{"x/1.xhtml": "<p>Book</p>"}),
        "e.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}} caf\'e9 \b bold}", "f.pdf": pdf, "g.exe": b"MZ", "h.docx": b"not a zip", "i.txt": b" ", "j.pdf": b"%PDF",
    }
    for name, body in given.items():
        (tmp_path / name).write_bytes(body)
    got = {r.name: (r.text, r.status) for r in files.read(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("düz metin", "parsed") and got["b.html"] == ("yes & more", "parsed")
    assert got["c.docx"][0] == "Word text" and got["d.epub"][0] == "Book" and got["e.rtf"][0] == "café bold"
    assert got["f.pdf"] == ("A plain sentence of more than forty (40) characters intwo", "parsed")
    assert [got[n][1] for n in ("g.exe", "h.docx", "i.txt", "j.pdf")] == ["failed", "failed", "empty_content", "ocr_not_available"]
    tables = {"files": files.read(spark, str(tmp_path)).drop("preview")}
    files.snapshot(tables, str(tmp_path / "sets"), "set_1")
    assert files.restore(spark, str(tmp_path / "sets"), "set_1", ["files"])["files"].count() == len(given)
    with pytest.raises(ValueError):
        files.snapshot(tables, str(tmp_path), "../x")


def test_chosen_spans_equal_a_greedy_pass(spark):
    import random

    from millrace.operators.edits import non_overlapping

    rng = random.Random(8)
    spans = [(t, rng.randrange(40), rng.randint(1, 9), rng.randint(0, 3)) for t in range(30) for _ in range(rng.randint(0, 12))]
    want = set()
    for text_id in range(30):
        taken = []
        for s in sorted((s for s in spans if s[0] == text_id), key=lambda s: (s[1], s[3], -s[2])):
            if all(s[1] >= a + n or a >= s[1] + s[2] for _, a, n, _ in taken):
                taken.append(s)
        want |= set(taken)
    table = spark.createDataFrame(spans, "text_id long, start int, length int, priority int")
    assert {tuple(r) for r in non_overlapping(table).collect()} == want


def test_crawl_goes_by_depth(spark):
    from millrace.operators.pages import crawl

    link = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    pages = [("https://s.com", link("/a", "https://other.com/x")), ("https://s.com/a", link("b", "/")), ("https://www.s.com/b/", link("/c")), ("https://s.com/c", link("/d")), ("https://other.com/x", "")]
    table = spark.createDataFrame(pages, "url string, html string")
    seeds = spark.createDataFrame([("https://s.com", "https://s.com")], "url string, site string")
    assert [(r.url, r.depth) for r in crawl(table, seeds, max_depth=2).collect()] == [("https://s.com", 0), ("https://s.com/a", 1), ("https://s.com/b", 2)]


def test_labels(spark):
    from millrace.functions import labels

    assert one(spark, labels.safe_file_name, "a\\b/c:d?.txt") == "c_d_.txt" and one(spark, labels.safe_file_name, "x/") == "document"
    name = lambda *v: one(spark, labels.download_name, *v)
    assert name("https://x.com/a/Doc.PDF?x", "text/html", "T") == "Doc.PDF"
    assert name("https://x.com/a/view", "application/pdf; x", "My: title") == "My- title.pdf"
    assert name("https://x.com/", "", "") == "web-document.txt"
    assert one(spark, labels.is_html, " ") and one(spark, labels.is_html, "application/XHTML") and not one(spark, labels.is_html, "image/png")
    assert one(spark, labels.is_utility, "https://x.com/robots.txt") and not one(spark, labels.is_utility, "https://x.com/a/robots.txt")
    assert one(spark, labels.source_type, "Web Sitesi") == "web_site" and one(spark, labels.source_type, "x") is None


def test_crawl_caps_each_site(spark):
    from millrace.operators.pages import crawl

    link = lambda u: f'<a href="{u}">x</a>'
    pages = [(f"https://s{i}.com", "".join(link(f"/p{k}") for k in range(4))) for i in range(3)]
    pages += [(f"https://s{i}.com/p{k}", link(f"/q{k}")) for i in range(3) for k in range(4)]
    pages += [(f"https://s{i}.com/q{k}", "") for i in range(3) for k in range(4)]
    table = spark.createDataFrame(pages, "url string, html string")
    seeds = spark.createDataFrame([(f"https://s{i}.com", f"https://s{i}.com") for i in range(3)], "url string, site string")
    found = lambda n: [(r.site, r.depth, r.url) for r in crawl(table, seeds, max_pages=n).collect()]
    names = ["", "/p0", "/p1", "/p2", "/p3", "/q0", "/q1", "/q2", "/q3"]
    for n in (1, 3, 6, 20):
        want = [(f"https://s{i}.com", len(x) and "/pq".index(x[1]), f"https://s{i}.com{x}") for i in range(3) for x in names[:n]]
        assert sorted(found(n)) == sorted(want), n


def test_fingerprint_gathers_no_lines(spark, monkeypatch):
    import hashlib

    from millrace.operators.retrieve import F, fingerprint

    rows = [(i * 7 % 101, f"hash {i}") for i in range(101)]
    monkeypatch.delattr(F, "collect_list")
    table = spark.createDataFrame(rows, "id long, h string")
    text = "\n".join(f"{i}|{h}" for i, h in sorted(rows))
    assert [tuple(r) for r in fingerprint(table, "id", "h").collect()] == [(hashlib.sha256(text.encode()).hexdigest().upper(), 101)]
    assert fingerprint(table.limit(0), "id", "h").first()["fingerprint"] == hashlib.sha256().hexdigest().upper()


def test_search_text_of_any_character(spark):
    """As translated, put in lower case and decomposed one after the other, for every character and beside others."""
    import re
    import unicodedata

    from pyspark.sql import functions as F

    turkish = str.maketrans("ıİşŞğĞüÜöÖçÇ", "iissgguuoocc")
    chars = [chr(c) for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(chars[i : i + 40]) for i in range(0, len(chars), 40)]
    rows += ["IŞIK İı İ ΑΣ ΑΣİ ΣΑΣ.", "ascii Only 12-3", "Ç 각 ı İ ক্ো", "", " ", "ı", None]
    got = spark.createDataFrame([(i, r, None if r is None else r.translate(turkish)) for i, r in enumerate(rows)], "i int, t string, u string")
    got = got.select("i", text.search_text(F.col("t")).alias("x"), F.lower("u").alias("low")).collect()
    # letters and digits as the JVM knows them
    plain = spark.createDataFrame(
        [(r.i, None if r.low is None else "".join(c for c in unicodedata.normalize("NFD", r.low) if unicodedata.category(c) != "Mn")) for r in got], "i int, t string"
    ).select("i", F.trim(F.regexp_replace("t", r"[^\p{L}\p{Nd}]+", " ")).alias("x"))
    want = {r.i: r.x for r in plain.collect()}
    assert [r.x for r in sorted(got)] == [want[i] for i in range(len(rows))]
    first = re.search(r"x\{(\w+)\}", text._FROM_SEVERAL).group(1)
    assert min(int(x, 16) for x in re.findall(r"x\{(\w+)\}", text._folds()[2])) == int(first, 16)


def test_ascii_texts_pass_no_table(spark):
    """Only the branch of other texts names the table of marks, and the long pattern is asked after the short one."""
    from pyspark.sql import functions as F

    plan = spark.range(1).select(text.search_text(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2 and "octet_length" in plan
