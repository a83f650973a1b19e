"""Identity, local sources, pages by URL, downloads and previews, on rows made for each case."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import sums_before
from millrace.operators import identity


def test_local_sources(spark):
    kind = "id long, name string, description string, source_type string, guid string, address string, is_enabled boolean, is_archived boolean, tenant_guid string, bank_guid string"
    sources = spark.createDataFrame(
        [(1, "a", "", "local_files", "g1", "local://source/g1", False, True, "t0", "b0"), (2, "b", "", "web_site", None, "local://source/g2", False, True, "t0", "b0"),
         (3, "c", "", "web_site", "g9", "https://c", True, False, "t0", "b0")], kind,
    )
    wanted = spark.createDataFrame([("g1", "x", None), ("g2", " two ", " d "), ("g3", " ", None), ("g3", "z", None), (None, "n", None)], "guid string, name string, description string")
    one = lambda g: spark.createDataFrame([(g,)], "guid string")
    who = identity.identity(one("t"), one("b"))
    assert [tuple(r) for r in who.collect()] == [("t", "b")] and identity.identity(one("t"), one("b").limit(0)).count() == 0
    got = {r.id: r for r in identity.ensure_local(sources, wanted, who).collect()}
    assert {i: r.change for i, r in got.items()} == {1: "present", 2: "updated", 3: "kept", 4: "inserted"}
    assert (got[1].name, got[1].is_enabled) == ("a", False) and (got[2].name, got[2].guid, got[2].is_enabled, got[2].tenant_guid) == ("two", "g2", True, "t")
    assert (got[4].name, got[4].address, got[4].source_type, got[4].bank_guid) == (identity.LOCAL, "local://source/g3", "local_files", "b")
    assert identity.ensure_local(sources, wanted.limit(0), who).count() == 3


def test_pages_by_url(spark):
    docs = spark.createDataFrame([(1, "https://www.a.x/P/"), (2, "https://a.x/q"), (3, None)], "id long, url string")
    assert {tuple(r) for r in identity.pages_by_url(docs).collect()} == {("https://a.x/p", 1), ("https://a.x/q", 2)}
    with pytest.raises(Exception, match="two documents have the URL"):
        identity.pages_by_url(docs.union(spark.createDataFrame([(4, "HTTPS://A.x/p")], docs.schema))).collect()


def test_downloads_and_previews(spark):
    urls = ["https://a/x.PDF", "https://a/x.html", "https://a/x", "https://a/x.docx?y#z", "https://a.pdf/", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    got = rows.select(*[identity.should_download(F.col("url"), F.lit(k)) for k in ("web_site", "WEB_LINKS")]).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False), (True, True), (False, False), (False, False)]
    files = spark.createDataFrame([(1, "a/b.c.txt", "./x//b.txt", b"one  two"), (2, "n.bin", None, b"?"), (3, "e.md", None, b"")], "id long, name string, path string, content binary")
    found = {r.id: (r.path, r.title, r.text, r.preview, r.status) for r in identity.previewed(files).collect()}
    assert found == {1: ("x/b.txt", "b.c", "one  two", "one two", "parsed"), 2: ("n.bin", "n", "", identity.NO_PREVIEW, "parse_failed"), 3: ("e.md", "e", "", "e.md", "parsed")}


def test_sums_before(spark):
    rows = spark.createDataFrame([([],), ([5],), (list(range(300)),)], "v array<int>")
    assert [r[0] for r in rows.select(sums_before(F.col("v"))).collect()] == [[], [0], [sum(range(i)) for i in range(300)]]
