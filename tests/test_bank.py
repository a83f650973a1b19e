"""Edits of sources, providers, grouped citations and empty tables of the bank."""

from pyspark.sql import functions as F

from millrace.operators import bank

SOURCES = "id long, guid string, source_type string, name string, address string, seed_key string, is_enabled boolean, is_archived boolean"


def test_edits_of_sources(spark):
    sources = spark.createDataFrame(
        [(1, "g1", "web_site", "a", "https://a.com", "k", True, False), (2, "g2", "local_files", "b", "local://source/g2", None, True, False),
         (3, "g3", "web_site", "c", "https://c.com", None, True, False), (4, None, "web_site", None, None, None, None, None)], SOURCES,
    )
    edits = spark.createDataFrame(
        [(1, "web_site", "x", "https://other.com", True), (2, "web_site", "y", None, True), (3, "WEB_SITE", " ", "HTTP://www.C.org/p/?q", False),
         (4, "web_site", "n", None, True), (4, "web_site", "n", None, True), (9, "web_site", "z", None, True)],
        "id long, source_type string, name string, address string, is_enabled boolean",
    )
    got = {r.id: (r.name, r.address, r.is_enabled, r.outcome) for r in bank.update_sources(sources, edits).collect()}
    assert got[1] == ("a", "https://a.com", True, "refused_address") and got[2] == ("b", "local://source/g2", True, "refused_type")
    assert got[3] == ("c", "http://c.org/p", False, "updated") and got[4][0] == "n" and len(got) == 4
    assert {r.outcome for r in bank.update_sources(sources, edits.limit(0)).collect()} == {"kept"}


def test_providers(spark):
    rows = spark.createDataFrame(
        [(["Azure-Cloud", "ollama-local", "azure", None, "x"], ["OLLAMA-LOCAL"]), (None, None), ([], ["azure"])], "n array<string>, d array<string>"
    )
    assert [r[0] for r in rows.select(bank.provider_order(F.col("n"), F.col("d"))).collect()] == [["azure"], [], []]


def test_grouped_citations(spark):
    cited = spark.createDataFrame(
        [(1, 10, 5, "b", 1), (1, 11, 4, "a", 2), (1, 12, 5, "b", 3), (2, 10, 5, "b", 1)],
        "answer_id long, document_id long, source_id long, source_name string, rank int",
    )
    got = {(r.answer_id, r.place): (r.source_id, r.documents) for r in bank.grouped_citations(cited).collect()}
    assert got == {(1, 1): (5, [10, 12]), (1, 2): (4, [11]), (2, 1): (5, [10])}
    assert not bank.grouped_citations(cited.limit(0)).collect()


def test_diagnostics_of_one_source(spark):
    docs = spark.createDataFrame(
        [(1, 1, "t", "ok", 200), (2, 1, None, "timeout", None), (3, 2, "u", "error", 500)],
        "id long, source_id long, title string, status_code string, http_status int",
    )
    sources = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    assert [r.document_id for r in bank.diagnostics(docs, sources, 1).collect()] == [2]
    assert {(r.source_id, r.document_id) for r in bank.diagnostics(docs, sources).collect()} == {(1, 2), (2, 3), (3, None)}
