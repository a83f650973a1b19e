"""Upkeep of the store, on rows made for each case."""

from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import ids, store, upkeep

DOCS = "id long, source_id long, url string, content string, content_hash string, origin string, crawled_at timestamp_ntz"
OLD, NEW = datetime(2024, 1, 1), datetime(2025, 1, 1)
NOW = "timestamp_ntz '2025-01-01 00:00:00'"


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_replacement_keeps_what_has_no_successor(spark):
    present = spark.createDataFrame(
        [
            (1, 1, "https://a/x", "old", "h1", "web_crawl", OLD),
            (2, 1, "https://a/gone", "old", "h2", "web_crawl", OLD),
            (3, 1, "https://a/x", "hand", "h3", "manual_upload", OLD),
            (4, 2, "https://b/x", "old", "h4", "web_crawl", OLD),
            (5, None, "https://c/x", "old", "h5", "web_crawl", OLD),
            (6, 1, None, "old", "h6", None, OLD),
        ],
        DOCS,
    )
    staged = spark.createDataFrame(
        [
            (10, 1, "HTTPS://A/X", "new", "n1", "web_crawl", NEW),
            (11, 1, "https://a/x", "newer", "n2", "web_crawl", NEW),
            (12, 1, "https://a/new", "new", "n3", "web_crawl", NEW),
            (13, 1, "https://a/blank", "  ", "n4", "web_crawl", NEW),
            (14, 1, None, "new", "n5", "web_crawl", NEW),
            (15, 2, "https://b/x", "", "n6", "web_crawl", NEW),
            (16, 3, "https://d/x", "new", "n7", "web_crawl", NEW),
        ],
        DOCS,
    )
    refreshed = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    found = upkeep.replace_crawl(present, staged, refreshed, F.expr(NOW))
    kept = {(h, first, at) for h, first, at in _rows(found, "content_hash", "first_seen", "crawled_at")}
    assert kept == {
        ("h3", OLD, OLD), ("h4", OLD, OLD), ("h5", OLD, OLD), ("h6", OLD, OLD), ("n2", OLD, NEW), ("n3", NEW, NEW),
    }
    assert found.count() == 6
    assert upkeep.replace_crawl(present, staged.limit(0), refreshed, F.expr(NOW)).count() == 6
    assert upkeep.replace_crawl(present.limit(0), staged, refreshed, F.expr(NOW)).count() == 2
    again = upkeep.replace_crawl(found, staged, refreshed, F.expr("timestamp_ntz '2026-01-01 00:00:00'"))
    assert ("n3", NEW) in _rows(again, "content_hash", "first_seen")


def test_addresses_are_compared_as_the_store_keeps_them(spark):
    present = spark.createDataFrame(
        [
            (1, 1, "https://www.a.x/P", "old", "h1", "web_crawl", OLD),
            (2, 1, "https://a.x/q/", "old", "h2", "web_crawl", OLD),
            (3, 1, "https://a.x/r", "old", "h3", "web_crawl", OLD),
            (4, 2, "https://a.x/s", "old", "h4", "web_crawl", OLD),
            (7, 1, "https://a.x/q", "hand", "h5", "manual_upload", OLD),
        ],
        DOCS,
    )
    spelled = [(1, "HTTPS://a.x:443/p?x=1"), (1, "https://www.A.x/q#top"), (2, "https://a.x/r/")]
    found = spark.createDataFrame(spelled, "source_id long, url string")
    crawled = spark.createDataFrame([(1,)], "id long")
    assert _rows(store.missing(present, found, crawled), "id") == [(3,)]
    assert _rows(store.missing(present, found), "id") == [(3,), (4,)]
    assert _rows(store.missing(present, found.limit(0), crawled), "id") == [(1,), (2,), (3,)]
    assert _rows(store.without_missing(present, found, crawled), "id") == [(1,), (2,), (4,), (7,)]
    # a path's case counts for deletes, as it is the stored URL that is named
    urls = spark.createDataFrame([("https://www.a.x/q",), ("https://a.x/p",), ("https://a.x//r/",)], "url string")
    assert _rows(upkeep.delete_crawled(present, urls), "id") == [(1,), (4,), (7,)]
    staged = spark.createDataFrame(
        [
            (10, 1, "https://a.x/p/", "new", "n1", "web_crawl", NEW),
            (11, 1, "https://www.a.x/Q", "new", "n2", "web_crawl", NEW),
            (12, 1, "https://a.x/new", "new", "n3", "web_crawl", NEW),
            (13, 2, "https://a.x/p", "new", "n4", "web_crawl", NEW),
        ],
        DOCS,
    )
    after = upkeep.replace_crawl(present, staged, spark.createDataFrame([(1,), (2,)], "id long"), F.expr(NOW))
    assert _rows(after, "content_hash", "url", "first_seen") == [
        ("h5", "https://a.x/q", OLD), ("n1", "https://a.x/p", OLD), ("n2", "https://a.x/Q", OLD), ("n3", "https://a.x/new", NEW), ("n4", "https://a.x/p", NEW),
    ]
    assert [i for (i,) in _rows(after, "id")] == [7, 8, 9, 10, 11]
    diff = store.snapshot_diff(*[df.withColumns({"status_code": F.lit("ok"), "http_status": F.lit(200)}) for df in (present.where("id < 7"), staged)])
    assert _rows(diff, "source_id", "key", "change") == [
        (1, "https://a.x/new", "added"), (1, "https://a.x/p", "updated"), (1, "https://a.x/q", "updated"), (1, "https://a.x/r", "deleted"),
        (2, "https://a.x/p", "added"), (2, "https://a.x/s", "deleted"),
    ]


def test_ids_are_dense_and_depend_on_keys_alone(spark):
    rows = spark.createDataFrame([(f"k{i}", i % 7) for i in range(500)] + [(None, 3)], "k string, v int")
    present = spark.createDataFrame([(41,), (None,)], "id long")
    dealt = {(r.k, r.v): r.id for r in ids.deal_ids(rows.repartition(3), [F.col("k")], present).collect()}
    assert sorted(dealt.values()) == list(range(42, 543))
    again = ids.deal_ids(rows.orderBy("v"), [F.col("k")], present, digits=1)
    assert {(r.k, r.v): r.id for r in again.collect()} == dealt
    assert sorted(r.n for r in ids.deal_ids(rows, [F.col("v"), F.col("k")], column="n").collect()) == list(range(1, 502))
    assert not ids.deal_ids(rows.limit(0), [F.col("k")], present).collect()
    assert [r.id for r in ids.deal_ids(rows.limit(1), [F.col("k")], present.limit(0)).collect()] == [1]


def test_deletes(spark):
    docs = spark.createDataFrame([(1, "u", "web_crawl"), (2, "u", "manual_upload"), (3, None, None), (4, None, "web_crawl")], "id long, url string, origin string")
    urls = spark.createDataFrame([("u",), ("u",), (None,)], "url string")
    assert _rows(upkeep.delete_crawled(docs, urls), "id") == [(2,), (3,), (4,)]
    assert _rows(upkeep.delete_crawled(docs), "id") == [(2,), (3,)]
    assert upkeep.delete_crawled(docs, urls.limit(0)).count() == 4
    assert _rows(upkeep.delete_documents(docs, docs.where("id > 2")), "id") == [(1,), (2,)]


def test_runs_end_as_their_last_completion_says(spark):
    started = spark.createDataFrame([(1, OLD), (2, OLD)], "run_id long, started_at timestamp_ntz")
    kind = "run_id long, completed_at timestamp_ntz, status string, pages long, errors long, warnings long"
    ends = spark.createDataFrame([(1, OLD, "failed", 0, 9, 0), (1, NEW, "completed", 5, None, 1), (7, NEW, "failed", 1, 1, 1)], kind)
    rows = _rows(upkeep.complete_runs(started, ends), "run_id", "status", "pages", "errors", "warnings")
    assert rows == [(1, "completed", 5, 0, 1), (2, "running", 0, 0, 0)]


def test_gate(spark):
    rows = spark.createDataFrame(
        [(80, "a", "a", False), (79, "a", "a", False), (80, "a", "b", False), (80, "a", "a", True), (100, None, "a", True), (90, None, None, None)],
        "n int, stored string, current string, force boolean",
    )
    out = rows.select(upkeep.refresh_needed(F.col("n"), F.col("stored"), F.col("current"), F.col("force")), upkeep.accepted(F.col("n"), F.col("force")))
    assert [tuple(r) for r in out.collect()] == [(False, True), (True, False), (True, True), (True, False), (True, True), (False, True)]


def test_cache_follows_documents(spark):
    cache = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], "id long, h string")
    current = spark.createDataFrame([(2, "c"), (3, None), (4, "d"), (5, "e")], "id long, h string")
    rows = _rows(upkeep.refresh_cache(cache, current, "id", "h"), "id", "action")
    assert rows == [(1, "dropped"), (2, "rebuilt"), (3, "kept"), (4, "rebuilt"), (5, "added")]
    assert {a for _, a in _rows(upkeep.refresh_cache(cache, current.limit(0), "id", "h"), "id", "action")} == {"dropped"}


def test_titles_and_previews(spark):
    rows = spark.createDataFrame(
        [
            (" T\n", None, None, "https://a/x", "x" * 261, None),
            (" ", "f.pdf ", None, "https://a/x", "a\n\n b", "m"),
            (None, "", " p ", None, " \n", " m  n "),
            (None, None, None, "https://a/some-page", None, None),
        ],
        "title string, file string, place string, url string, content string, message string",
    )
    out = rows.select(
        upkeep.citation_title(F.col("title"), F.col("file"), F.col("place"), F.col("url")),
        upkeep.document_preview(F.col("content"), F.col("message")),
    )
    assert [tuple(r) for r in out.collect()] == [
        ("T", "x" * 260 + "..."), ("f.pdf", "a b"), ("p", "m n"), ("some page", upkeep.NO_PREVIEW),
    ]
