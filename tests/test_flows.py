"""Refresh and redownload: states of sources, kept documents, empty fetches."""

from pyspark.sql import functions as F

from millrace.operators.flows import redownload, refresh

DOCS = "id long, source_id long, url string, title string, content string, content_hash string, status_code string, http_status int, origin string, crawled_at timestamp_ntz"


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")


def docs(spark, *rows):
    return spark.createDataFrame([(i, s, u, "t", c, c, st, h, "web_crawl", None) for i, s, u, c, st, h in rows], DOCS)


def test_states_of_sources(spark):
    present = docs(
        spark, (1, 1, "http://a/1", "x", "ok", 200), (2, 1, "http://a/2", "y", "ok", 200), (3, 2, "http://b/1", "z", "ok", 200),
        (4, 3, "http://c/1", "w", "ok", 200), (5, 4, "http://d/1", "v", "ok", 200),
    )
    staged = docs(
        spark, (11, 1, "HTTP://a/1", "x", "ok", 200), (12, 1, "http://a/3", "n", "ok", 200), (13, 1, "http://a/4", "gone", "error", 404),
        (14, 2, "http://b/1", "e", "timeout", None), (15, 4, "http://d/1", "v2", "ok", 200), (16, 4, None, "q", "error", 500),
    )
    sources = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    errors = spark.createDataFrame([(2, "no route"), (4, "one page"), (5, "no route")], "source_id long, message string")
    after, results = refresh(present, staged, sources, errors, now())
    got = {r.source_id: tuple(r)[1:] for r in results.collect()}
    assert got == {
        1: ("completed", 1, 0, 1, 1, 1, True),
        2: ("unreachable", 0, 0, 0, 0, 0, False),
        3: ("warning", 0, 0, 0, 0, 0, False),
        4: ("warning", 0, 1, 0, 0, 1, True),
        5: ("unreachable", 0, 0, 0, 0, 0, False),
    }
    assert sorted((r.source_id, r.content) for r in after.collect()) == [(1, "n"), (1, "x"), (2, "z"), (3, "w"), (4, "v2")]


def test_nothing_fetched(spark):
    present = docs(spark, (1, 1, "http://a/1", "x", "ok", 200))
    sources = spark.createDataFrame([(1,)], "id long")
    none = spark.createDataFrame([], "source_id long, message string")
    after, results = refresh(present, present.limit(0), sources, none, now())
    assert [r.content for r in after.collect()] == ["x"] and results.first().state == "warning"
    assert [r.outcome for r in redownload(present, present.limit(0), now()).collect()] == ["kept"]
    assert not redownload(present.limit(0), present, now()).collect()


def test_redownload(spark):
    present = docs(spark, *[(i, 1, f"http://a/{i}", "x", "ok", 200) for i in range(1, 5)])
    fetched = spark.createDataFrame(
        [(1, "new", "ok", 200), (1, "new", "ok", 200), (2, None, "timeout", None), (3, "gone", "error", 410), (9, "?", "ok", 200)],
        "id long, content string, status_code string, http_status int",
    )
    got = {r.id: (r.outcome, r.content, r.http_status) for r in redownload(present, fetched, now()).collect()}
    assert got == {1: ("updated", "new", 200), 2: ("unreachable", "x", 200), 3: ("deleted", "x", 200), 4: ("kept", "x", 200)}
