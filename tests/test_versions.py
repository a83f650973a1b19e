"""Versioned sets of tables, and flows over them that fail on the way."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import refresh
from millrace.sources.versions import Conflict, TableSet, failed

DOCS = (
    "id long, source_id long, url string, title string, content string, content_hash string, status_code string, http_status int, "
    "origin string, crawled_at timestamp_ntz, is_enabled boolean, is_archived boolean"
)


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")


def counts(store, version=None):
    return {n: df.count() for n, df in store.read(version).items()}


def test_commits_are_whole(spark, tmp_path):
    store = TableSet(spark, str(tmp_path / "set"))
    assert store.current() == 0 and store.read() == {} and store.backups() == {}
    a, b = spark.range(5), spark.range(3).selectExpr("id", "'x' as t", "named_struct('u', array(1)) as s")
    assert store.commit({"a": a, "b": b}) == 1 and counts(store) == {"a": 5, "b": 3}
    assert store.read()["b"].schema.simpleString() == b.schema.simpleString()
    held = store.read()
    with pytest.raises(Exception, match="lost") as caught:
        store.commit({"a": spark.range(9), "b": b.withColumn("t", F.raise_error(F.lit("lost")).cast("string"))})
    assert failed(caught.value) and store.current() == 1 and counts(store) == {"a": 5, "b": 3}
    # b is carried over, and who read before sees what was then
    assert store.commit({"a": spark.range(9)}) == 2 and counts(store) == {"a": 9, "b": 3} and held["a"].count() == 5
    with pytest.raises(Conflict):
        store.commit({"a": a}, base=1)
    # two that start from one version: one comes through
    store._point(2, store.tables())
    with pytest.raises(Conflict):
        store._point(2, store.tables())
    with pytest.raises(ValueError, match="letters"):
        store.backup("../x")


def test_backups_restore_and_retention(spark, tmp_path):
    store = TableSet(spark, str(tmp_path / "set"))
    store.commit({"a": spark.range(5)})
    assert store.backup("first") == 1
    store.commit({"a": spark.range(6)})
    store.backup("second")
    store.commit({"a": spark.range(7)})
    assert store.backups() == {"first": 1, "second": 2}
    assert store.restore("first") == 4 and counts(store) == {"a": 5}
    assert store.restore(3) == 5 and counts(store) == {"a": 7}
    # a writer that failed leaves data, which goes once it is old
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": spark.range(2), "b": spark.range(1).select(F.raise_error(F.lit("lost")).cast("string").alias("x"))})
    folders = lambda: len(store.files.names(f"{store.root}/data"))
    assert folders() == 4 and store.retain(1) == [3, 4] and folders() == 4
    assert store.drop_backups_except("second") == ["first"] and store.backups() == {"second": 2}
    assert store.retain(1, grace_s=0) == [1] and store.versions() == [2, 5] and folders() == 2
    assert counts(store) == {"a": 7} and counts(store, 2) == {"a": 6}


def test_attempts_end_with_the_first_that_is_final(spark):
    rows = [(1, 0, True), (1, 1, True), (2, 0, False), (2, 1, False), (2, 2, True), (2, 3, True), (3, 5, False), *[(4, k, False) for k in range(9)]]
    log = spark.createDataFrame(rows, "source_id long, attempt long, final boolean")
    got = {r.source_id: tuple(r)[1:] for r in refresh.final_attempts(log).collect()}
    assert got == {1: (1, 0, True, 0.0), 2: (3, 2, True, 15.0), 3: (1, 5, False, 0.0), 4: (4, 3, False, 35.0)}
    cases = [(0, 0, 0, 0, 0, True), (0, 0, 1, 0, 0, False), (3, 1, 5, 3, 0, True), (3, 0, 1, 3, 0, False), (3, 0, 1, 2, 0, True), (3, 0, 0, 0, 3, False), (3, 0, 0, 0, 2, True)]
    table = spark.createDataFrame(cases, "pages int, ok int, errors int, unanswered int, passing int, want boolean")
    judged = table.select(refresh.is_final(*map(F.col, ("pages", "ok", "errors", "unanswered", "passing"))).alias("got"), "want")
    assert all(r.got == r.want for r in judged.collect())


def _docs(spark, *rows):
    return spark.createDataFrame([(i, s, u, "t", c, c, st, h, o, None, True, False) for i, s, u, c, st, h, o in rows], DOCS)


def test_redownload_follows_the_kind_of_source(spark):
    sources = spark.createDataFrame([(1, "web_site"), (2, "web_links"), (3, "web_site"), (4, "local_files"), (5, "web_links")], "id long, source_type string")
    docs = _docs(
        spark, (1, 1, "https://a/1", "x", "ok", 200, "web_crawl"), (2, 1, "https://a/2", "y", "ok", 200, "web_crawl"),
        (3, 2, "https://l/1", "l1", "ok", 200, "manual_web_link"), (4, 2, "https://l/2", "l2", "ok", 200, "manual_web_link"),
        (5, 2, "https://l/3", "l3", "ok", 200, "manual_web_link"), (6, 3, "https://c/1", "c", "ok", 200, "web_crawl"), (7, 4, "local://f", "f", "ok", 200, "local_import"),
    )
    fetched = _docs(
        spark, (11, 1, "https://www.a/1/", "x2", "ok", 200, None), (12, 1, "https://a/3", "z", "ok", 200, None), (13, 1, "https://a/4", "gone", "error", 404, None),
        (14, 2, "https://l/1#x", "new", "ok", 200, None), (15, 2, "https://l/2", None, "timeout", None, None), (16, 2, "https://l/3", "missing", "http404", 404, None),
        (17, 2, "https://l/other", "q", "ok", 200, None), (18, 3, "https://c/1", "e", "timeout", None, None),
    )
    errors = spark.createDataFrame([(1, "one page"), (3, "no route")], "source_id long, message string")
    after, results = refresh.redownload_sources(docs, sources, fetched, errors, now())
    assert sorted((r.id, r.url, r.content, r.origin) for r in after.collect()) == [
        (1, "https://a/1", "x2", "web_crawl"), (3, "https://l/1", "new", "manual_web_link"), (4, "https://l/2", "l2", "manual_web_link"),
        (5, "https://l/3", "missing", "manual_web_link"), (6, "https://c/1", "c", "web_crawl"), (7, "local://f", "f", "local_import"), (8, "https://a/3", "z", "web_crawl"),
    ]
    assert {r.source_id: tuple(r)[2:] for r in results.collect()} == {1: (3, 0, 1), 2: (3, 2, 0), 3: (0, 1, 0), 4: (1, 0, 0), 5: (0, 1, 0)}
    empty, _ = refresh.redownload_sources(docs, sources, fetched.limit(0), errors.limit(0), now())
    assert sorted(r.id for r in empty.collect()) == [3, 4, 5, 7]
