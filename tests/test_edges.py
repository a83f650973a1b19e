"""Hard inputs of operators whose queries see easy ones."""

from pyspark.sql import functions as F


def test_citations_with_separators_in_labels(spark):
    from millrace.operators.answers import cite

    blocks = spark.createDataFrame(
        [(1, "src1 - A | B"), (2, "src1 - C"), (3, "src2 - long; title"), (4, "src1 - C"), (5, "x"), (6, "")], "document_id long, label string"
    )
    answers = spark.createDataFrame(
        [(1, "src1 - A | B; C"), (2, "see src2 - long; title, too"), (3, "nothing"), (4, None), (5, "SRC1 - c"), (6, "")], "answer_id long, line string"
    )
    found = {}
    for r in sorted(cite(answers, blocks).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.answer_id, []).append(r.document_id)
    assert found == {1: [1], 2: [3], 5: [2]}
    assert not cite(answers.limit(0), blocks).collect() and not cite(answers, blocks.limit(0)).collect()


def test_whole_labels_come_first_longest_first(spark):
    from millrace.operators.answers import cite

    blocks = spark.createDataFrame([(1, "A - one"), (2, "A - two"), (3, "B - three"), (4, "a - ONE")], "document_id long, label string")
    line = spark.createDataFrame([(7, "A - one; two | B - three")], "answer_id long, line string")
    assert [r.document_id for r in cite(line, blocks).orderBy("rank").collect()] == [3, 1, 2]


def test_stamps_stay(spark):
    from millrace.operators.edits import after_refresh
    from millrace.operators.questions import serve

    asked = spark.sql("select * from values (1L, 2, timestamp_ntz'2023-05-05 00:00:00'), (2L, 0, null) t(id, served_count, last_served_at)")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = {r.id: r for r in serve(asked, asked.where("id = 2"), now).collect()}
    assert rows[1].last_served_at.year == 2023 and rows[2].last_served_at.year == 2024 and rows[2].served_count == 1
    sources = spark.sql("select 1L id, 'k' seed_key, timestamp_ntz'2023-01-01 00:00:00' next_refresh, timestamp_ntz'2022-01-01 00:00:00' succeeded_at")
    failed = spark.sql("select 1L id, false ok, 5L period_minutes")
    after = after_refresh(sources, failed, now)
    assert len(set(after.columns)) == len(after.columns) and after.first().succeeded_at.year == 2022 and after.first().next_refresh.minute == 5


def test_repeated_addresses_in_a_snapshot(spark):
    from millrace.operators.store import snapshot_diff

    columns = "id long, url string, content_hash string, status_code string, http_status int"
    old = spark.createDataFrame([(1, "http://a", "x", "ok", 200), (2, "http://b", "y", "ok", 200)], columns)
    new = spark.createDataFrame([(1, "http://a", "x", "ok", 200), (3, "HTTP://A", "z", "ok", 200)], columns)
    assert {(r.key, r.change) for r in snapshot_diff(old, new).collect()} == {("http://a", "updated"), ("http://b", "deleted")}


def test_title_of_a_blank_heading(spark):
    from millrace.functions.html import title

    pages = spark.createDataFrame([("<h1><img></h1><title>T</title>",), ("<h2>H &amp; h</h2><title>T</title>",), ("none",), (None,)], "html string")
    assert [r[0] for r in pages.select(title(F.col("html"))).collect()] == ["T", "H & h", None, None]
