"""Edits of documents, sources, folders and questions: each returns the next version of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_spaces, folder_path, guid_of, preview, relative_path
from ..sources import views



def _changed(rows: DataFrame, edits: DataFrame, new: dict[str, Column], key: str = "id") -> DataFrame:
    """``rows`` with the columns of ``new`` (over columns e_*) where ``edits`` has the key."""
    marked = edits.select(F.col(key), *[F.col(c).alias(f"e_{c}") for c in edits.columns if c != key], F.lit(True).alias("_hit"))
    joined = rows.join(marked, key, "left")
    return joined.select(
        *[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns]
    )


def edit_documents(docs: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Hand edits (id, title, content, is_enabled): content is collapsed and hashed again, crawled rows become uploads.

    Edits that leave no title or no content are passed over.
    """
    clean = edits.withColumns({"title": F.trim("title"), "content": collapse_spaces(F.col("content"))})
    clean = clean.where("title <> '' and content <> ''")
    return _changed(
        docs,
        clean,
        {
            "title": F.col("e_title"),
            "content": F.col("e_content"),
            "is_enabled": F.col("e_is_enabled"),
            "status_code": F.lit("ok"),
            "http_status": F.coalesce("http_status", F.lit(200)),
            "content_hash": F.sha2("e_content", 256),
            "crawled_at": now,
            "origin": F.when(F.col("origin") == "web_crawl", "manual_upload").otherwise(F.col("origin")),
        },
    )


def mark_invalid(docs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Documents after failed fetches (id, status_code, http_status): blank codes are ``invalid``."""
    code = F.coalesce(F.nullif(F.trim("e_status_code"), F.lit("")), F.lit("invalid"))
    return _changed(docs, failures, {"status_code": code, "http_status": F.col("e_http_status"), "crawled_at": now})


def toggle(rows: DataFrame, ids: DataFrame, flag: str, value: bool) -> DataFrame:
    """``flag`` set for the rows in ``ids`` (id)."""
    return _changed(rows, ids.select("id").distinct(), {flag: F.lit(value)})


def after_refresh(sources: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Seeded sources after refreshes (id, ok, period_minutes): when they are due next, and when they last succeeded.

    A failed refresh leaves the time of the last success as it was.
    """
    before = F.col("succeeded_at") if "succeeded_at" in sources.columns else F.lit(None)
    marked = results.select(F.col("id"), F.col("ok").alias("e_ok"), F.col("period_minutes").alias("e_period"), F.lit(True).alias("_hit"))
    joined = sources.join(marked, "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("seed_key").isNotNull()
    due = F.timestamp_add("minute", F.greatest(F.lit(1), F.col("e_period").cast("int")), now)
    return joined.select(
        *[c for c in sources.columns if c not in ("next_refresh", "succeeded_at")],
        F.when(hit, due).otherwise(F.col("next_refresh")).alias("next_refresh"),
        F.when(hit & F.col("e_ok"), now).otherwise(before).alias("succeeded_at"),
    )


def upsert_folders(files: DataFrame) -> DataFrame:
    """The folders of ``files`` (source_id, path), a row each with the guid that its key gives."""
    placed = files.select("source_id", folder_path(F.col("path")).alias("path")).distinct()
    return placed.withColumn("guid", guid_of(F.concat_ws("|", F.col("source_id").cast("string"), "path")))


def replace_questions(candidates: DataFrame, fingerprint: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Questions and references that replace all present ones, from ``candidates`` (rank, question, document_id).

    Of a question's rows for one document the first by rank stays; ids are the
    order of ranks. Rows without a document make no question.
    """
    named = candidates.where("document_id is not null")
    refs = named.groupBy("question", "document_id").agg(F.min("rank").alias("rank"))
    heads = refs.groupBy("question").agg(F.min("rank").alias("rank"))
    # as many rows as there are suggested questions: a hundred
    ids = heads.select(F.row_number().over(Window.orderBy("rank")).cast("long").alias("id"), "question")
    questions = ids.select(
        "id", "question", F.lit(fingerprint).alias("fingerprint"), F.lit(0).alias("served_count"), now.alias("created_at")
    )
    return questions, refs.join(ids, "question").select(F.col("id").alias("question_id"), "document_id")


def without_overlaps(spans: Column, kind: str) -> Column:
    """Of an array of ``spans`` (of type ``kind``, with start, length and priority) those to replace.

    In order of start, priority and length, longest first, each is taken that
    overlaps none taken before it.
    """
    keys = lambda s: F.struct(s["start"].alias("start"), s["priority"].alias("priority"), (-s["length"]).alias("shorter"), s.alias("s"))
    empty = F.struct(F.lit(0).alias("upto"), F.array().alias("kept")).cast(f"struct<upto: int, kept: array<{kind}>>")

    def step(acc: Column, k: Column) -> Column:
        taken = F.struct((k["start"] + k["s"]["length"]).alias("upto"), F.concat(acc["kept"], F.array(k["s"])).alias("kept"))
        return F.when(k["start"] >= acc["upto"], taken).otherwise(acc)

    return F.aggregate(F.array_sort(F.transform(spans, keys)), empty, step, lambda acc: acc["kept"])


def non_overlapping(spans: DataFrame) -> DataFrame:
    """Of each text's ``spans`` (text_id, start, length, priority) those to replace, as `without_overlaps` says."""
    kind = "struct<start: int, length: int, priority: int>"
    lists = spans.groupBy("text_id").agg(F.collect_list(F.struct("start", "length", "priority").cast(kind)).alias("spans"))
    return lists.select("text_id", F.inline(without_overlaps(F.col("spans"), kind)))


_AT = "2024-02-01 00:00:00"


def _now() -> Column:
    return F.lit(_AT).cast("timestamp_ntz")


def q_edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents but uploads are edited by hand, their whole texts too."""
    docs = views.documents(spark, sf_dir)
    edits = docs.where("origin <> 'manual_upload'").select(
        "id", F.concat(F.lit(" "), "title", F.lit(" edited ")).alias("title"), F.concat("content", F.lit("\r\n  end ")).alias("content"),
        (~F.col("is_enabled")).alias("is_enabled"),
    )
    after = edit_documents(docs, edits, _now())
    return after.select("id", "title", "content_hash", "is_enabled", "http_status", "origin", "crawled_at", preview(F.col("content"), F.col("title"), "-").alias("preview"))


def q_invalid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir)
    code = F.when(F.col("http_status") == 503, " timeout ").otherwise(" ")
    failures = docs.where("http_status <> 200").select("id", code.alias("status_code"), F.lit(None).cast("int").alias("http_status"))
    return mark_invalid(docs, failures, _now()).select("id", "status_code", "http_status", "crawled_at")


def q_refreshed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.sources(spark, sf_dir).withColumn("succeeded_at", F.when(F.col("id") % 3 == 0, F.col("next_refresh")))
    results = sources.where("is_enabled").select("id", (~F.col("is_archived")).alias("ok"), (F.col("id") % 1000 * 30 - 60).alias("period_minutes"))
    return after_refresh(sources, results, _now()).select("id", "next_refresh", "succeeded_at")


def q_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir).where("source_id is not null")
    path = F.concat(F.lit("a\\.\\"), (F.col("id") % 7).cast("string"), F.lit("//../"), (F.col("id") % 3).cast("string"), F.lit("/f"), "id", F.lit(".txt"))
    files = docs.select("source_id", path.alias("path"))
    return upsert_folders(files.withColumn("path", relative_path(F.col("path"))))


def q_toggled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir)
    return toggle(docs, docs.where("origin = 'web_crawl'"), "is_archived", True).select("id", "is_archived")


def q_replaced_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = views.question_documents(spark, sf_dir).join(views.questions(spark, sf_dir).select(F.col("id").alias("question_id"), "question"), "question_id")
    doubled = refs.select((F.col("question_id") * 10 + F.col("position")).alias("rank"), "question", "document_id")
    questions, links = replace_questions(doubled.union(doubled), "print", _now())
    return links.join(questions.select(F.col("id").alias("question_id"), "question"), "question_id")


def q_chosen_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made from line items: a text an order."""
    items = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("text_id"),
        (F.col("l_partkey") % 60).cast("int").alias("start"),
        (F.col("l_suppkey") % 25 + 1).cast("int").alias("length"),
        F.col("l_linenumber").cast("int").alias("priority"),
    )
    return non_overlapping(items)


QUERIES = {
    "edited_documents": q_edited_documents,
    "invalid_documents": q_invalid_documents,
    "refreshed_sources": q_refreshed_sources,
    "folders": q_folders,
    "toggled_documents": q_toggled_documents,
    "replaced_questions": q_replaced_questions,
    "chosen_spans": q_chosen_spans,
}

_AT_SQL = f"TIMESTAMP '{_AT}'"
ORACLES = {
    "edited_documents": rf"""
SELECT id, title, content_hash, is_enabled, http_status, origin, crawled_at,
  CASE WHEN length(c) <= 260 THEN c ELSE rtrim(left(c, 260), ' ') || '...' END AS preview FROM (
  SELECT *, CASE WHEN p <> '' THEN p ELSE coalesce(nullif(trim(title, ' '), ''), '-') END AS c FROM (
    SELECT *, trim(regexp_replace(translate(content, chr(13) || chr(10), '  '), ' +', ' ', 'g'), ' ') AS p FROM (
      SELECT id, CASE WHEN hit THEN title || ' edited' ELSE title END AS title, CASE WHEN hit THEN e ELSE content END AS content,
        CASE WHEN hit THEN sha256(e) ELSE content_hash END AS content_hash, hit <> is_enabled AS is_enabled,
        CASE WHEN hit THEN coalesce(http_status, 200) ELSE http_status END AS http_status,
        CASE WHEN hit AND origin = 'web_crawl' THEN 'manual_upload' ELSE origin END AS origin,
        CASE WHEN hit THEN {_AT_SQL} ELSE crawled_at END AS crawled_at
      FROM (SELECT *, coalesce(origin <> 'manual_upload' AND title <> '' AND e <> '', false) AS hit FROM (
        SELECT *, trim(regexp_replace(translate(content || chr(13) || chr(10) || '  end ', chr(13) || chr(10), '  '), ' +', ' ', 'g'), ' ') AS e FROM doc)))))""",
    "invalid_documents": f"""
SELECT id, CASE http_status WHEN 404 THEN 'invalid' WHEN 503 THEN 'timeout' ELSE status_code END AS status_code,
  CASE WHEN http_status = 200 THEN 200 END AS http_status, CASE WHEN http_status <> 200 THEN {_AT_SQL} ELSE crawled_at END AS crawled_at FROM doc""",
    "refreshed_sources": f"""
SELECT id, CASE WHEN is_enabled AND seed_key IS NOT NULL THEN {_AT_SQL} + to_minutes(greatest(1, id % 1000 * 30 - 60)) ELSE next_refresh END AS next_refresh,
  CASE WHEN is_enabled AND NOT is_archived AND seed_key IS NOT NULL THEN {_AT_SQL} WHEN id % 3 = 0 THEN next_refresh END AS succeeded_at FROM src""",
    "folders": """
SELECT source_id, path, h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || '-' || h[21:32] AS guid
FROM (SELECT *, sha256(source_id || '|' || path) AS h FROM (
  SELECT DISTINCT source_id, '/a/' || id % 7 || '/' || id % 3 AS path FROM doc WHERE source_id IS NOT NULL))""",
    "toggled_documents": "SELECT id, is_archived OR origin = 'web_crawl' AS is_archived FROM doc",
    "replaced_questions": """
WITH ref AS (
  SELECT q.question, r.document_id, min(r.question_id * 10 + r.position) AS rank FROM question_doc r JOIN question q ON q.id = r.question_id GROUP BY ALL
), head AS (SELECT question, row_number() OVER (ORDER BY min(rank)) AS id FROM ref GROUP BY question)
SELECT h.id AS question_id, r.document_id, r.question FROM ref r JOIN head h USING (question)""",
    "chosen_spans": """
WITH RECURSIVE span AS (
  SELECT l_orderkey AS text_id, (l_partkey % 60)::INT AS start, (l_suppkey % 25 + 1)::INT AS length, l_linenumber::INT AS priority FROM lineitem
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY start, priority, length DESC) AS place FROM span
), chosen AS (
  SELECT *, start + length AS upto, true AS taken FROM placed WHERE place = 1
  UNION ALL
  SELECT p.*, CASE WHEN p.start >= c.upto THEN p.start + p.length ELSE c.upto END, p.start >= c.upto
  FROM chosen c JOIN placed p ON p.text_id = c.text_id AND p.place = c.place + 1
)
SELECT text_id, start, length, priority FROM chosen WHERE taken""",
}
