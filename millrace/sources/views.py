"""The knowledge model over the landed tables: documents, sources, questions and runs.

Every view is a plain projection, so column pruning and filters reach the scan.
``SQL`` holds the same definitions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Epoch of all derived times; jobs take their run time as a parameter, never the clock.
EPOCH = "2024-01-01 00:00:00"
#: Most bytes of a side that may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20


def small_or_not(side: DataFrame, row_bytes: int = 16) -> DataFrame:
    """``side`` to be broadcast if its rows are few enough, counted, so that the texts of the other side stay where they are."""
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_id(name: Column) -> Column:
    """The id of a source: 60 bits of its name's MD5, so that a document tells it without a join."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source dimension: a row for each distinct source name."""
    names = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("name")).distinct()
    numbered = names.select("name", source_id(F.col("name")).alias("id"))
    kind = F.when(F.col("id") % 3 == 0, "local_files").when(F.col("id") % 3 == 1, "web_site").otherwise("web_links")
    return numbered.select(
        "id",
        "name",
        F.concat(F.lit("https://"), "name", F.lit(".example")).alias("address"),
        kind.alias("source_type"),
        (F.col("id") % 7 != 0).alias("is_enabled"),
        (F.col("id") % 11 == 10).alias("is_archived"),
        F.when(F.col("id") % 4 != 3, F.concat(F.lit("seed-"), "id")).alias("seed_key"),
        F.when(F.col("id") % 5 != 0, F.timestamp_add("hour", (F.col("id") % 1000).cast("int"), F.lit(EPOCH).cast("timestamp_ntz"))).alias(
            "next_refresh"
        ),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main fact: a row for each document, with its source id, joined to its labels."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = docs.join(small_or_not(labels), "doc_id", "left")
    origin = F.element_at(
        F.array(*map(F.lit, ("web_crawl", "manual_web_link", "local_import", "manual_upload"))),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    return rows.select(
        F.col("doc_id").alias("id"),
        source_id(F.col("source")).alias("source_id"),
        F.concat(F.lit("https://www."), "source", F.lit(".example/"), "doc_id").alias("url"),
        F.concat("source", F.lit(" "), "lang").alias("title"),
        F.col("text").alias("content"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("is_enabled"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("is_archived"),
        F.when(F.length(F.trim("text")) > 0, "ok").otherwise("empty_content").alias("status_code"),
        F.when(F.col("doc_id") % 17 == 0, 404).when(F.col("doc_id") % 19 == 0, 503).when(F.col("doc_id") % 5 != 0, 200).alias(
            "http_status"
        ),
        F.sha2("text", 256).alias("content_hash"),
        origin.alias("origin"),
        F.timestamp_add("minute", (F.col("doc_id") % 10000).cast("int"), F.lit(EPOCH).cast("timestamp_ntz")).alias("crawled_at"),
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second snapshot of the crawl: some documents gone, some changed, some new.

    Addresses are spelled in several ways, as they are found.
    """
    docs = documents(spark, sf_dir)
    changed = F.when(F.col("id") % 5 == 0, F.concat("content", F.lit(" updated"))).otherwise(F.col("content"))
    first = docs.where("id % 13 <> 0").withColumn("content", changed)
    new = docs.where("id % 29 = 0").withColumns(
        {"id": F.col("id") + 10_000_000, "url": F.concat("url", F.lit("/new"))}
    )
    both = first.unionByName(new).withColumn("content_hash", F.sha2("content", 256))
    n, url = F.col("id") % 5, F.col("url")
    spelled = (
        F.when(n == 1, F.replace(url, F.lit("www."), F.lit(""))).when(n == 2, F.concat(url, F.lit("/")))
        .when(n == 3, F.upper(url)).when(n == 4, F.concat(url, F.lit("//?x=1#top"))).otherwise(url)
    )
    return both.withColumn("url", spelled)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested questions: benchmark items with rotation counters."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(
        F.col("item_id").alias("id"),
        F.col("text").alias("question"),
        (F.col("item_id") * 7 % 5).alias("served_count"),
        F.timestamp_add("minute", F.col("item_id").cast("int"), F.lit(EPOCH).cast("timestamp_ntz")).alias("created_at"),
        F.sha2(F.col("item_id").cast("string"), 256).alias("fingerprint"),
    )


def question_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three of all documents for each question (none for every ninth), by modular arithmetic."""
    items = table(spark, sf_dir, "benchmark").where("item_id % 9 <> 8")
    k = F.explode(F.sequence(F.lit(0), (F.col("item_id") % 3).cast("int"))).alias("position")
    refs = items.select(F.col("item_id").alias("question_id"), k)
    ids = table(spark, sf_dir, "documents").agg((F.coalesce(F.max("doc_id"), F.lit(0)) + 1).alias("_ids"))
    # one row
    refs = refs.crossJoin(ids).withColumn("document_id", (F.col("question_id") * 7919 + F.col("position") * 17) % F.col("_ids"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), source_id(F.col("source")).alias("source_id"))
    return refs.join(docs, "document_id", "left").select("question_id", "position", "document_id", "source_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh results of sources: events, with status, counts and messages."""
    event = table(spark, sf_dir, "events")
    n = F.col("event_id")
    status = F.when(n % 37 == 0, "failed").when(n % 11 == 0, "warning").when(n % 13 == 0, "unreachable").otherwise("ok")
    return event.select(
        n.alias("id"),
        (F.col("user_id") % 50).alias("run_id"),
        status.alias("status"),
        *[(n % m).alias(f"{c}_count") for c, m in (("added", 5), ("updated", 3), ("deleted", 2), ("unchanged", 7), ("failed", 4))],
        (n % 6 == 0).alias("changed"),
        F.concat(F.lit("source "), n.cast("string"), F.lit(" "), status).alias("message"),
        F.col("ts").alias("completed_at"),
    )


#: The same views as DuckDB common table expressions; ``key`` is what stands for a URL, known from how the URLs are made.
SQL = """
src AS (
  SELECT id, name, 'https://' || name || '.example' AS address,
    CASE id % 3 WHEN 0 THEN 'local_files' WHEN 1 THEN 'web_site' ELSE 'web_links' END AS source_type,
    id % 7 <> 0 AS is_enabled, id % 11 = 10 AS is_archived,
    CASE WHEN id % 4 <> 3 THEN 'seed-' || id END AS seed_key,
    CASE WHEN id % 5 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(id % 1000) END AS next_refresh
  FROM (SELECT DISTINCT ('0x' || substr(md5(source), 1, 15))::BIGINT AS id, source AS name FROM documents WHERE source IS NOT NULL)
), doc AS (
  SELECT d.doc_id AS id, s.id AS source_id, 'https://www.' || d.source || '.example/' || d.doc_id AS url,
    d.source || ' ' || d.lang AS title, d.text AS content,
    coalesce(l.quality, 1) = 1 AS is_enabled, coalesce(l.toxic, 0) = 1 AS is_archived,
    CASE WHEN length(trim(d.text, ' ')) > 0 THEN 'ok' ELSE 'empty_content' END AS status_code,
    CASE WHEN d.doc_id % 17 = 0 THEN 404 WHEN d.doc_id % 19 = 0 THEN 503 WHEN d.doc_id % 5 <> 0 THEN 200 END AS http_status,
    sha256(d.text) AS content_hash,
    (['web_crawl', 'manual_web_link', 'local_import', 'manual_upload'])[d.doc_id % 4 + 1] AS origin,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id % 10000) AS crawled_at, 'https://' || d.source || '.example/' || d.doc_id AS key
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN src s ON s.name = d.source
), incoming AS (
  SELECT * REPLACE (sha256(content) AS content_hash, CASE id % 5 WHEN 1 THEN replace(url, 'www.', '') WHEN 2 THEN url || '/'
    WHEN 3 THEN upper(url) WHEN 4 THEN url || '//?x=1#top' ELSE url END AS url) FROM (
    SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN content || ' updated' ELSE content END AS content) FROM doc WHERE id % 13 <> 0
    UNION ALL
    SELECT * REPLACE (id + 10000000 AS id, url || '/new' AS url, key || '/new' AS key) FROM doc WHERE id % 29 = 0)
), question AS (
  SELECT item_id AS id, text AS question, item_id * 7 % 5 AS served_count,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(item_id) AS created_at, sha256(item_id::VARCHAR) AS fingerprint FROM benchmark
), question_doc AS (
  SELECT q.question_id, q.position, q.document_id, d.source_id FROM (
    SELECT item_id AS question_id, position, (item_id * 7919 + position * 17) % (SELECT coalesce(max(doc_id), 0) + 1 FROM documents) AS document_id
    FROM (SELECT item_id, unnest(range(0, item_id % 3 + 1)) AS position FROM benchmark WHERE item_id % 9 <> 8)) q
  LEFT JOIN doc d ON d.id = q.document_id
), run AS (
  SELECT event_id AS id, user_id % 50 AS run_id, status, event_id % 5 AS added_count, event_id % 3 AS updated_count,
    event_id % 2 AS deleted_count, event_id % 7 AS unchanged_count, event_id % 4 AS failed_count, event_id % 6 = 0 AS changed,
    'source ' || event_id || ' ' || status AS message, ts AS completed_at
  FROM (SELECT *, CASE WHEN event_id % 37 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'warning'
    WHEN event_id % 13 = 0 THEN 'unreachable' ELSE 'ok' END AS status FROM events)
)
"""
