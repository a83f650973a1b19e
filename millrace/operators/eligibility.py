"""Eligibility rules, source roll-ups and the joins of documents and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import preview
from ..sources import views

#: Run time of the due query; a job passes its own.
NOW = "2024-01-01 12:00:00"


def is_active(d: DataFrame) -> Column:
    """Flags and status of a document; its source is not asked."""
    return d["is_enabled"] & ~d["is_archived"] & (d["status_code"] == "ok")


def is_due(next_refresh: Column, now: Column) -> Column:
    return next_refresh.isNull() | (next_refresh <= now)


def is_persistable(http_status: Column) -> Column:
    """Not gone: an unknown status is kept."""
    return F.coalesce(~http_status.isin(404, 410), F.lit(True))


def is_warning(status: Column) -> Column:
    return ~F.lower(F.trim(status)).eqNullSafe(F.lit("ok"))


def with_source(docs: DataFrame, sources: DataFrame, how: str = "left") -> DataFrame:
    """Documents with the name, type and flags of their source, which is broadcast if it is small."""
    dim = sources.select(
        F.col("id").alias("source_id"),
        F.col("name").alias("source_name"),
        "source_type",
        F.col("is_enabled").alias("source_enabled"),
        F.col("is_archived").alias("source_archived"),
    )
    return docs.join(views.small_or_not(dim, 256), "source_id", how)


def source_counts(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Every source with its documents and active documents; counted before the join."""
    counts = docs.groupBy("source_id").agg(
        F.count("id").alias("document_count"), F.count_if(is_active(docs)).alias("active_document_count")
    )
    joined = sources.join(counts, sources["id"] == counts["source_id"], "left").drop("source_id")
    return joined.fillna(0, ["document_count", "active_document_count"])


def usable(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Active documents with content whose source is missing or active."""
    active = docs.where(is_active(docs) & (F.length(F.trim("content")) > 0))
    joined = with_source(active, sources)
    return joined.where("source_name is null or (source_enabled and not source_archived)")


def displayable(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Active documents of active sources."""
    return with_source(docs.where(is_active(docs)), sources, "inner").where("source_enabled and not source_archived")


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.documents(spark, sf_dir), views.sources(spark, sf_dir)


def q_source_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sources = _model(spark, sf_dir)
    counted = source_counts(sources, docs)
    return counted.select("id", "name", "address", "document_count", "active_document_count").orderBy("name", "address")


def q_active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.sources(spark, sf_dir)
    return sources.where("is_enabled and not is_archived and source_type = 'web_site'").select("id", "name", "address")


def q_due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.sources(spark, sf_dir).where("is_enabled and not is_archived and seed_key is not null")
    due = sources.where(is_due(F.col("next_refresh"), F.lit(NOW).cast("timestamp_ntz")))
    return due.select("id", "name", "next_refresh").orderBy(F.asc_nulls_first("next_refresh"), "name")


def q_usable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = usable(*_model(spark, sf_dir))
    return found.select("id", "url", "title", "source_name", "content_hash", "crawled_at").orderBy(
        F.desc("crawled_at"), "url"
    )


def q_displayable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = displayable(*_model(spark, sf_dir))
    label = F.coalesce(F.nullif("title", F.lit("")), F.nullif("url", F.lit("")), F.lit("document"))
    return found.select("id", label.alias("label"), "source_name", preview(F.col("content"), F.col("title"), "-").alias("preview"))


def q_listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sources = _model(spark, sf_dir)
    return with_source(docs, sources).select("id", "source_name", "title", "url", "status_code").orderBy(
        F.asc_nulls_first("source_name"), F.asc_nulls_first("title"), "url"
    )


def q_persistable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir)
    return docs.where(is_persistable(F.col("http_status"))).select("id", "http_status", is_warning(F.col("status_code")).alias("warns"))


def q_source_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source's crawl failed to reach it, and whether to try again."""
    docs = views.documents(spark, sf_dir).where("source_id is not null")
    no_status = F.col("http_status").isNull()
    temporary = F.coalesce(F.col("http_status").isin(408, 429, 502, 503, 504), F.lit(False))
    pages = docs.groupBy("source_id").agg(
        F.count_if(is_warning(F.col("status_code"))).alias("warning_count"),
        F.bool_and(no_status & F.col("status_code").isin("error", "timeout")).alias("unreachable"),
        F.bool_or((F.col("status_code") == "ok") & ~temporary).alias("_any_ok"),
        F.bool_and(temporary).alias("_all_temporary"),
    )
    retry = ~F.col("_any_ok") & (F.col("unreachable") | F.col("_all_temporary"))
    return pages.select("source_id", "warning_count", "unreachable", retry.alias("should_retry"))


def q_batch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload checks of each source's documents as one batch: 100 files, 25 MB each, 250 MB in all."""
    docs = views.documents(spark, sf_dir).where("source_id is not null")
    size = F.octet_length("content")
    sums = docs.groupBy("source_id").agg(
        F.count("*").alias("files"), F.max(size).cast("long").alias("largest"), F.sum(size).cast("long").alias("total")
    )
    ok = (F.col("files") <= 100) & (F.col("largest") <= 25 << 20) & (F.col("total") <= 250 << 20)
    return sums.withColumn("accepted", ok)


def q_duplicate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal content, by hash."""
    docs = views.documents(spark, sf_dir)
    groups = docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    return groups.where("copies > 1")


QUERIES = {
    "source_document_counts": q_source_document_counts,
    "active_sources": q_active_sources,
    "due_sources": q_due_sources,
    "usable_documents": q_usable_documents,
    "displayable_documents": q_displayable_documents,
    "listed_documents": q_listed_documents,
    "persistable_documents": q_persistable_documents,
    "source_reachability": q_source_reachability,
    "batch_limits": q_batch_limits,
    "duplicate_documents": q_duplicate_urls,
}

_PREVIEW = r"""CASE WHEN length(c) <= 260 THEN c ELSE rtrim(left(c, 260), ' ') || '...' END"""
_ACTIVE = "d.is_enabled AND NOT d.is_archived AND d.status_code = 'ok'"
ORACLES = {
    "source_document_counts": f"""
SELECT s.id, s.name, s.address, count(d.id) AS document_count, count(*) FILTER ({_ACTIVE}) AS active_document_count
FROM src s LEFT JOIN doc d ON d.source_id = s.id GROUP BY ALL""",
    "active_sources": "SELECT id, name, address FROM src WHERE is_enabled AND NOT is_archived AND source_type = 'web_site'",
    "due_sources": f"""SELECT id, name, next_refresh FROM src WHERE is_enabled AND NOT is_archived AND seed_key IS NOT NULL
AND (next_refresh IS NULL OR next_refresh <= TIMESTAMP '{NOW}')""",
    "usable_documents": f"""
SELECT d.id, d.url, d.title, s.name AS source_name, d.content_hash, d.crawled_at FROM doc d LEFT JOIN src s ON s.id = d.source_id
WHERE {_ACTIVE} AND length(trim(d.content, ' ')) > 0 AND (s.id IS NULL OR (s.is_enabled AND NOT s.is_archived))""",
    "displayable_documents": rf"""
SELECT id, coalesce(nullif(title, ''), nullif(url, ''), 'document') AS label, source_name, {_PREVIEW} AS preview FROM (
  SELECT d.id, d.title, d.url, s.name AS source_name,
    trim(regexp_replace(translate(d.content, chr(13) || chr(10), '  '), ' +', ' ', 'g'), ' ') AS c
  FROM doc d JOIN src s ON s.id = d.source_id WHERE {_ACTIVE} AND s.is_enabled AND NOT s.is_archived)""",
    "listed_documents": """
SELECT d.id, s.name AS source_name, d.title, d.url, d.status_code FROM doc d LEFT JOIN src s ON s.id = d.source_id""",
    "persistable_documents": """
SELECT id, http_status, NOT (lower(trim(status_code)) IS NOT DISTINCT FROM 'ok') AS warns FROM doc
WHERE http_status IS NULL OR http_status NOT IN (404, 410)""",
    "source_reachability": """
SELECT source_id, warning_count, unreachable, NOT any_ok AND (unreachable OR all_temporary) AS should_retry FROM (
  SELECT source_id, count(*) FILTER (status_code <> 'ok') AS warning_count,
    bool_and(http_status IS NULL AND status_code IN ('error', 'timeout')) AS unreachable,
    bool_or(status_code = 'ok' AND coalesce(http_status, 0) NOT IN (408, 429, 502, 503, 504)) AS any_ok,
    bool_and(coalesce(http_status, 0) IN (408, 429, 502, 503, 504)) AS all_temporary
  FROM doc WHERE source_id IS NOT NULL GROUP BY source_id)""",
    "batch_limits": """
SELECT *, files <= 100 AND largest <= 26214400 AND total <= 262144000 AS accepted FROM (
  SELECT source_id, count(*) AS files, max(strlen(content))::BIGINT AS largest, sum(strlen(content))::BIGINT AS total
  FROM doc WHERE source_id IS NOT NULL GROUP BY source_id)""",
    "duplicate_documents": """
SELECT content_hash, count(*) AS copies, min(id) AS first_id FROM doc GROUP BY content_hash HAVING count(*) > 1""",
}
