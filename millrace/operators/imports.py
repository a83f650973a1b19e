"""Imports: sources for new addresses, manual documents, uploaded files, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, urls
from ..functions.text import collapse_spaces, folder_path, guid_of, relative_path
from ..sources import views


def ensure_sources(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources (name, address) that ``documents`` (url) need and ``sources`` lack, a row a host."""
    hosts = documents.select(urls.canonical(F.col("url"), with_path=False).alias("address"), urls.host(F.col("url")).alias("name"))
    wanted = hosts.where("name <> ''").groupBy("name").agg(F.min("address").alias("address"))
    present = sources.select(urls.host(F.col("address")).alias("name"))
    return wanted.join(present, "name", "left_anti")


def add_manual(docs: DataFrame, new: DataFrame) -> DataFrame:
    """What comes of manual documents (url, title, content): added, duplicate or empty, and their collapsed content.

    Of rows with one URL the first by title is added.
    """
    keyed = new.select(urls.canonical(F.col("url")).alias("url"), "title", collapse_spaces(F.col("content")).alias("content"))
    one = keyed.groupBy("url").agg(F.min(F.struct("title", "content")).alias("r")).select("url", "r.*")
    known = docs.select(urls.canonical(F.col("url")).alias("url")).distinct().withColumn("_known", F.lit(True))
    state = F.when(F.coalesce("content", F.lit("")) == "", "empty").when(F.col("_known"), "duplicate").otherwise("added")
    return one.join(known, "url", "left").select("url", "title", state.alias("outcome"), F.sha2("content", 256).alias("content_hash"))


def import_files(files: DataFrame, present: DataFrame) -> DataFrame:
    """Parsed ``files`` (source_id, path, text, error) against ``present`` (source_id, path, content_hash).

    A row each: folder, guids that key and folder give, hash, and whether it was
    imported, updated, unchanged, skipped as empty or failed.
    """
    keyed = files.withColumn("path", relative_path(F.col("path")))
    last = keyed.groupBy("source_id", "path").agg(F.max(F.struct("text", "error")).alias("r")).select("source_id", "path", "r.*")
    old = present.select("source_id", relative_path(F.col("path")).alias("path"), F.col("content_hash").alias("_old")).dropDuplicates(["source_id", "path"])
    digest = F.sha2("text", 256)
    outcome = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "skipped")
        .when(F.col("_old").isNull(), "imported")
        .when(F.col("_old") == digest, "unchanged")
        .otherwise("updated")
    )
    key = lambda c: guid_of(F.concat_ws("|", F.col("source_id").cast("string"), c))
    return last.join(old, ["source_id", "path"], "left").select(
        "source_id", "path", folder_path(F.col("path")).alias("folder"), key(F.col("path")).alias("document_guid"),
        key(folder_path(F.col("path"))).alias("folder_guid"), digest.alias("content_hash"), outcome.alias("outcome"),
    )


def lookup(rows: DataFrame, **values) -> DataFrame:
    """Rows with these values, the filters pushed to the scan; nulls match nulls."""
    found = rows
    for column, value in values.items():
        found = found.where(F.col(column).eqNullSafe(F.lit(value)))
    return found


def by_url(docs: DataFrame, url: str) -> DataFrame:
    return docs.where(urls.canonical(F.col("url")) == urls.canonical(F.lit(url)))


def clashing(docs: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows of ``moved`` (id, url) whose URL another document has."""
    keyed = docs.select(F.col("id").alias("_id"), urls.canonical(F.col("url")).alias("_url"))
    target = urls.canonical(F.col("url"))
    return moved.join(keyed, (target == F.col("_url")) & (F.col("id") != F.col("_id")), "left_semi")


def _path() -> Column:
    return F.concat(F.lit("dir"), (F.col("id") % 3).cast("string"), F.lit("//./f"), (F.col("id") % 400).cast("string"), F.lit(".md"))


def q_ensured_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensure_sources(views.sources(spark, sf_dir), views.table(spark, sf_dir, "pages"))


def q_manual_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document added again under its URL, empty under another and whole under a third."""
    docs = views.documents(spark, sf_dir)
    again = docs.select(F.concat("url", F.lit("/?x=1")).alias("url"), "title", "content")
    empty = docs.select(F.concat("url", F.lit("/empty")).alias("url"), "title", F.lit(" \n").alias("content"))
    fresh = docs.select(F.concat("url", F.lit("//fresh/")).alias("url"), "title", F.concat("content", F.lit(" new  text")).alias("content"))
    return add_manual(docs, again.union(empty).union(fresh))


def q_imported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file, blank or unreadable for some; those imported before are present."""
    docs = views.documents(spark, sf_dir).where("source_id is not null")
    files = docs.select(
        "source_id", _path().alias("path"), F.when(F.col("id") % 8 != 0, F.col("content")).otherwise(" ").alias("text"),
        F.when(F.col("http_status") == 503, "unreadable").alias("error"),
    )
    present = docs.where("origin = 'local_import'").select("source_id", _path().alias("path"), F.when(F.col("is_enabled"), F.col("content_hash")).otherwise("old").alias("content_hash"))
    firsts = present.groupBy("source_id", "path").agg(F.min("content_hash").alias("content_hash"))
    return import_files(files, firsts)


def q_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.sources(spark, sf_dir)
    kind = F.col("source_type")
    return sources.select(
        "id", labels.source_type(F.concat(F.lit(" "), F.upper(kind))).alias("kind"),
        labels.default_source_name(kind, F.col("address")).alias("default_name"),
        labels.addition_mode(kind).alias("addition"), labels.open_mode(kind).alias("opening"),
        labels.retry_seconds(F.col("id") % 6).alias("retry"),
    )


def q_clashing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir)
    url = F.concat(F.lit("https://www.src"), (F.col("id") - F.col("id") % 3) % 20, F.lit(".example/"), F.col("id") - F.col("id") % 3)
    return clashing(docs, docs.select("id", url.alias("url"))).select("id")


QUERIES = {
    "ensured_sources": q_ensured_sources,
    "manual_documents": q_manual_documents,
    "imported_files": q_imported_files,
    "labels": q_labels,
    "clashing_urls": q_clashing_urls,
}

_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?#]*)', 1)), ':\\d*$', ''), '^www\\.', '')"
_GUID = "h{0}[7:8] || h{0}[5:6] || h{0}[3:4] || h{0}[1:2] || '-' || h{0}[11:12] || h{0}[9:10] || '-' || h{0}[15:16] || h{0}[13:14] || '-' || h{0}[17:20] || '-' || h{0}[21:32]"
_FILE = "'dir' || id % 3 || '/f' || id % 400 || '.md'"
ORACLES = {
    "ensured_sources": f"""
SELECT name, min(scheme || '://' || name) AS address FROM (
  SELECT {_HOST} AS name, lower(regexp_extract(url, '^((?i:https?))://', 1)) AS scheme FROM pages)
WHERE name <> '' AND name NOT IN (SELECT name || '.example' FROM src) GROUP BY name""",
    "manual_documents": """
WITH new AS (
  SELECT replace(url, 'https://www.', 'https://') AS url, title, content, 'duplicate' AS known FROM doc
  UNION ALL SELECT replace(url, 'https://www.', 'https://') || '/empty', title, ' ', 'added' FROM doc
  UNION ALL SELECT replace(url, 'https://www.', 'https://') || '/fresh', title, content || ' new  text', 'added' FROM doc
)
SELECT url, title, CASE WHEN coalesce(c, '') = '' THEN 'empty' ELSE known END AS outcome, sha256(c) AS content_hash
FROM (SELECT *, trim(regexp_replace(translate(content, chr(13) || chr(10), '  '), ' +', ' ', 'g'), ' ') AS c FROM new)""",
    "imported_files": f"""
WITH file AS (
  SELECT source_id, path, arg_max(text, (text, coalesce(error, ''))) AS text, nullif(arg_max(coalesce(error, '-'), (text, coalesce(error, ''))), '-') AS error FROM (
    SELECT source_id, {_FILE} AS path, CASE WHEN id % 8 <> 0 THEN content ELSE ' ' END AS text,
      CASE WHEN http_status = 503 THEN 'unreadable' END AS error FROM doc WHERE source_id IS NOT NULL)
  GROUP BY ALL
), old AS (
  SELECT source_id, {_FILE} AS path, min(CASE WHEN is_enabled THEN content_hash ELSE 'old' END) AS old
  FROM doc WHERE source_id IS NOT NULL AND origin = 'local_import' GROUP BY ALL
)
SELECT source_id, path, folder, {_GUID.format(1)} AS document_guid, {_GUID.format(2)} AS folder_guid, content_hash,
  CASE WHEN error IS NOT NULL THEN 'failed' WHEN trim(text, ' ') = '' THEN 'skipped' WHEN old IS NULL THEN 'imported'
    WHEN old = content_hash THEN 'unchanged' ELSE 'updated' END AS outcome
FROM (SELECT *, sha256(text) AS content_hash, '/' || string_split(path, '/')[1] AS folder, sha256(source_id || '|' || path) AS h1,
    sha256(source_id || '|/' || string_split(path, '/')[1]) AS h2 FROM file LEFT JOIN old USING (source_id, path))""",
    "labels": """
SELECT id, source_type AS kind, CASE source_type WHEN 'local_files' THEN 'Yerel Dosyalar' WHEN 'web_links' THEN 'Web Bağlantıları'
    ELSE name || '.example' END AS default_name,
  CASE source_type WHEN 'web_site' THEN 'automatic' ELSE 'manual' END AS addition,
  CASE source_type WHEN 'local_files' THEN 'document_viewer' ELSE 'external' END AS opening,
  least(60.0, 5 * pow(2.0, id % 6))::DOUBLE AS retry FROM src""",
    "clashing_urls": """
SELECT m.id FROM (SELECT id, 'https://www.src' || (id - id % 3) % 20 || '.example/' || (id - id % 3) AS url FROM doc) m
WHERE EXISTS (SELECT 1 FROM doc d WHERE d.url = m.url AND d.id <> m.id)""",
}
