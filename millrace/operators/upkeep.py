"""Upkeep of the store: snapshot replacement, deletes, runs, defaults, refresh gates and block caches.

Each function takes the present table and the changes and gives the next
version of the table, to be written beside the old one. Empty changes leave
the table as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_white, cut
from ..functions.urls import canonical, key_of, title_of
from ..sources import views
from ..sources.versions import kept
from .ids import deal_ids
from .questions import TARGET
from .retrieve import blocks
from .store import last_by_key

#: Below so many questions they are always made anew; fewer than that are not accepted.
LEAST_QUESTIONS = 80
#: Fixed value: the preview of a document without text.
NO_PREVIEW = "Bu belge için önizleme henüz oluşturulamadı."


def replace_crawl(present: DataFrame, staged: DataFrame, refreshed: DataFrame, now: Column) -> DataFrame:
    """``present`` after the crawled rows of the sources in ``refreshed`` (id) gave way to those ``staged``.

    Only ``web_crawl`` rows go; a source without any staged row with content keeps
    what it has. URLs are compared and stored as the store keeps them: canonical,
    and compared without case, within a source; the last staged row of one
    counts, by id. Staged rows without a URL are left out, blank titles are made
    of the URL. New rows keep the time when their URL was ``first_seen``
    (``crawled_at`` where the table has none), are ``last_seen`` and
    ``last_checked`` now, and get ids that follow the greatest one present.

    Ids and times are made for keys alone and joined where the rows of a key
    are, so staged texts are shuffled once and present ones not at all.
    """
    stamps = ("first_seen", "last_seen", "last_checked")
    present = present.withColumns({c: F.col("crawled_at") for c in stamps if c not in present.columns})
    names = [c for c in present.columns if c not in ("source_id", *stamps)]
    of = views.small_or_not(refreshed.select(F.col("id").alias("source_id")).distinct())
    filled = staged.where("url is not null and length(trim(content)) > 0").join(of, "source_id", "left_semi")
    if "title" in names:
        filled = filled.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), title_of(canonical(F.col("url")))))
    key = F.struct("source_id", key_of(F.col("url")).alias("url"))
    last = last_by_key(filled.select(key.alias("_key"), "source_id", *names), "_key", "id")
    keys = kept(filled.select(key.alias("_key")), "staged_keys").distinct()
    done = keys.select(F.col("_key.source_id").alias("source_id"), F.lit(True).alias("_done")).distinct()  # as many rows as there are sources

    marked = present.join(views.small_or_not(done), "source_id", "left")
    goes = F.coalesce((F.col("origin") == "web_crawl") & F.col("_done"), F.lit(False))
    before = marked.where(goes & F.col("url").isNotNull()).groupBy(key.alias("_key")).agg(F.min("first_seen").alias("_seen"))
    dealt = deal_ids(keys, [F.col("_key.source_id"), F.col("_key.url")], present)
    fixed = {"url": canonical(F.col("url")), "origin": F.lit("web_crawl"), "crawled_at": now}
    new = last.drop("id").join(dealt, "_key").join(before, "_key", "left").select(
        "source_id",
        *[fixed[c].cast(present.schema[c].dataType).alias(c) if c in fixed else F.col(c) for c in names],
        F.coalesce("_seen", now).alias("first_seen"),
        now.alias("last_seen"),
        now.alias("last_checked"),
    )
    return marked.where(~goes).select(*new.columns).unionByName(new)


def delete_documents(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``gone``."""
    return docs.join(gone.select("id"), "id", "left_anti")


def delete_crawled(docs: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """``docs`` without crawled rows: those of ``urls`` (url), compared canonical, or all. Rows of other origins, or of none, stay."""
    crawled = F.col("origin").eqNullSafe(F.lit("web_crawl"))
    if urls is None:
        return docs.where(~crawled)
    named = urls.select(canonical(F.col("url")).alias("_url"))
    return docs.join(named, crawled & (canonical(F.col("url")) == F.col("_url")), "left_anti")


def complete_runs(started: DataFrame, completed: DataFrame) -> DataFrame:
    """``started`` (run_id, started_at) with what the last completion of each run says; ``running`` without one.

    ``completed`` has run_id, completed_at, status, pages, errors and warnings;
    counts of a running run are 0.
    """
    last = last_by_key(completed, "run_id", "completed_at")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pages", "errors", "warnings")]
    return started.join(last, "run_id", "left").select(
        "run_id", "started_at", "completed_at", F.coalesce("status", F.lit("running")).alias("status"), *counts
    )


def insert_absent(present: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """``present``, and those ``defaults`` whose key it lacks."""
    return present.unionByName(defaults.join(present.select(key), key, "left_anti").select(*present.columns))


def refresh_needed(available: Column, stored: Column, current: Column, force: Column) -> Column:
    """Whether questions are made anew: when forced, too few, or made for other documents."""
    return F.coalesce(force, F.lit(False)) | (available < LEAST_QUESTIONS) | ~stored.eqNullSafe(current)


def accepted(made: Column, force: Column) -> Column:
    """Whether as many new questions may replace the old ones."""
    return made >= F.when(force, TARGET).otherwise(LEAST_QUESTIONS)


def refresh_cache(cache: DataFrame, current: DataFrame, key: str, content: str) -> DataFrame:
    """What bringing a cache up to date does, a row a key: kept, rebuilt, added or dropped.

    Keys are unique on both sides. With no current rows all are dropped.
    """
    old = cache.select(key, F.col(content).alias("_old"), F.lit(True).alias("_cached"))
    new = current.select(key, F.col(content).alias("_new"), F.lit(True).alias("_current"))
    action = (
        F.when(F.col("_cached").isNull(), "added")
        .when(F.col("_current").isNull(), "dropped")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "kept")
        .otherwise("rebuilt")
    )
    return old.join(new, key, "full_outer").select(key, action.alias("action"), F.col("_new").alias(content))


def citation_title(title: Column, file_name: Column, relative_path: Column, url: Column) -> Column:
    """The first of title, file name and path that isn't blank, else the title that the URL gives."""
    whole = [F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit("")) for c in (title, file_name, relative_path)]
    return F.coalesce(*whole, title_of(url))


def document_preview(content: Column, message: Column) -> Column:
    """The content collapsed and cut, the status message where it is blank, or a fixed text."""
    text = F.coalesce(F.nullif(collapse_white(content), F.lit("")), F.nullif(collapse_white(message), F.lit("")))
    return cut(F.coalesce(text, F.lit(NO_PREVIEW)), 260)


def q_replaced_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three sources are refreshed; one address in seven comes twice, in another case."""
    staged = views.incoming(spark, sf_dir)
    again = staged.where("id % 7 = 0").withColumns({"id": F.col("id") + 20_000_000, "url": F.upper("url"), "content_hash": F.reverse("content_hash")})
    refreshed = views.sources(spark, sf_dir).where("source_type <> 'local_files'")
    now = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    whole = replace_crawl(views.documents(spark, sf_dir), staged.unionByName(again), refreshed, now)
    return whole.select("id", "source_id", "url", "title", "origin", "content_hash", "status_code", "first_seen", "last_seen", "last_checked", "crawled_at")


def q_deleted_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir)
    return delete_crawled(docs, views.incoming(spark, sf_dir)).select("id", "url", "origin")


def q_cleared_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete_crawled(views.documents(spark, sf_dir)).groupBy("origin").agg(F.count("*").alias("documents"))


def q_deleted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents but those of archived or disabled sources."""
    docs = views.documents(spark, sf_dir)
    off = views.sources(spark, sf_dir).where("is_archived or not is_enabled").select(F.col("id").alias("source_id"))
    return delete_documents(docs, docs.join(off, "source_id", "left_semi")).select("id", "source_id", "url")


def q_completed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that complete once for each of their events of status ok, all of them starting at their first event."""
    runs = views.runs(spark, sf_dir)
    started = runs.groupBy("run_id").agg(F.min("completed_at").alias("started_at"))
    ends = runs.where("status = 'ok' and run_id % 10 <> 0").groupBy("run_id", "completed_at").agg(
        F.max("status").alias("status"), F.sum("added_count").alias("pages"),
        F.sum("failed_count").alias("errors"), F.count_if(F.col("changed")).alias("warnings"),
    )
    return complete_runs(started, ends)


def q_ensured_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of seeded sources, and of the others the default."""
    sources = views.sources(spark, sf_dir)
    present = sources.where("seed_key is not null").select("name", "address", F.col("seed_key").alias("value"))
    return insert_absent(present, sources.select("name", "address", F.lit("default").alias("value")), "name")


def q_refresh_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a bank of its own: as many questions as documents, made for its least content hash."""
    banks = views.documents(spark, sf_dir).groupBy("source_id").agg(
        F.count("*").alias("available"), F.min("content_hash").alias("stored"),
        F.when(F.coalesce(F.col("source_id") % 2, F.lit(0)) == 0, F.max("content_hash")).otherwise(F.min("content_hash")).alias("current"),
    )
    force = F.coalesce(F.col("source_id") % 3, F.lit(0)) == 1
    needed = refresh_needed(F.col("available"), F.col("stored"), F.col("current"), force)
    return banks.select("source_id", "available", needed.alias("needed"), accepted(F.col("available"), force).alias("accepted"))


def q_refreshed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache holds the blocks of the first snapshot; the second is current."""
    sources = views.sources(spark, sf_dir)
    old, new = (blocks(docs(spark, sf_dir), sources) for docs in (views.documents, views.incoming))
    return refresh_cache(old, new, "document_id", "content_hash")


def q_citation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents in four have a blank title, two of them no file name, one neither path."""
    docs = views.documents(spark, sf_dir)
    n = F.col("id") % 4
    title = F.when(n == 0, F.concat(F.lit(" "), "title", F.lit("\n"))).otherwise(F.lit(" \t"))
    file = F.when(n == 1, F.concat("id", F.lit(".pdf "))).otherwise(F.lit(""))
    place = F.when(n == 2, F.concat(F.lit("a/"), "id"))
    content = F.when(n == 3, F.lit("\n\t ")).otherwise(F.col("content"))
    message = F.when(F.col("id") % 8 == 3, F.concat(F.lit("status  "), "status_code"))
    return docs.select(
        "id", citation_title(title, file, place, F.col("url")).alias("title"), document_preview(content, message).alias("preview")
    )


QUERIES = {
    "replaced_crawl": q_replaced_crawl,
    "deleted_by_url": q_deleted_by_url,
    "cleared_crawl": q_cleared_crawl,
    "deleted_documents": q_deleted_documents,
    "completed_runs": q_completed_runs,
    "ensured_defaults": q_ensured_defaults,
    "refresh_gate": q_refresh_gate,
    "refreshed_blocks": q_refreshed_blocks,
    "citation_titles": q_citation_titles,
}

_CACHED = """SELECT d.id AS document_id, d.content_hash FROM {} d LEFT JOIN src s ON s.id = d.source_id
  WHERE NOT d.is_archived AND d.status_code = 'ok' AND length(trim(d.content, ' ')) > 0 AND d.source_id IS NOT NULL
    AND (s.id IS NULL OR NOT s.is_archived)"""
ORACLES = {
    "replaced_crawl": """
WITH twice AS (
  SELECT id, source_id, key, title, content, content_hash, status_code, id % 5 = 3 OR id % 7 = 0 AS shouts FROM incoming
  UNION ALL SELECT id + 20000000, source_id, key, title, content, reverse(content_hash), status_code, true FROM incoming WHERE id % 7 = 0
), staged AS (
  SELECT t.* FROM twice t JOIN src s ON s.id = t.source_id
  WHERE s.source_type <> 'local_files' AND t.key IS NOT NULL AND length(trim(t.content, ' ')) > 0
  QUALIFY row_number() OVER (PARTITION BY t.source_id, t.key ORDER BY t.id DESC) = 1
), gone AS (
  SELECT * FROM doc WHERE origin = 'web_crawl' AND source_id IN (SELECT source_id FROM staged)
), seen AS (SELECT source_id, key, min(crawled_at) AS first_seen FROM gone GROUP BY ALL)
SELECT id, source_id, url, title, origin, content_hash, status_code, crawled_at AS first_seen, crawled_at AS last_seen,
  crawled_at AS last_checked, crawled_at
FROM doc WHERE id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT (SELECT max(id) FROM doc) + row_number() OVER (ORDER BY md5(t.source_id || '|' || t.key)), t.source_id,
  CASE WHEN shouts THEN replace(t.key, '/new', '/NEW') ELSE t.key END, t.title, 'web_crawl', t.content_hash, t.status_code,
  coalesce(s.first_seen, TIMESTAMP '2025-01-01'), TIMESTAMP '2025-01-01', TIMESTAMP '2025-01-01', TIMESTAMP '2025-01-01'
FROM staged t LEFT JOIN seen s ON s.source_id = t.source_id AND s.key = t.key""",
    "deleted_by_url": """
SELECT id, url, origin FROM doc d WHERE origin IS DISTINCT FROM 'web_crawl' OR NOT EXISTS (SELECT 1 FROM incoming i WHERE i.key = d.key)""",
    "cleared_crawl": "SELECT origin, count(*) AS documents FROM doc WHERE origin IS DISTINCT FROM 'web_crawl' GROUP BY origin",
    "deleted_documents": """
SELECT d.id, d.source_id, d.url FROM doc d LEFT JOIN src s ON s.id = d.source_id WHERE s.id IS NULL OR (s.is_enabled AND NOT s.is_archived)""",
    "completed_runs": """
WITH ends AS (
  SELECT run_id, completed_at, max(status) AS status, sum(added_count)::BIGINT AS pages, sum(failed_count)::BIGINT AS errors,
    count(*) FILTER (changed) AS warnings FROM run WHERE status = 'ok' AND run_id % 10 <> 0 GROUP BY run_id, completed_at
), final AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY completed_at DESC) = 1
), started AS (SELECT run_id, min(completed_at) AS started_at FROM run GROUP BY run_id)
SELECT run_id, started_at, completed_at, coalesce(status, 'running') AS status, coalesce(pages, 0) AS pages,
  coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM started LEFT JOIN final USING (run_id)""",
    "ensured_defaults": "SELECT name, address, coalesce(seed_key, 'default') AS value FROM src",
    "refresh_gate": """
WITH bank AS (
  SELECT source_id, count(*) AS available, min(content_hash) AS low, max(content_hash) AS high, coalesce(source_id % 3, 0) = 1 AS force
  FROM doc GROUP BY source_id)
SELECT source_id, available,
  force OR available < 80 OR (coalesce(source_id % 2, 0) = 0 AND low IS DISTINCT FROM high) AS needed,
  available >= CASE WHEN force THEN 100 ELSE 80 END AS accepted FROM bank""",
    "refreshed_blocks": f"""
WITH was AS ({_CACHED.format("doc")}), now AS ({_CACHED.format("incoming")})
SELECT coalesce(w.document_id, n.document_id) AS document_id, CASE WHEN w.document_id IS NULL THEN 'added'
  WHEN n.document_id IS NULL THEN 'dropped' WHEN w.content_hash = n.content_hash THEN 'kept' ELSE 'rebuilt' END AS action, n.content_hash
FROM was w FULL JOIN now n ON n.document_id = w.document_id""",
    "citation_titles": f"""
WITH whole AS (
  SELECT id, source_id, url, title, CASE WHEN id % 4 = 3 THEN NULL ELSE nullif(trim(regexp_replace(content, '\\s+', ' ', 'g'), ' '), '') END AS text,
    CASE WHEN id % 8 = 3 THEN 'status ' || status_code END AS message FROM doc
), cased AS (SELECT id, url, title, coalesce(text, message, '{NO_PREVIEW}') AS text FROM whole)
SELECT id, CASE id % 4 WHEN 0 THEN coalesce(nullif(trim(title, ' '), ''), regexp_extract(url, '[^/]+$')) WHEN 1 THEN id || '.pdf' WHEN 2 THEN 'a/' || id
    ELSE regexp_extract(url, '[^/]+$') END AS title,
  CASE WHEN length(text) <= 260 THEN text ELSE rtrim(left(text, 260), ' ') || '...' END AS preview FROM cased""",
}
