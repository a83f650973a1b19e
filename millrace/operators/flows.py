"""Refresh of sources and redownload of documents: what a fetch makes of the store.

Each flow is a function of the present table and what was fetched, for all
sources at once. Nothing is changed in place: the next table is written beside
the present one and takes its place when it is whole, so a job that fails
leaves the store as it was, and the former table is the backup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views
from ..sources.versions import kept
from .eligibility import is_persistable, is_warning
from .store import snapshot_diff
from .upkeep import replace_crawl

CHANGES = ("added", "updated", "deleted", "unchanged")


def is_unreachable(status_code: Column, http_status: Column) -> Column:
    """A fetch that ended without an answer of the server."""
    return http_status.isNull() & F.coalesce(status_code.isin("error", "timeout"), F.lit(False))


def fetch_states(sources: DataFrame, staged: DataFrame, errors: DataFrame) -> DataFrame:
    """source_id, state, whether its documents are replaced, pages and failed pages of each of ``sources`` (id).

    ``unreachable``: errors (source_id, message) and no page that the server
    answered; ``warning``: no page, or pages beside errors; else ``completed``.
    Sources that are unreachable or without pages keep their documents.
    """
    pages = staged.groupBy("source_id").agg(
        F.count("*").alias("pages"), F.count_if(is_warning(F.col("status_code"))).alias("failed"),
        F.bool_and(is_unreachable(F.col("status_code"), F.col("http_status"))).alias("_none"),
    )
    faults = errors.groupBy("source_id").agg(F.count("*").alias("_errors"))
    all_ = sources.select(F.col("id").alias("source_id")).join(pages, "source_id", "left").join(faults, "source_id", "left")
    all_ = all_.fillna(0, ["pages", "failed", "_errors"]).fillna(True, ["_none"])
    state = (
        F.when((F.col("_errors") > 0) & F.col("_none"), "unreachable")
        .when((F.col("pages") == 0) | (F.col("_errors") > 0), "warning")
        .otherwise("completed")
    )
    rows = all_.select("source_id", state.alias("state"), "pages", "failed")
    return rows.withColumn("replaced", (F.col("state") != "unreachable") & (F.col("pages") > 0))


def _applied(staged: DataFrame, states: DataFrame) -> DataFrame:
    """Staged rows that come into the store, those that have content (_filled)."""
    found = staged.where(is_persistable(F.col("http_status"))).where("url is not null and _filled")
    return found.join(views.small_or_not(states.where("replaced").select("source_id")), "source_id", "left_semi")


def refresh(present: DataFrame, staged: DataFrame, sources: DataFrame, errors: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The documents after a refresh of ``sources``, and a result a source.

    The results count what was added, updated, deleted and left as it was, and
    the pages that failed; sources that kept their documents count nothing.
    """
    marked = staged.withColumn("_filled", F.length(F.trim("content")) > 0)
    # all but what is written into the store is told without texts
    slim = kept(marked.select("source_id", "id", "url", "status_code", "http_status", "content_hash", "_filled"), "staged")
    states = kept(fetch_states(sources, slim, errors), "states")
    new = _applied(slim, states)
    after = replace_crawl(present, _applied(marked, states).drop("_filled"), states.where("replaced").select(F.col("source_id").alias("id")), now)
    done = views.small_or_not(new.select("source_id").distinct())  # as many rows as there are sources
    old = present.where("origin = 'web_crawl' and url is not null").join(done, "source_id", "left_semi")
    counts = snapshot_diff(old, new).groupBy("source_id").agg(*[F.count_if(F.col("change") == c).alias(c) for c in CHANGES])
    results = states.join(counts, "source_id", "left").fillna(0, list(CHANGES))
    failed = F.when(F.col("replaced"), F.col("failed")).otherwise(0).alias("failed")
    return after, results.select("source_id", "state", *CHANGES, failed, (F.col("added") + F.col("updated") + F.col("deleted") > 0).alias("changed"))


def redownload(present: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """``present`` with the ``outcome`` of fetching documents anew (id, content, status_code, http_status).

    ``kept``: not fetched; ``unreachable``: the row stays as it is; ``deleted``:
    the page is gone (404, 410), and the caller drops the row; ``updated``:
    content, hash and status are new, and the time of the fetch. Of rows fetched
    twice the one with the greatest status and content counts.
    """
    got = fetched.groupBy("id").agg(F.max(F.struct("http_status", "status_code", "content")).alias("_got"))
    fresh = F.col("_got")
    outcome = (
        F.when(fresh.isNull(), "kept")
        .when(is_unreachable(fresh["status_code"], fresh["http_status"]), "unreachable")
        .when(~is_persistable(fresh["http_status"]), "deleted")
        .otherwise("updated")
    )
    values = {
        "content": fresh["content"], "content_hash": F.sha2(fresh["content"], 256), "status_code": fresh["status_code"],
        "http_status": fresh["http_status"], "crawled_at": now,
    }
    rows = present.join(got, "id", "left").withColumn("outcome", outcome)
    changed = F.col("outcome") == "updated"
    return rows.select(*[F.when(changed, values[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in present.columns], "outcome")


_NOW = "2024-03-01 00:00:00"


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp_ntz")


def q_refresh_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived sources time out, disabled ones stage nothing, and both have errors, as local ones have."""
    sources = views.sources(spark, sf_dir)
    flags = sources.select(F.col("id").alias("source_id"), "is_enabled", "is_archived")
    staged = views.incoming(spark, sf_dir).join(flags.withColumnsRenamed({"is_enabled": "_on", "is_archived": "_off"}), "source_id").where("_on")
    staged = staged.withColumns(
        {"http_status": F.when(~F.col("_off"), F.col("http_status")), "status_code": F.when(F.col("_off"), "timeout").otherwise(F.col("status_code"))}
    ).drop("_on", "_off")
    errors = sources.where("is_archived or source_type = 'local_files'").select(F.col("id").alias("source_id"), F.lit("error").alias("message"))
    return refresh(views.documents(spark, sf_dir), staged, sources, errors, _now())[1]


def q_redownloaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the second snapshot are fetched: those without a status time out."""
    status = F.when(F.col("http_status").isNull(), "timeout").when(F.col("http_status") == 200, "ok").otherwise("error")
    fetched = views.incoming(spark, sf_dir).select("id", "content", status.alias("status_code"), "http_status")
    after = redownload(views.documents(spark, sf_dir), fetched, _now())
    return after.select("id", "outcome", "content_hash", "status_code", "http_status", "crawled_at")


QUERIES = {"refresh_results": q_refresh_results, "redownloaded_documents": q_redownloaded_documents}

ORACLES = {
    "refresh_results": """
WITH fetched AS (
  SELECT i.source_id, i.key, i.id, i.content, i.content_hash, CASE WHEN s.is_archived THEN 'timeout' ELSE i.status_code END AS status_code,
    CASE WHEN NOT s.is_archived THEN i.http_status END AS http_status
  FROM incoming i JOIN src s ON s.id = i.source_id WHERE s.is_enabled
), state AS (
  SELECT s.id AS source_id, count(f.source_id) AS pages, count(*) FILTER (f.status_code <> 'ok') AS failed,
    CASE WHEN (s.is_archived OR s.source_type = 'local_files')
        AND coalesce(bool_and(f.http_status IS NULL AND f.status_code IN ('error', 'timeout')) FILTER (f.source_id IS NOT NULL), true) THEN 'unreachable'
      WHEN count(f.source_id) = 0 OR s.is_archived OR s.source_type = 'local_files' THEN 'warning' ELSE 'completed' END AS state
  FROM src s LEFT JOIN fetched f ON f.source_id = s.id GROUP BY s.id, s.is_archived, s.source_type
), new AS (
  SELECT f.* FROM fetched f JOIN state USING (source_id) WHERE state <> 'unreachable' AND coalesce(http_status NOT IN (404, 410), true)
    AND key IS NOT NULL AND length(trim(content, ' ')) > 0
  QUALIFY row_number() OVER (PARTITION BY source_id, key ORDER BY id DESC) = 1
), old AS (
  SELECT * FROM doc WHERE origin = 'web_crawl' AND url IS NOT NULL AND source_id IN (SELECT source_id FROM new)
), change AS (
  SELECT coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted'
    WHEN o.content_hash = n.content_hash AND o.status_code IS NOT DISTINCT FROM n.status_code AND o.http_status IS NOT DISTINCT FROM n.http_status
    THEN 'unchanged' ELSE 'updated' END AS change
  FROM old o FULL JOIN new n ON o.source_id = n.source_id AND o.key = n.key
), counts AS (
  SELECT source_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated,
    count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'unchanged') AS unchanged FROM change GROUP BY source_id
)
SELECT source_id, state, coalesce(added, 0) AS added, coalesce(updated, 0) AS updated, coalesce(deleted, 0) AS deleted,
  coalesce(unchanged, 0) AS unchanged, CASE WHEN state <> 'unreachable' AND pages > 0 THEN failed ELSE 0 END AS failed,
  coalesce(added + updated + deleted > 0, false) AS changed FROM state LEFT JOIN counts USING (source_id)""",
    "redownloaded_documents": f"""
SELECT id, outcome, CASE WHEN outcome = 'updated' THEN new_hash ELSE content_hash END AS content_hash,
  CASE WHEN outcome = 'updated' THEN CASE http_status WHEN 200 THEN 'ok' ELSE 'error' END ELSE status_code END AS status_code, http_status,
  CASE WHEN outcome = 'updated' THEN TIMESTAMP '{_NOW}' ELSE crawled_at END AS crawled_at FROM (
  SELECT d.*, n.content_hash AS new_hash, CASE WHEN n.id IS NULL THEN 'kept' WHEN d.http_status IS NULL THEN 'unreachable'
    WHEN d.http_status IN (404, 410) THEN 'deleted' ELSE 'updated' END AS outcome
  FROM doc d LEFT JOIN incoming n ON n.id = d.id)""",
}
