"""Refreshes of a versioned set of tables: attempts, replacement, redownload by kind of source, and what stays when one fails.

A flow reads one version of the set (`sources.versions`), makes the tables of the
next and commits them together. What fails on the way leaves the version that
was current, which is the restore; only the state of the sources is then told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import retry_seconds
from ..functions.urls import key_of
from ..sources import views
from ..sources.versions import Conflict, TableSet, failed, kept, scratch
from .edits import after_refresh
from .eligibility import is_persistable, is_warning
from .flows import is_unreachable, refresh
from .retrieve import blocks
from .store import upsert_by_origin, without_missing
from .upkeep import delete_crawled

#: Attempts after the first, at most.
RETRIES = 3
#: HTTP states that may pass.
PASSING = (408, 429, 502, 503, 504)


def is_final(pages: Column, ok: Column, errors: Column, unanswered: Column, passing: Column) -> Column:
    """Whether a crawl's outcome is to be taken as it is: pages, those of them that are ok, unanswered or of a passing state, and errors.

    Tried again is what has no page that is ok and either errors without any
    answered page, or nothing but pages of a passing state.
    """
    unreachable = (errors > 0) & (unanswered == pages)
    return (ok > 0) | ~(unreachable | ((pages > 0) & (passing == pages)))


def final_attempts(attempts: DataFrame, retries: int = RETRIES) -> DataFrame:
    """source_id, attempts made, the last of them (its attempt), whether it is final by itself, and wait_s, seconds from the first to it.

    ``attempts`` has source_id, attempt (a number that grows) and final. They
    are taken in order up to the first that is final, ``retries`` + 1 at most;
    what the log has beyond them was not tried. Between them lies the wait of
    `labels.retry_seconds`, so each is due when those before it have passed.
    """
    one = F.struct("attempt", "final")
    # bounded: no more than can be tried
    listed = attempts.groupBy("source_id").agg(F.slice(F.array_sort(F.collect_list(one)), 1, retries + 1).alias("log"))
    start = F.struct(F.lit(0).alias("made"), F.lit(None).cast("long").alias("attempt"), F.lit(False).alias("final"), F.lit(0.0).alias("wait_s"))

    def step(state: Column, a: Column) -> Column:
        wait = F.when(state["made"] == 0, 0.0).otherwise(state["wait_s"] + retry_seconds(state["made"] - 1))
        tried = F.struct((state["made"] + 1).alias("made"), a["attempt"].cast("long").alias("attempt"), a["final"].alias("final"), wait.alias("wait_s"))
        return F.when(state["final"], state).otherwise(tried)

    return listed.select("source_id", F.aggregate("log", start, step).alias("s")).select(
        "source_id", F.col("s.made").alias("attempts"), F.col("s.attempt").alias("attempt"), F.col("s.final").alias("final"), F.col("s.wait_s").alias("wait_s")
    )


def refresh_set(store: TableSet, staged: DataFrame, errors: DataFrame, now: Column, backup: str = "refresh") -> DataFrame:
    """Refreshes the due sources of a set (documents, sources, blocks) from ``staged`` pages and commits the next version.

    The result of each source as `flows.refresh` gives it, with a message; if
    the commit fails, all of them are ``failed`` with what failed, documents and
    blocks are those of before, and sources are due again after their period.
    """
    known = store.read()
    sources = known["sources"]
    base = store.current()
    store.backup(backup)
    ended = lambda of, ok: of.select(F.col("source_id").alias("id"), ok.alias("ok"), F.lit(60).alias("period_minutes"))
    told = F.when(F.col("state") == "completed", F.when(F.col("changed"), "updated").otherwise("nothing changed")).otherwise(F.col("state"))
    try:
        after, results = refresh(known["documents"], staged, sources, errors, now)
        done = kept(results.withColumn("message", told), "results")
        fresh = after_refresh(sources, ended(done, F.col("state") == "completed"), now)
        store.commit({"documents": after, "sources": fresh, "blocks": lambda made: blocks(made["documents"], sources)}, base)
    except Conflict:
        raise
    except Exception as e:
        all_ = sources.select(F.col("id").alias("source_id"))
        store.commit({"sources": after_refresh(sources, ended(all_, F.lit(False)), now)}, base)
        none = {c: F.lit(0).cast("long") for c in ("added", "updated", "deleted", "unchanged", "failed")}
        done = all_.select("source_id", F.lit("failed").alias("state"), *[v.alias(c) for c, v in none.items()], F.lit(False).alias("changed"), F.lit(failed(e)).alias("message"))
    store.drop_backups_except(backup)
    return done


def redownload_sources(docs: DataFrame, sources: DataFrame, fetched: DataFrame, errors: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The documents after the sources were fetched anew, by their kind, and a result a source.

    ``fetched`` has the columns of ``docs``, ``errors`` source_id and message.
    Web sites: pages are upserted but those that are gone (404, 410), and what
    the site no longer has is deleted; a site with errors and no answered page
    keeps all. Links: each document that isn't archived and was answered is
    upserted as it is now, its flags kept, whatever its state. Files are rebuilt
    from their archive and stay here. Results: documents fetched (for links all
    of them), warnings and errors; a source that was reached and gives none has
    one warning more.
    """
    kinds = sources.select(F.col("id").alias("source_id"), F.col("source_type").alias("_kind"))
    pages = fetched.where("url is not null").join(views.small_or_not(kinds, 64), "source_id")
    unanswered = is_unreachable(F.col("status_code"), F.col("http_status"))
    faulty = errors.groupBy("source_id").agg(F.count("*").alias("_errors"))
    seen = pages.groupBy("source_id").agg(
        F.count("*").alias("_pages"), F.bool_and(unanswered).alias("_none"), F.count_if(unanswered | is_warning(F.col("status_code"))).alias("_bad")
    )
    states = kinds.join(seen, "source_id", "left").join(faulty, "source_id", "left").fillna(0, ["_pages", "_errors", "_bad"]).fillna(True, ["_none"])
    site = F.col("_kind") == "web_site"
    states = states.withColumn("_reached", ~((F.col("_errors") > 0) & F.col("_none")))
    reached = states.where(site & F.col("_reached")).select("source_id")

    columns = [c for c in docs.columns if c != "origin"]
    crawled = pages.where((F.col("_kind") == "web_site") & is_persistable(F.col("http_status"))).join(views.small_or_not(reached), "source_id", "left_semi")
    crawled = crawled.select(*columns, F.lit("web_crawl").alias("origin"))
    own = docs.where("not is_archived").select("source_id", key_of(F.col("url")).alias("_key")).distinct()
    links = pages.where((F.col("_kind") == "web_links") & ~unanswered).withColumn("_key", key_of(F.col("url")))
    links = links.join(own, ["source_id", "_key"], "left_semi").select(*columns, F.lit("manual_web_link").alias("origin"))
    batch = crawled.unionByName(links).withColumn("crawled_at", now.cast(docs.schema["crawled_at"].dataType))
    after = upsert_by_origin(docs, batch.select(*docs.columns), docs).drop("change")
    after = without_missing(after, crawled, reached.select(F.col("source_id").alias("id")))

    held = docs.groupBy("source_id").agg(F.count("*").alias("_held"))
    found = states.join(held, "source_id", "left").fillna(0, ["_held"])
    n = F.when(site, F.when(F.col("_reached"), F.col("_pages")).otherwise(0)).otherwise(F.col("_held"))
    bad = F.when(F.col("_kind") == "web_links", F.col("_bad")).otherwise(0)
    warnings = F.when(site & ~F.col("_reached"), 1).otherwise(bad + F.when(n == 0, 1).otherwise(0))
    faults = F.when(site & F.col("_reached"), F.col("_errors")).otherwise(0)
    return after, found.select(
        "source_id", F.col("_kind").alias("source_type"), n.cast("long").alias("documents"), warnings.cast("long").alias("warnings"), faults.cast("long").alias("errors")
    )


def redownload_all(store: TableSet, fetched: DataFrame, errors: DataFrame, now: Column, backup: str = "redownload") -> DataFrame:
    """Clears a set's crawled documents and all that is made of them, fills it from ``fetched`` pages, and commits it.

    One row: state (``succeeded``; ``failed_restored`` if nothing was fetched or
    the commit failed, which leaves the set as it was), documents, errors and a
    message: the first three errors, or what failed.
    """
    known, base = store.read(), store.current()
    store.backup(backup)
    docs = known["documents"]
    batch = fetched.where("url is not null").select(*docs.columns).withColumn("crawled_at", now.cast(docs.schema["crawled_at"].dataType))
    after = upsert_by_origin(delete_crawled(docs), batch, docs).drop("change")
    told = errors.agg(F.count("*").alias("errors"), F.array_join(F.slice(F.array_sort(F.collect_set(F.substring("message", 1, 500))), 1, 3), " | ").alias("message"))
    spark, state, why = store.spark, "succeeded", None
    try:
        if batch.isEmpty():
            raise ValueError("nothing was fetched")
        cleared = {n: known[n].limit(0) for n in ("questions", "question_documents") if n in known}
        store.commit({"documents": after, "blocks": lambda made: blocks(made["documents"], known["sources"])} | cleared, base)
    except Conflict:
        raise
    except Exception as e:
        state, why = "failed_restored", failed(e)
    store.drop_backups_except(backup)
    # one row each
    total = store.read()["documents"].agg(F.count("*").alias("documents")).withColumn("state", F.lit(state))
    return total.crossJoin(told).select("state", "documents", "errors", F.coalesce(F.lit(why), F.nullif("message", F.lit(""))).alias("message"))


def _now() -> Column:
    return F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")


def _blocks(made: dict[str, DataFrame]) -> DataFrame:
    return blocks(made["documents"], made["sources"])


def _at(spark: SparkSession) -> TableSet:
    return TableSet(spark, scratch(spark, "set"))


def q_attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts of their users' sources, in order of time; every figure of an attempt comes from its number."""
    n = F.col("event_id")
    pages, errors = n % 4, n % 3
    ok = F.when(n % 5 == 0, F.least(pages, F.lit(1))).otherwise(0)
    unanswered = F.when(n % 7 < 3, pages).otherwise(0)
    passing = F.when(n % 7 >= 5, pages).otherwise(0)
    log = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), n.alias("attempt"), is_final(pages, ok, errors, unanswered, passing).alias("final"))
    return final_attempts(log)


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second snapshot as it was fetched: one page in nine was not answered."""
    rows = views.incoming(spark, sf_dir)
    lost = F.col("id") % 9 == 0
    return rows.withColumns({"http_status": F.when(~lost, F.col("http_status")), "status_code": F.when(lost, "timeout").otherwise(F.col("status_code"))})


def _errors(sources: DataFrame) -> DataFrame:
    return sources.where("id % 4 < 2").select(F.col("id").alias("source_id"), F.concat(F.lit("error "), "name").alias("message"))


def q_redownloaded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by source; half of them have errors, and one site of three isn't answered at all."""
    return _redownloaded(spark, sf_dir)[1]


def q_redownloaded_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all sources were fetched anew."""
    return _redownloaded(spark, sf_dir)[0].select("id", "source_id", "url", "origin", "status_code", "content_hash", "crawled_at")


def _redownloaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sources, fetched = views.sources(spark, sf_dir), _fetched(spark, sf_dir)
    silent = F.col("source_id") % 9 == 4
    fetched = fetched.withColumns(
        {"http_status": F.when(~silent, F.col("http_status")), "status_code": F.when(silent, "error").otherwise(F.col("status_code"))}
    )
    return redownload_sources(views.documents(spark, sf_dir), sources, fetched, _errors(sources), _now())


def q_versioned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels replaced together: written, a writer failing between the two, replaced, cleared, restored, retained."""
    columns = ["id", "source_id", "url", "origin", "content_hash"]
    docs, staged = (v(spark, sf_dir).select(*columns) for v in (views.documents, views.incoming))
    labels = views.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    store, rows = _at(spark), []

    def look(step: str) -> None:
        found, version = store.read(), store.current()
        for name, column in (("documents", "id"), ("labels", "doc_id")):
            least = F.min("content_hash") if name == "documents" else F.lit(None).cast("string")
            n, total, text = found[name].agg(F.count("*"), F.sum(column), least).first()
            rows.append((step, version, name, n, total, text))

    store.commit({"documents": docs, "labels": labels})
    look("written")
    store.backup("first")
    try:
        store.commit({"documents": staged, "labels": labels.withColumn("toxic", F.raise_error(F.lit("lost")).cast("long"))})
    except Exception as e:
        assert "lost" in str(e)
    look("failed")
    store.commit({"documents": staged, "labels": labels.where("quality = 1")})
    look("replaced")
    store.commit({"documents": delete_crawled(staged), "labels": labels.limit(0)})
    look("cleared")
    store.restore("first")
    look("restored")
    store.retain(last=1, grace_s=0)
    look("retained")
    rows += [("kept", v, "-", None, None, None) for v in store.versions()]
    return spark.createDataFrame(rows, "step string, version int, table_name string, rows long, ids long, least_hash string")


def q_refreshed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh that fails while its documents are written, then the same without the fault: results of both."""
    sources, staged = views.sources(spark, sf_dir), _fetched(spark, sf_dir)
    store = _at(spark)
    docs = views.documents(spark, sf_dir)
    store.commit({"documents": docs, "sources": sources.withColumn("succeeded_at", F.lit(None).cast("timestamp_ntz")), "blocks": _blocks})
    none = _errors(sources).limit(0)
    broken = staged.withColumn("title", F.raise_error(F.lit("a page is broken")).cast("string"))
    first = refresh_set(store, broken, none, _now())
    kept = store.read()["documents"].agg(F.count("*").alias("documents"))
    second = refresh_set(store, staged, none, _now())
    after = store.read()["documents"].agg(F.count("*").alias("documents"))
    columns = ("source_id", "state", "added", "updated", "deleted", "unchanged", "failed")
    told = [r.select(F.lit(i).alias("run"), *columns).crossJoin(n) for i, r, n in ((1, first, kept), (2, second, after))]  # one row each
    return told[0].unionByName(told[1])


def q_redownloaded_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full redownload of nothing, which leaves the set, and one of the second snapshot."""
    sources, docs = views.sources(spark, sf_dir), views.documents(spark, sf_dir)
    store = _at(spark)
    store.commit({"documents": docs, "sources": sources, "blocks": _blocks, "questions": views.questions(spark, sf_dir)})
    fetched, errors = _fetched(spark, sf_dir), _errors(sources)
    first = redownload_all(store, fetched.limit(0), errors, _now()).withColumn("questions", F.lit(0).cast("long"))
    second = redownload_all(store, fetched, errors, _now())
    left = store.read()["questions"].agg(F.count("*").alias("questions"))  # one row
    return first.unionByName(second.crossJoin(left))


QUERIES = {
    "attempt_log": q_attempt_log,
    "redownloaded_sources": q_redownloaded_sources,
    "redownloaded_by_kind": q_redownloaded_by_kind,
    "versioned_tables": q_versioned_tables,
    "refreshed_set": q_refreshed_set,
    "redownloaded_set": q_redownloaded_set,
}

_AT = "TIMESTAMP '2024-03-01 00:00:00'"
_FETCHED = """fetched AS (
  SELECT * REPLACE (CASE WHEN id % 9 = 0 THEN NULL ELSE http_status END AS http_status, CASE WHEN id % 9 = 0 THEN 'timeout' ELSE status_code END AS status_code)
  FROM incoming)"""
_SILENT = f"""{_FETCHED}, page AS (
  SELECT f.* REPLACE (CASE WHEN f.source_id % 9 = 4 THEN NULL ELSE http_status END AS http_status,
    CASE WHEN f.source_id % 9 = 4 THEN 'error' ELSE status_code END AS status_code), s.source_type, s.id % 4 < 2 AS has_error
  FROM fetched f JOIN src s ON s.id = f.source_id WHERE f.url IS NOT NULL
), asked AS (
  SELECT *, http_status IS NULL AND coalesce(status_code IN ('error', 'timeout'), false) AS unanswered FROM page
), state AS (
  SELECT s.id AS source_id, s.source_type, s.id % 4 < 2 AS has_error, count(a.id) AS pages,
    NOT (s.id % 4 < 2 AND coalesce(bool_and(a.unanswered), true)) AS reached,
    count(*) FILTER (a.unanswered OR a.status_code <> 'ok') AS bad FROM src s LEFT JOIN asked a ON a.source_id = s.id GROUP BY s.id, s.source_type
)"""
_SUMS = "count(*) AS rows, sum({}) AS ids, {} AS least_hash"
_DOCS, _LABELS = _SUMS.format("id", "min(content_hash)"), _SUMS.format("doc_id", "NULL")


def _step(step: str, version: int, docs: str, labels: str) -> str:
    return f"""SELECT '{step}' AS step, {version} AS version, 'documents' AS table_name, {_DOCS} FROM {docs}
UNION ALL SELECT '{step}', {version}, 'labels', {_LABELS} FROM {labels}"""


ORACLES = {
    "attempt_log": """
WITH a AS (
  SELECT user_id AS source_id, event_id AS n, event_id % 4 AS pages, event_id % 3 AS errors,
    CASE WHEN event_id % 5 = 0 THEN least(event_id % 4, 1) ELSE 0 END AS ok FROM events
), judged AS (
  SELECT *, ok > 0 OR NOT ((errors > 0 AND (pages = 0 OR n % 7 < 3)) OR (pages > 0 AND n % 7 >= 5)) AS final,
    row_number() OVER (PARTITION BY source_id ORDER BY n) AS nth FROM a
), tried AS (
  SELECT *, max(CASE WHEN final THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over
  FROM judged WHERE nth <= 4
)
SELECT source_id, count(*)::INT AS attempts, max(n) AS attempt, bool_or(final) AS final, 5.0::DOUBLE * (pow(2, count(*) - 1) - 1) AS wait_s
FROM tried WHERE coalesce(over, 0) = 0 GROUP BY source_id""",
    "redownloaded_sources": f"""
WITH {_SILENT}, held AS (SELECT source_id, count(*) AS held FROM doc GROUP BY source_id)
SELECT source_id, source_type, n AS documents,
  CASE WHEN source_type = 'web_site' AND NOT reached THEN 1 ELSE (CASE WHEN source_type = 'web_links' THEN bad ELSE 0 END) + (n = 0)::INT END AS warnings,
  CASE WHEN source_type = 'web_site' AND reached AND has_error THEN 1 ELSE 0 END::BIGINT AS errors
FROM (SELECT s.*, CASE WHEN source_type <> 'web_site' THEN coalesce(held, 0) WHEN reached THEN pages ELSE 0 END AS n
  FROM state s LEFT JOIN held USING (source_id))""",
    "redownloaded_by_kind": f"""
WITH {_SILENT}, batch AS (
  SELECT a.*, 'web_crawl' AS new_origin FROM asked a JOIN state s USING (source_id)
  WHERE a.source_type = 'web_site' AND s.reached AND coalesce(http_status NOT IN (404, 410), true)
  UNION ALL
  SELECT a.*, 'manual_web_link' FROM asked a WHERE source_type = 'web_links' AND NOT unanswered
    AND EXISTS (SELECT 1 FROM doc d WHERE d.source_id = a.source_id AND d.key = a.key AND NOT d.is_archived)
), kept AS (
  SELECT d.id, d.source_id, d.url, d.key, d.origin, CASE WHEN hit THEN b.status_code ELSE d.status_code END AS status_code,
    CASE WHEN hit THEN b.content_hash ELSE d.content_hash END AS content_hash, CASE WHEN hit THEN {_AT} ELSE d.crawled_at END AS crawled_at
  FROM (SELECT d.*, b.new_origin = d.origin AS hit FROM doc d LEFT JOIN batch b USING (key)) d LEFT JOIN batch b USING (key)
), new AS (
  SELECT (SELECT max(id) FROM doc) + row_number() OVER (ORDER BY md5(key)) AS id, source_id,
    CASE WHEN id % 5 = 3 THEN replace(key, '/new', '/NEW') ELSE key END AS url, key, new_origin AS origin, status_code, content_hash, {_AT} AS crawled_at
  FROM batch b WHERE NOT EXISTS (SELECT 1 FROM doc d WHERE d.key = b.key)
)
SELECT id, source_id, url, origin, status_code, content_hash, crawled_at FROM (SELECT * FROM kept UNION ALL SELECT * FROM new) x
WHERE NOT (origin = 'web_crawl' AND coalesce(source_id IN (SELECT source_id FROM state WHERE source_type = 'web_site' AND reached), false)
  AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.key = x.key AND b.new_origin = 'web_crawl'))""",
    "versioned_tables": f"""
{_step("written", 1, "doc", "labels")}
UNION ALL {_step("failed", 1, "doc", "labels")}
UNION ALL {_step("replaced", 2, "incoming", "labels WHERE quality = 1")}
UNION ALL {_step("cleared", 3, "incoming WHERE origin IS DISTINCT FROM 'web_crawl'", "labels WHERE false")}
UNION ALL {_step("restored", 4, "doc", "labels")}
UNION ALL {_step("retained", 4, "doc", "labels")}
UNION ALL SELECT 'kept', unnest([1, 4]), '-', NULL, NULL, NULL""",
    "refreshed_set": f"""
WITH {_FETCHED}, state AS (
  SELECT s.id AS source_id, count(f.id) AS pages, count(*) FILTER (f.status_code <> 'ok') AS failed FROM src s LEFT JOIN fetched f ON f.source_id = s.id GROUP BY s.id
), new AS (
  SELECT * FROM fetched WHERE source_id IS NOT NULL AND coalesce(http_status NOT IN (404, 410), true) AND key IS NOT NULL AND length(trim(content, ' ')) > 0
), old AS (SELECT * FROM doc WHERE origin = 'web_crawl' AND url IS NOT NULL AND source_id IN (SELECT source_id FROM new)
), change AS (
  SELECT coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted'
    WHEN o.content_hash = n.content_hash AND o.status_code IS NOT DISTINCT FROM n.status_code AND o.http_status IS NOT DISTINCT FROM n.http_status
    THEN 'unchanged' ELSE 'updated' END AS change
  FROM old o FULL JOIN new n ON o.source_id = n.source_id AND o.key = n.key
), counts AS (
  SELECT source_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated,
    count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'unchanged') AS unchanged FROM change GROUP BY source_id
)
SELECT 1 AS run, id AS source_id, 'failed' AS state, 0 AS added, 0 AS updated, 0 AS deleted, 0 AS unchanged, 0 AS failed, (SELECT count(*) FROM doc) AS documents FROM src
UNION ALL
SELECT 2, source_id, CASE WHEN pages = 0 THEN 'warning' ELSE 'completed' END, coalesce(added, 0), coalesce(updated, 0), coalesce(deleted, 0), coalesce(unchanged, 0), failed,
  (SELECT count(*) FROM doc) - (SELECT count(*) FROM old) + (SELECT count(*) FROM new) FROM state LEFT JOIN counts USING (source_id)""",
    "redownloaded_set": f"""
WITH {_FETCHED}, fault AS (SELECT 'error ' || name AS message FROM src WHERE id % 4 < 2)
SELECT 'failed_restored' AS state, (SELECT count(*) FROM doc) AS documents, (SELECT count(*) FROM fault) AS errors, 'nothing was fetched' AS message, 0 AS questions
UNION ALL SELECT 'succeeded', (SELECT count(*) FROM (
    SELECT key FROM doc WHERE origin IS DISTINCT FROM 'web_crawl' UNION SELECT key FROM fetched WHERE key IS NOT NULL)),
  (SELECT count(*) FROM fault), (SELECT string_agg(message, ' | ' ORDER BY message) FROM (SELECT * FROM fault ORDER BY message LIMIT 3)), 0""",
}
