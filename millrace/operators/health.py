"""Roll-ups of refresh runs, status ladders and the latest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import views
from .eligibility import usable
from .questions import eligible, metadata
from .retrieve import tree_fingerprint

#: From best to worst, as two statuses combine to the worse.
LADDER = ("ready", "ready_with_warnings", "warming_up", "degraded")


def roll_up(results: DataFrame) -> DataFrame:
    """A row a run over its sources' results: sums, any change, failures, warnings, status, first three errors.

    Of a run's error messages the three of least id are kept, so a run of any
    size holds no more than that.
    """
    sums = results.groupBy("run_id").agg(
        F.count("*").alias("sources"),
        *[F.sum(f"{c}_count").alias(c) for c in ("added", "updated", "deleted", "unchanged", "failed")],
        F.bool_or("changed").alias("changed"),
        F.count_if(F.col("status") == "failed").alias("failed_sources"),
        F.count_if(F.col("status").isin("warning", "unreachable")).alias("warning_sources"),
    )
    status = (
        F.when(F.col("failed_sources") > 0, "failed").when(F.col("warning_sources") > 0, "completed_with_warnings").otherwise("completed")
    )
    # each task keeps three rows of a run before they are shuffled
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("id", "message"))
    failed = results.where("status = 'failed'").select("run_id", "id", "message").withColumn("_nth", nth).where("_nth <= 3")
    listed = F.array_sort(F.collect_list(F.struct("_nth", "message")))
    digests = failed.groupBy("run_id").agg(F.array_join(F.transform(listed, lambda m: m["message"]), " | ").alias("_errors"))
    errors = F.coalesce("_errors", F.lit("")).alias("errors")
    return sums.withColumn("status", status).join(digests, "run_id", "left").select(*sums.columns, "status", errors)


def knowledge_status(run_status: Column, pages: Column, run_pages: Column, warnings: Column, questions: Column, agree: Column) -> Column:
    """running: warming_up; nothing, or a failed run without pages: degraded; any defect: ready_with_warnings; else ready.

    ``agree``: whether cache and questions were made for the same documents; null, no cache, is a defect.
    """
    return (
        F.when(run_status == "running", "warming_up")
        .when((pages == 0) | ((run_status == "failed") & (run_pages == 0)), "degraded")
        .when((warnings > 0) | (questions == 0) | ~F.coalesce(agree, F.lit(False)), "ready_with_warnings")
        .otherwise("ready")
    )


def worse(a: Column, b: Column) -> Column:
    ladder = F.array(*map(F.lit, LADDER))
    return F.element_at(ladder, F.greatest(F.array_position(ladder, a), F.array_position(ladder, b)).cast("int"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def q_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(views.runs(spark, sf_dir))


def q_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = views.runs(spark, sf_dir).select("run_id", "id", "status", "completed_at")
    return latest(runs, "run_id", ["completed_at", "id"])


def q_health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of the knowledge bank after each run: one-row facts beside the runs.

    Every fourth run has another cache than the newest questions', every ninth none.
    """
    docs, sources = views.documents(spark, sf_dir), views.sources(spark, sf_dir)
    found = usable(docs, sources)
    pages = found.agg(F.count("*").alias("pages"))
    asked = metadata(eligible(views.questions(spark, sf_dir), views.question_documents(spark, sf_dir), docs, sources)).select("available", "fingerprint")
    facts = pages.crossJoin(asked)  # one row each
    runs = roll_up(views.runs(spark, sf_dir)).crossJoin(F.broadcast(facts))
    run_status = F.when(F.col("run_id") % 10 == 0, "running").otherwise(F.col("status"))
    cached = F.when(F.col("run_id") % 4 == 0, "other").when(F.col("run_id") % 9 != 0, F.col("fingerprint"))
    status = knowledge_status(
        run_status, F.col("pages"), F.col("added") + F.col("updated") + F.col("unchanged"),
        F.col("warning_sources") + F.col("failed_sources"), F.col("available"), cached == F.col("fingerprint"),
    )
    api = F.when(F.col("run_id") % 3 == 0, "ready_with_warnings").otherwise("ready")
    return runs.select("run_id", status.alias("knowledge"), worse(status, api).alias("overall"), "pages", "available")


def q_tree_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = usable(views.documents(spark, sf_dir), views.sources(spark, sf_dir))
    return tree_fingerprint(found, "id", "content_hash")


QUERIES = {
    "run_rollup": q_run_rollup,
    "latest_runs": q_latest_runs,
    "health_status": q_health_status,
    "tree_fingerprint": q_tree_fingerprint,
}

_ROLL = """roll AS (
  SELECT run_id, count(*) AS sources, sum(added_count)::BIGINT AS added, sum(updated_count)::BIGINT AS updated,
    sum(deleted_count)::BIGINT AS deleted, sum(unchanged_count)::BIGINT AS unchanged, sum(failed_count)::BIGINT AS failed,
    bool_or(changed) AS changed, count(*) FILTER (status = 'failed') AS failed_sources,
    count(*) FILTER (status IN ('warning', 'unreachable')) AS warning_sources,
    CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed'
      WHEN count(*) FILTER (status IN ('warning', 'unreachable')) > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status,
    coalesce(array_to_string((list(message ORDER BY id) FILTER (status = 'failed'))[1:3], ' | '), '') AS errors
  FROM run GROUP BY run_id)"""
ORACLES = {
    "run_rollup": f"WITH {_ROLL} SELECT * FROM roll",
    "latest_runs": """
SELECT run_id, id, status, completed_at FROM run QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY completed_at DESC, id DESC) = 1""",
    "health_status": f"""
WITH {_ROLL}, fact AS (
  SELECT (SELECT count(*) FROM doc d LEFT JOIN src s ON s.id = d.source_id WHERE d.is_enabled AND NOT d.is_archived AND d.status_code = 'ok'
      AND length(trim(d.content, ' ')) > 0 AND (s.id IS NULL OR (s.is_enabled AND NOT s.is_archived))) AS pages,
    (SELECT count(*) FROM question q WHERE EXISTS (SELECT 1 FROM question_doc r WHERE r.question_id = q.id) AND NOT EXISTS (
      SELECT 1 FROM question_doc r LEFT JOIN doc d ON d.id = r.document_id LEFT JOIN src s ON s.id = r.source_id
      WHERE r.question_id = q.id AND (d.id IS NULL OR s.id IS NULL OR NOT d.is_enabled OR d.is_archived OR d.status_code <> 'ok'
        OR NOT s.is_enabled OR s.is_archived))) AS available
), judged AS (
  SELECT run_id, pages, available, CASE WHEN run_id % 10 = 0 THEN 'warming_up'
    WHEN pages = 0 OR (status = 'failed' AND added + updated + unchanged = 0) THEN 'degraded'
    WHEN warning_sources + failed_sources > 0 OR available = 0 OR run_id % 4 = 0 OR run_id % 9 = 0 THEN 'ready_with_warnings' ELSE 'ready' END AS knowledge FROM roll, fact)
SELECT run_id, knowledge, CASE WHEN knowledge IN ('degraded', 'warming_up') THEN knowledge
  WHEN run_id % 3 = 0 OR knowledge = 'ready_with_warnings' THEN 'ready_with_warnings' ELSE 'ready' END AS overall, pages, available FROM judged""",
}
