"""Keyed upserts, snapshot replacement and cascades, as joins that give the next version of a table.

Parquet tables have no MERGE: each operator takes the present table and the
changes and returns the new table, to be written beside the old one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import canonical, key_of
from ..sources import views
from .ids import deal_ids


def last_by_key(rows: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """The last row of each key: what is left when a batch repeats it. Aggregates before it shuffles."""
    keys = [key] if isinstance(key, str) else [*key]
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return last.select(*keys, "_row.*").select(*rows.columns)


def upsert_by_origin(present: DataFrame, batch: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Insert new URLs; update content columns where the origin is the same; else leave the row.

    URLs are compared as the store keeps them (canonical, without case), and new
    ones are stored canonical; of rows of one URL in the batch the last by id
    counts. Ids, flags and URLs of present rows never change, nor do rows without
    a URL; those of the batch are left out. ``change`` tells what happened.

    ``ids``: the table whose greatest id those of inserted rows follow; without
    it they keep those of the batch. They are dealt to keys alone and joined
    where the rows of a key are, so the texts of a side are shuffled once.
    """
    content = ["title", "content", "content_hash", "status_code", "http_status", "crawled_at"]
    keyed = batch.where("url is not null").withColumns({"url": canonical(F.col("url")), "_key": key_of(F.col("url"))})
    new = last_by_key(keyed, "_key", "id")
    new = new.select("_key", *[F.col(c).alias(f"_{c}") for c in batch.columns], F.lit(True).alias("_new"))
    old = present.withColumns({"_old": F.lit(True), "_key": key_of(F.col("url"))})
    if ids is not None:
        keys = keyed.select("_key").distinct().join(old.select("_key"), "_key", "left_anti")
        numbers = deal_ids(keys, [key_of(F.col("_key"))], ids).select("_key", F.col("id").alias("_number"))
        new = new.join(numbers, "_key", "left").withColumn("_id", F.col("_number")).drop("_number")
    joined = old.join(new, "_key", "full_outer")
    inserted = F.col("_old").isNull()
    updated = F.col("_new").isNotNull() & ~inserted & (F.col("origin") == F.col("_origin"))
    change = (
        F.when(inserted, "inserted").when(updated, "updated").when(F.col("_new").isNotNull(), "ignored").otherwise("kept")
    )
    return joined.select(
        *[
            F.when(inserted | updated if c in content else inserted, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
            for c in present.columns
        ],
        change.alias("change"),
    )


def snapshot_diff(present: DataFrame, staged: DataFrame, order: str = "id") -> DataFrame:
    """What replacing the snapshot of each source changes, a row a source_id and key: added, updated, deleted or unchanged.

    ``key`` is the URL as the store compares it (canonical, without case); where
    one side repeats a key of a source its last row counts, by ``order``. Rows
    without a URL, and without a source, match nothing. Tables without source_id
    are of one source.
    """
    columns = ["content_hash", "status_code", "http_status"]
    within = ["source_id"] if "source_id" in present.columns and "source_id" in staged.columns else []
    keys = [*within, "key"]

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*within, key_of(F.col("url")).alias("key"), F.col(order).alias("_order"), *[F.col(c).alias(f"{name}_{c}") for c in columns])
        whole = F.col("key").isNotNull()
        for c in within:
            whole &= F.col(c).isNotNull()
        last = last_by_key(rows.where(whole), keys, "_order").union(rows.where(~whole).select(*rows.columns))
        return last.drop("_order").withColumn(name, F.lit(True))

    joined = side(present, "old").join(side(staged, "new"), keys, "full_outer")
    same = (
        (F.lower("old_content_hash") == F.lower("new_content_hash"))
        & F.col("old_status_code").eqNullSafe(F.col("new_status_code"))
        & F.col("old_http_status").eqNullSafe(F.col("new_http_status"))
    )
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(same, "unchanged").otherwise("updated")
    )
    return joined.select(*keys, change.alias("change"), F.coalesce("new_content_hash", "old_content_hash").alias("content_hash"))


def missing(present: DataFrame, found: DataFrame, crawled: DataFrame | None = None) -> DataFrame:
    """Crawled rows of the sources in ``crawled`` (id) that their crawl no longer finds.

    ``found`` has source_id and url; URLs are compared as the store keeps them,
    within a source. Without ``crawled`` the sources are those that found any. A
    source that is listed and found nothing misses all it has; rows without a
    URL or source are never missing.
    """
    named = found.select("source_id", key_of(F.col("url")).alias("_key"))
    of = named.select("source_id") if crawled is None else crawled.select(F.col("id").alias("source_id"))
    rows = present.where("origin = 'web_crawl' and url is not null").join(of.distinct(), "source_id", "left_semi")
    left = rows.withColumn("_key", key_of(F.col("url"))).join(named, ["source_id", "_key"], "left_anti")
    return left.select(*present.columns)


def without_missing(present: DataFrame, found: DataFrame, crawled: DataFrame | None = None) -> DataFrame:
    """``present`` without its `missing` rows (id unique)."""
    return present.join(missing(present, found, crawled).select("id"), "id", "left_anti")


def without_sources(sources: DataFrame, docs: DataFrame, refs: DataFrame, gone: DataFrame) -> tuple[DataFrame, ...]:
    """Sources, documents and references without the sources in ``gone`` (id) and all that hangs on them."""
    left_sources = sources.join(gone.select("id"), "id", "left_anti")
    left_docs = docs.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    left_refs = refs.join(left_docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return left_sources, left_docs, left_refs


def seed_sources(sources: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sources after seeding (seed_key, name, address): matched by key or by address, those not listed archived."""
    by_key = sources.join(seeds.select("seed_key", F.col("address").alias("_a"), F.col("name").alias("_n")), "seed_key")
    by_address = sources.join(
        seeds.select("address", F.col("seed_key").alias("_k"), F.col("name").alias("_n")), "address"
    )
    hits = (
        by_key.select("id", F.col("seed_key").alias("new_key"), F.col("_a").alias("new_address"), F.col("_n").alias("new_name"), F.lit(0).alias("rank"))
        .union(by_address.select("id", "_k", "address", "_n", F.lit(1)))
        .groupBy("id")
        .agg(F.min_by(F.struct("new_key", "new_address", "new_name"), "rank").alias("seed"))
    )
    joined = sources.join(hits, "id", "left")
    listed = F.col("seed").isNotNull()
    retired = F.col("seed_key").isNotNull() & ~listed
    present = joined.select(
        "id",
        F.coalesce("seed.new_key", "seed_key").alias("seed_key"),
        F.coalesce("seed.new_name", "name").alias("name"),
        F.coalesce("seed.new_address", "address").alias("address"),
        (F.col("is_enabled") & ~retired).alias("is_enabled"),
        (F.col("is_archived") | retired).alias("is_archived"),
    )
    new = seeds.join(present.select("seed_key"), "seed_key", "left_anti")
    fresh = new.select(
        F.lit(None).cast("long").alias("id"), "seed_key", "name", "address", F.lit(True).alias("is_enabled"), F.lit(False).alias("is_archived")
    )
    return present.unionByName(fresh)


def q_upsert_pages_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, staged = views.documents(spark, sf_dir), views.incoming(spark, sf_dir)
    other = F.when(F.col("id") % 6 == 0, "manual_upload").otherwise(F.col("origin"))
    found = upsert_by_origin(docs, staged.withColumn("origin", other))
    return found.select("id", "url", "title", "content_hash", "origin", "is_enabled", "change")


def q_snapshot_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(views.documents(spark, sf_dir), _staged(spark, sf_dir))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second snapshot, in which some addresses come twice, in another case and with another text."""
    staged = views.incoming(spark, sf_dir)
    again = staged.where("id % 7 = 0").withColumns(
        {"id": F.col("id") + 20_000_000, "url": F.upper("url"), "content_hash": F.upper(F.reverse("content_hash"))}
    )
    return staged.unionByName(again)


def q_snapshot_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_snapshot_diff_rows(spark, sf_dir).agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "deleted", "unchanged")]
    )


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the second snapshot; one in 23 is found by another source than its own."""
    rows = views.incoming(spark, sf_dir)
    return rows.select(F.when(F.col("id") % 23 == 0, -F.col("source_id")).otherwise(F.col("source_id")).alias("source_id"), "url")


def q_missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three sources were crawled."""
    crawled = views.sources(spark, sf_dir).where("source_type <> 'local_files'")
    return missing(views.documents(spark, sf_dir), _found(spark, sf_dir), crawled).select("id", "url")


def q_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.sources(spark, sf_dir)
    left = without_sources(
        sources, views.documents(spark, sf_dir), views.question_documents(spark, sf_dir), sources.where("id % 5 = 0")
    )
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in zip(("source", "document", "reference"), left, strict=True)]
    return counts[0].union(counts[1]).union(counts[2])


def q_last_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir).select("origin", "id", "url", "content_hash")
    return last_by_key(docs, "origin", "id")


QUERIES = {
    "upsert_pages_by_origin": q_upsert_pages_by_origin,
    "snapshot_diff_rows": q_snapshot_diff_rows,
    "snapshot_diff_counts": q_snapshot_diff_counts,
    "missing_documents": q_missing_documents,
    "cascade_delete": q_cascade_delete,
    "last_by_origin": q_last_by_origin,
}

_DIFF = """twice AS (
  SELECT source_id, key, content_hash, status_code, http_status, id FROM incoming
  UNION ALL SELECT source_id, key, upper(reverse(content_hash)), status_code, http_status, id + 20000000 FROM incoming WHERE id % 7 = 0
), staged AS (
  SELECT * FROM twice QUALIFY key IS NULL OR row_number() OVER (PARTITION BY source_id, key ORDER BY id DESC) = 1
), diff AS (
  SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.key, n.key) AS key, coalesce(n.content_hash, o.content_hash) AS content_hash,
    CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted'
      WHEN lower(o.content_hash) = lower(n.content_hash) AND o.status_code IS NOT DISTINCT FROM n.status_code
        AND o.http_status IS NOT DISTINCT FROM n.http_status THEN 'unchanged' ELSE 'updated' END AS change
  FROM doc o FULL JOIN staged n ON o.source_id = n.source_id AND o.key = n.key)"""
ORACLES = {
    "upsert_pages_by_origin": """
SELECT coalesce(o.id, n.id) AS id, coalesce(o.url, CASE WHEN n.id % 5 = 3 THEN replace(n.key, '/new', '/NEW') ELSE n.key END) AS url,
  CASE WHEN o.id IS NULL OR hit THEN n.title ELSE o.title END AS title,
  CASE WHEN o.id IS NULL OR hit THEN n.content_hash ELSE o.content_hash END AS content_hash,
  coalesce(o.origin, n.origin) AS origin, coalesce(o.is_enabled, n.is_enabled) AS is_enabled,
  CASE WHEN o.id IS NULL THEN 'inserted' WHEN hit THEN 'updated' WHEN n.id IS NOT NULL THEN 'ignored' ELSE 'kept' END AS change
FROM (SELECT o.*, o.origin = n.origin AS hit FROM doc o LEFT JOIN (
    SELECT * REPLACE (CASE WHEN id % 6 = 0 THEN 'manual_upload' ELSE origin END AS origin) FROM incoming) n USING (key)) o
FULL JOIN (SELECT * REPLACE (CASE WHEN id % 6 = 0 THEN 'manual_upload' ELSE origin END AS origin) FROM incoming) n ON n.key = o.key""",
    "snapshot_diff_rows": f"WITH {_DIFF} SELECT * FROM diff",
    "snapshot_diff_counts": f"""WITH {_DIFF} SELECT count(*) FILTER (change = 'added') AS added,
  count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'deleted') AS deleted,
  count(*) FILTER (change = 'unchanged') AS unchanged FROM diff""",
    "missing_documents": """
SELECT id, url FROM doc d WHERE origin = 'web_crawl' AND source_id IN (SELECT id FROM src WHERE source_type <> 'local_files')
  AND NOT EXISTS (SELECT 1 FROM incoming i WHERE i.key = d.key AND i.id % 23 <> 0)""",
    "cascade_delete": """
SELECT 'source' AS "table", count(*) AS rows FROM src WHERE id % 5 <> 0
UNION ALL SELECT 'document', count(*) FROM doc WHERE source_id IS NULL OR source_id % 5 <> 0
UNION ALL SELECT 'reference', count(*) FROM question_doc q JOIN doc d ON d.id = q.document_id WHERE d.source_id IS NULL OR d.source_id % 5 <> 0""",
    "last_by_origin": """
SELECT origin, id, url, content_hash FROM doc QUALIFY row_number() OVER (PARTITION BY origin ORDER BY id DESC) = 1""",
}
