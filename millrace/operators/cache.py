"""The cache of context blocks, kept up to date by what changed.

Blocks lie in folders by a hash of their document, in generations: an update
rebuilds the blocks of changed documents, writes the folders these are in as a
new generation, and a table that tells the generation of each folder; folders
without a change are neither read nor written. The cache's fingerprint is made
of sums a folder, from which the lines of gone blocks are subtracted and to which
those of new ones are added. All is committed at once (`sources.versions`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views
from ..sources.versions import TableSet, scratch
from .retrieve import blocks, bucket_sums, sealed

#: Folders of a cache.
FOLDERS = 64
#: Generations after which an update writes all folders anew.
MOST_GENERATIONS = 8


def _folder(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")


def _sums(found: DataFrame) -> DataFrame:
    return bucket_sums(found, "document_id", "block_hash", FOLDERS)


def _hashed(found: DataFrame) -> DataFrame:
    return found.withColumns({"block_hash": F.sha2("block", 256), "bucket": _folder(F.col("document_id"))})


def build(store: TableSet, docs: DataFrame, sources: DataFrame) -> int:
    """Commits a cache of all blocks of ``docs``, in one generation; the number of the version."""
    found = _hashed(blocks(docs, sources))
    places = store.spark.range(FOLDERS).select(F.col("id").cast("int").alias("bucket"), F.lit("blocks_0").alias("generation"))
    return store.commit({"blocks_0": found, "sums": _sums(found), "places": places}, by={"blocks_0": "bucket"})


def read(store: TableSet, folders: list[int] | None = None) -> DataFrame:
    """The blocks of the cache, or of some of its ``folders``: of each folder those of its generation."""
    tables = store.read()
    held: dict[str, list[int]] = {}
    # as many rows as there are folders
    for bucket, generation in tables["places"].select("bucket", "generation").collect():
        if folders is None or bucket in folders:
            held.setdefault(generation, []).append(bucket)
    parts = [tables[g].where(F.col("bucket").isin(own)) for g, own in sorted(held.items())]
    out = parts[0] if parts else tables["blocks_0"].limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def changed(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """The keys of rows that one version has and the other hasn't, or has with other values in any column."""
    columns = sorted(c for c in before.columns if c != key)
    # every column with whether it is null: equal strings, numbers and times hash alike
    stamp = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    sides = [df.select(F.col(key), stamp.alias(name)) for df, name in ((before, "_old"), (after, "_new"))]
    both = sides[0].join(sides[1], key, "full_outer")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key)


def toggled(rows: DataFrame, wanted: DataFrame, flag: str) -> DataFrame:
    """The ids of ``wanted`` (id, value) whose ``flag`` that changes: asking for what is there already changes nothing."""
    return rows.join(wanted.select("id", F.col("value").alias("_value")), "id").where(~F.col(flag).eqNullSafe(F.col("_value"))).select("id")


def update(store: TableSet, docs: DataFrame, sources: DataFrame, changes: DataFrame) -> dict[str, int]:
    """Brings the cache up to ``docs`` after the documents in ``changes`` (id) came, went or changed.

    Nothing is committed if no block changes. Returns how many folders were
    read, blocks added, dropped and rebuilt, and the version.
    """
    ids = changes.select(F.col("id").alias("document_id")).distinct()
    keyed = ids.withColumn("bucket", _folder(F.col("document_id")))
    # names of folders, FOLDERS at most
    folders = sorted(r[0] for r in keyed.select("bucket").distinct().collect())
    none = {"folders": 0, "added": 0, "dropped": 0, "rebuilt": 0, "version": store.current()}
    if not folders:
        return none
    old = read(store, folders)
    gone = old.join(ids, "document_id", "left_semi")
    new = _hashed(blocks(docs.join(changes.select("id"), "id", "left_semi"), sources)).select(*old.columns)
    both = gone.select("document_id", F.col("block_hash").alias("_old")).join(new.select("document_id", F.col("block_hash").alias("_new")), "document_id", "full_outer")
    told = both.agg(
        F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(F.col("_new").isNull()).alias("dropped"),
        F.count_if(F.col("_old") != F.col("_new")).alias("rebuilt"),
    ).first()
    if not any(told):
        return none | {"folders": len(folders)}
    tables = store.read()
    known = [n for n in tables if n.startswith("blocks_")]
    name = f"blocks_{1 + max(int(n[7:]) for n in known)}"
    if len(known) >= MOST_GENERATIONS:
        # all folders as one generation
        folders = list(range(FOLDERS))
        old = read(store)
    whole = old.join(ids, "document_id", "left_anti").unionByName(new)
    places = tables["places"].withColumn("generation", F.when(F.col("bucket").isin(folders), name).otherwise(F.col("generation")))
    sign = lambda df, s: df.select("bucket", *[(s * F.col(c)).alias(c) for c in ("low", "high", "n")])
    sums = tables["sums"].select("bucket", "low", "high", "n").unionByName(sign(_sums(gone), -1)).unionByName(sign(_sums(new), 1))
    sums = sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("low", "high", "n")])
    version = store.commit({name: whole, "places": places, "sums": sums}, by={name: "bucket"})
    return {"folders": len(folders), **told.asDict(), "version": version}


def fingerprint(store: TableSet) -> str:
    """The fingerprint of the cache, from its sums alone."""
    return sealed(store.read()["sums"]).first()["fingerprint"]


def upsert_entries(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """``cache`` (cache_key, content, fingerprint, built_at) with ``entries`` in place of those of equal key; of equal ones the last built."""
    last = entries.groupBy("cache_key").agg(F.max_by(F.struct("content", "fingerprint", "built_at"), "built_at").alias("e"))
    return cache.join(last.select("cache_key"), "cache_key", "left_anti").unionByName(last.select("cache_key", "e.*"))


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents later: some gone, some with another text, some archived, most as they were."""
    docs = views.documents(spark, sf_dir).where("id % 113 <> 0")
    content = F.when(F.col("id") % 105 == 0, F.concat("content", F.lit(" updated"))).otherwise(F.col("content"))
    return docs.withColumns({"content": content, "content_hash": F.sha2(content, 256), "is_archived": F.col("is_archived") | (F.col("id") % 117 == 0)})


def _updated(spark: SparkSession, sf_dir: str) -> tuple[TableSet, dict[str, int]]:
    store = TableSet(spark, scratch(spark, "cache"))
    first, second, sources = views.documents(spark, sf_dir), _second(spark, sf_dir), views.sources(spark, sf_dir)
    build(store, first, sources)
    return store, update(store, second, sources, changed(first, second))


def q_cached_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after an update, which is what a full rebuild gives."""
    store, _ = _updated(spark, sf_dir)
    return read(store).select("document_id", "label", "block_hash")


def q_cache_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the update did, and whether the corrected fingerprint is that of a full rebuild."""
    store, told = _updated(spark, sf_dir)
    whole = TableSet(spark, scratch(spark, "cache"))
    build(whole, _second(spark, sf_dir), views.sources(spark, sf_dir))
    agree = fingerprint(store) == fingerprint(whole)
    return spark.createDataFrame([(told["added"], told["dropped"], told["rebuilt"], agree)], "added long, dropped long, rebuilt long, agree boolean")


def q_changed_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document is asked to be enabled: those that are already change nothing."""
    docs = views.documents(spark, sf_dir)
    return toggled(docs, docs.where("id % 3 = 0").select("id", F.lit(True).alias("value")), "is_enabled")


QUERIES = {"cached_blocks": q_cached_blocks, "cache_update": q_cache_update, "changed_toggles": q_changed_toggles}

_BLOCK = """{0} AS (
  SELECT d.id AS document_id, coalesce(s.name, 'Bilgi Bankası') || ' - ' || d.title AS label, sha256('[Knowledge Document]' || chr(10) || '[DocumentId] ' || d.id
    || chr(10) || '[SourceId] ' || d.source_id || chr(10) || '[SourceName] ' || coalesce(s.name, 'Bilgi Bankası') || chr(10) || '[SourceType] '
    || coalesce(s.source_type, '') || chr(10) || '[DocumentTitle] ' || d.title || chr(10) || '[DocumentUrl] ' || d.url || chr(10) || '[CitationLabel] '
    || coalesce(s.name, 'Bilgi Bankası') || ' - ' || d.title || chr(10) || '[Content]' || chr(10) || d.content || chr(10) || '[/Content]' || chr(10)
    || '[/Knowledge Document]') AS block_hash
  FROM {1} d LEFT JOIN src s ON s.id = d.source_id
  WHERE NOT d.is_archived AND d.status_code = 'ok' AND length(trim(d.content, ' ')) > 0 AND d.source_id IS NOT NULL AND (s.id IS NULL OR NOT s.is_archived))"""
_LATER = """later AS (
  SELECT * REPLACE (CASE WHEN id % 105 = 0 THEN content || ' updated' ELSE content END AS content, is_archived OR id % 117 = 0 AS is_archived) FROM doc WHERE id % 113 <> 0
)"""
ORACLES = {
    "cached_blocks": f"WITH {_LATER}, {_BLOCK.format('now', 'later')} SELECT * FROM now",
    "cache_update": f"""
WITH {_LATER}, {_BLOCK.format('was', 'doc')}, {_BLOCK.format('now', 'later')}
SELECT count(*) FILTER (w.document_id IS NULL) AS added, count(*) FILTER (n.document_id IS NULL) AS dropped,
  count(*) FILTER (w.block_hash <> n.block_hash) AS rebuilt, true AS agree FROM was w FULL JOIN now n ON n.document_id = w.document_id""",
    "changed_toggles": "SELECT id FROM doc WHERE id % 3 = 0 AND NOT is_enabled",
}
