"""The bank as a user sees it: edits of sources, settings, listings, diagnostics, grouped citations and providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, urls
from ..functions.text import minutes_as_unit
from ..sources import views
from .answers import ORACLES as ANSWERS
from .answers import q_citation_resolution
from .eligibility import is_warning, with_source

# What a source without a name is called in listings, and names of providers.
UNKNOWN_SOURCE = "Bilinmeyen kaynak"
PROVIDERS = {"azure": "azure", "azure-cloud": "azure", "ollama-cloud": "ollama-cloud", "ollama-local": "ollama-local"}
#: Largest size of a file, number of files and size of a batch, in MB.
MOST_FILE_MB, MOST_FILES, MOST_BATCH_MB = 250, 1000, 2048
UNIT_MINUTES = {"minute": 1, "hour": 60, "day": 1440, "week": 10080}


def update_sources(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """``sources`` after ``edits`` (id, source_type, name, address, is_enabled), each with its ``outcome``.

    A type never changes (``refused_type``; it may be spelled as `labels.source_type`
    reads it), nor the address of a seeded source (``refused_address``); blank
    names and null addresses stay. Files and lists of links have an address made
    of their guid. ``description`` is the edit's, '' if it has none; ``protocol``
    follows from type and address; of an updated source new_status is ``pending``
    where its pages are crawled again, else ``ok``. Of edits of one id that with
    the greatest values counts.
    """
    described = edits if "description" in edits.columns else edits.withColumn("description", F.lit(None).cast("string"))
    spelled = described.withColumn("source_type", labels.source_type(F.col("source_type")))
    one = spelled.groupBy("id").agg(F.max(F.struct("source_type", "name", "address", "is_enabled", "description")).alias("_e"))
    rows, e = sources.join(one, "id", "left"), F.col("_e")
    kind = F.col("source_type")
    own = lambda scheme: F.concat(F.lit(f"{scheme}://source/"), F.col("guid"))
    address = (
        F.when(kind == "local_files", own("local"))
        .when(kind == "web_links", own("web-links"))
        .otherwise(urls.canonical(F.coalesce(e["address"], F.col("address"))))
    )
    outcome = (
        F.when(e.isNull(), "kept")
        .when(~kind.eqNullSafe(e["source_type"]), "refused_type")
        .when(F.col("seed_key").isNotNull() & (F.lower("address") != F.lower(address)), "refused_address")
        .otherwise("updated")
    )
    rows = rows.withColumns({"_address": address, "outcome": outcome})
    changed = F.col("outcome") == "updated"
    values = {
        "name": F.coalesce(F.nullif(F.trim(e["name"]), F.lit("")), F.col("name")), "address": F.col("_address"), "is_enabled": e["is_enabled"],
        "description": F.coalesce(F.trim(e["description"]), F.lit("")),
    }
    status = F.when(changed, F.when(kind == "web_site", "pending").otherwise("ok")).alias("new_status")
    protocol = F.when(kind == "local_files", "local").when(kind == "web_links", "web-links").otherwise(urls.scheme(F.when(changed, F.col("_address")).otherwise(F.col("address"))))
    kept = [F.when(changed, values[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in sources.columns if c != "protocol"]
    return rows.select(*kept, protocol.alias("protocol"), status, "outcome")


def upload_settings(file_mb: Column, files: Column, batch_mb: Column) -> Column:
    """The limits of uploads, each from 1 to its greatest value."""
    within = lambda c, most: F.least(F.greatest(c, F.lit(1)), F.lit(most))
    return F.struct(within(file_mb, MOST_FILE_MB).alias("file_mb"), within(files, MOST_FILES).alias("files"), within(batch_mb, MOST_BATCH_MB).alias("batch_mb"))


def refresh_period(minutes: Column) -> Column:
    """The minutes that are stored for a period: those of its value and unit."""
    found, size = minutes_as_unit(minutes), F.lit(60)
    for unit, n in UNIT_MINUTES.items():
        size = F.when(found["unit"] == unit, n).otherwise(size)
    return found["value"] * size


def listing(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents as a bank lists them: a name for those without source, a title for those without."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), urls.title_of(F.col("url")))
    named = with_source(docs, sources).withColumns({"source_name": F.coalesce("source_name", F.lit(UNKNOWN_SOURCE)), "title": title})
    return named.select("id", "source_id", "source_name", "source_type", "title", "url", "status_code", "is_enabled", "is_archived")


def totals(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of a bank's counts: sources and documents, and those that are active."""
    on = F.count_if(F.col("is_enabled") & ~F.col("is_archived"))
    of = lambda df, name: df.agg(F.count("*").alias(name), on.alias(f"active_{name}"))
    return of(sources, "sources").crossJoin(of(docs, "documents"))  # one row each


def diagnostics(docs: DataFrame, sources: DataFrame, source_id: int | None = None) -> DataFrame:
    """Sources, or one of them, with each of their documents whose status isn't ok; a source without any has one row."""
    found = sources if source_id is None else sources.where(F.col("id") == source_id)
    bad = docs.where(is_warning(F.col("status_code"))).select("source_id", F.col("id").alias("document_id"), "title", "status_code", "http_status")
    return found.select(F.col("id").alias("source_id"), "name").join(bad, "source_id", "left")


def grouped_citations(cited: DataFrame) -> DataFrame:
    """Citations (answer_id, document_id, source_id, source_name, rank) by source, in order of their first.

    A row an answer and source: its place and its documents in order. One answer
    cites few documents.
    """
    lists = cited.groupBy("answer_id", "source_id", "source_name").agg(
        F.array_sort(F.collect_list(F.struct("rank", "document_id"))).alias("_items"), F.min("rank").alias("_first")
    )
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("_first", "source_id")).alias("place")
    return lists.select("answer_id", place, "source_id", "source_name", F.transform("_items", lambda x: x["document_id"]).alias("documents"))


def provider(name: Column) -> Column:
    """The code of a provider's name; null for others."""
    found = F.lit(None).cast("string")
    for alias, code in PROVIDERS.items():
        found = F.when(F.lower(F.trim(name)) == alias, code).otherwise(found)
    return found


def provider_order(names: Column, disabled: Column) -> Column:
    """Codes of the known ``names`` that aren't ``disabled``, in order, each once; null arrays are empty."""
    codes = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), provider), lambda x: x.isNotNull())
    return F.array_except(F.array_distinct(codes(names)), codes(disabled))


def payload_blocks(docs: DataFrame) -> DataFrame:
    """The tagged text of each document, and the key by which they are ordered: the URL, case ignored.

    Rows stay apart, to be written in order; no row holds the whole payload.
    """
    head = lambda tag, c: F.concat(F.lit(f"[{tag}] "), c)
    title = F.when(F.length(F.trim("title")) > 0, head("Title", F.col("title")))
    source = F.coalesce("source_id", F.lit(0)).cast("string")
    block = F.concat_ws(
        "\n", head("DocumentId", F.col("id").cast("string")), head("SourceId", source), head("Web Source URL", F.coalesce("url", F.lit(""))),
        title, "content", F.lit("[/Web Source]"),
    )
    return docs.select("id", F.upper("url").alias("order_key"), block.alias("block"))


def q_updated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source but archived ones is renamed and switched; disabled ones ask for another type, some for another address."""
    sources = views.sources(spark, sf_dir).withColumns({"guid": F.sha2("name", 256), "description": F.concat(F.lit("about "), "name")})
    kind = F.when(F.col("is_enabled"), F.concat(F.lit(" "), F.upper("source_type"))).otherwise("other")
    moved = F.when(F.col("next_refresh").isNull(), F.concat(F.lit("HTTPS://www.new-"), "name", F.lit(".example/x")))
    edits = sources.where("not is_archived").select(
        "id", kind.alias("source_type"), F.when(F.col("seed_key").isNotNull(), F.concat(F.lit(" new "), "name")).otherwise(" ").alias("name"),
        moved.alias("address"), (~F.col("is_enabled")).alias("is_enabled"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" now "), "name")).alias("description"),
    )
    return update_sources(sources, edits).select("id", "name", "address", "protocol", "description", "is_enabled", "new_status", "outcome")


def q_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("int")
    events = views.table(spark, sf_dir, "events")
    return events.select("event_id", upload_settings(n - 5, n, n * 3).alias("s"), refresh_period(n).alias("minutes")).select("event_id", "s.*", "minutes")


def q_bank_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing(views.documents(spark, sf_dir), views.sources(spark, sf_dir))
    return found.select("id", "source_name", "source_type", "title", "status_code")


def q_bank_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(views.documents(spark, sf_dir), views.sources(spark, sf_dir))


def q_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the server refused count as warnings."""
    docs = views.documents(spark, sf_dir)
    refused = F.when(F.col("http_status") == 503, "unavailable").otherwise(F.col("status_code"))
    return diagnostics(docs.withColumn("status_code", refused), views.sources(spark, sf_dir))


def q_grouped_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = q_citation_resolution(spark, sf_dir)
    docs = views.documents(spark, sf_dir).select(F.col("id").alias("document_id"), "source_id")
    names = views.sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    found = grouped_citations(cited.join(docs, "document_id").join(names, "source_id"))
    return found.withColumn("documents", F.array_join(F.col("documents").cast("array<string>"), ","))


def q_payload_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_blocks(views.documents(spark, sf_dir)).select("id", "order_key", F.sha2("block", 256).alias("block_hash"))


QUERIES = {
    "updated_sources": q_updated_sources,
    "settings": q_settings,
    "bank_listing": q_bank_listing,
    "bank_totals": q_bank_totals,
    "diagnostics": q_diagnostics,
    "grouped_citations": q_grouped_citations,
    "payload_blocks": q_payload_blocks,
}

ORACLES = {
    "updated_sources": """
WITH asked AS (
  SELECT *, CASE source_type WHEN 'local_files' THEN 'local://source/' || sha256(name) WHEN 'web_links' THEN 'web-links://source/' || sha256(name)
    ELSE CASE WHEN next_refresh IS NULL THEN 'https://new-' || name || '.example/x' ELSE address END END AS target FROM src
), judged AS (
  SELECT *, CASE WHEN is_archived THEN 'kept' WHEN NOT is_enabled THEN 'refused_type'
    WHEN seed_key IS NOT NULL AND target <> address THEN 'refused_address' ELSE 'updated' END AS outcome FROM asked
)
SELECT id, CASE WHEN outcome = 'updated' AND seed_key IS NOT NULL THEN 'new ' || name ELSE name END AS name,
  CASE WHEN outcome = 'updated' THEN target ELSE address END AS address,
  CASE source_type WHEN 'local_files' THEN 'local' WHEN 'web_links' THEN 'web-links' ELSE 'https' END AS protocol,
  CASE WHEN outcome <> 'updated' THEN 'about ' || name WHEN id % 2 = 0 THEN 'now ' || name ELSE '' END AS description, CASE WHEN outcome = 'updated' THEN NOT is_enabled ELSE is_enabled END AS is_enabled,
  CASE WHEN outcome = 'updated' THEN CASE source_type WHEN 'web_site' THEN 'pending' ELSE 'ok' END END AS new_status, outcome FROM judged""",
    "settings": """
SELECT event_id, least(greatest(n - 5, 1), 250) AS file_mb, least(greatest(n, 1), 1000) AS files, least(greatest(n * 3, 1), 2048) AS batch_mb,
  CASE WHEN n > 0 AND (n % 10080 = 0 AND n // 10080 <= 4 OR n % 1440 = 0 AND n // 1440 <= 4 OR n % 60 = 0 AND n // 60 <= 24) THEN n
    ELSE least(greatest(n, 1), 60) END AS minutes
FROM (SELECT event_id, event_id::INT AS n FROM events)""",
    "bank_listing": """
SELECT d.id, coalesce(s.name, 'Bilinmeyen kaynak') AS source_name, s.source_type,
  coalesce(nullif(trim(d.title, ' '), ''), regexp_extract(d.url, '[^/]+$')) AS title, d.status_code
FROM doc d LEFT JOIN src s ON s.id = d.source_id""",
    "bank_totals": """
SELECT * FROM (SELECT count(*) AS sources, count(*) FILTER (is_enabled AND NOT is_archived) AS active_sources FROM src),
  (SELECT count(*) AS documents, count(*) FILTER (is_enabled AND NOT is_archived) AS active_documents FROM doc)""",
    "diagnostics": """
WITH bad AS (
  SELECT * FROM (SELECT source_id, id AS document_id, title, CASE WHEN http_status = 503 THEN 'unavailable' ELSE status_code END AS status_code, http_status FROM doc)
  WHERE status_code <> 'ok'
)
SELECT s.id AS source_id, s.name, b.document_id, b.title, b.status_code, b.http_status FROM src s LEFT JOIN bad b ON b.source_id = s.id""",
    "grouped_citations": f"""
WITH cited AS ({ANSWERS["citation_resolution"]}), named AS (
  SELECT c.answer_id, c.document_id, c.rank, d.source_id, s.name AS source_name FROM cited c JOIN doc d ON d.id = c.document_id JOIN src s ON s.id = d.source_id
)
SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY min(rank), source_id)::INT AS place, source_id, source_name,
  string_agg(document_id::VARCHAR, ',' ORDER BY rank, document_id) AS documents FROM named GROUP BY answer_id, source_id, source_name""",
    "payload_blocks": """
SELECT id, upper(url) AS order_key, sha256(concat_ws(chr(10), '[DocumentId] ' || id, '[SourceId] ' || coalesce(source_id, 0),
  '[Web Source URL] ' || coalesce(url, ''), CASE WHEN length(trim(title, ' ')) > 0 THEN '[Title] ' || title END, content, '[/Web Source]')) AS block_hash FROM doc""",
}
