"""Who and what a bank is: its identity, its local sources, its pages by URL, the served set, and files looked at before their import."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import extension
from ..functions.text import guid_of, preview, relative_path
from ..functions.urls import key_of, path
from ..sources import views
from ..sources.files import parse
from .ids import deal_ids
from .questions import rotation

# Extensions of documents that are fetched as files, and those that links may name besides; a local source without a name; what a file that can't be read is told as.
DOCUMENTS = ("txt", "docx", "pdf", "pptx", "rtf", "epub", "md")
PAGES = ("htm", "html")
LOCAL = "Yerel Dosyalar"
NO_PREVIEW = "Bu dosya için önizleme oluşturulamadı."


def identity(tenant: DataFrame, bank: DataFrame) -> DataFrame:
    """tenant_guid and bank_guid, one row, of the one row of each table; no row where a table is empty."""
    left = tenant.agg(F.min("guid").alias("tenant_guid"))
    right = bank.agg(F.min("guid").alias("bank_guid"))
    return left.crossJoin(right).where("tenant_guid is not null and bank_guid is not null")  # one row each


def ensure_local(sources: DataFrame, wanted: DataFrame, who: DataFrame) -> DataFrame:
    """``sources`` with a local source for each of ``wanted`` (guid, name, description), and ``change``.

    A source with the guid stays as it is (``present``). One that has the address
    of the guid, ``local://source/<guid>``, under another becomes that source,
    enabled and not archived (``updated``); else it is ``inserted``, with a new
    id and the identity ``who`` (one row). Others are ``kept``. A blank name is
    the default; of wanted rows with one guid that of the least name counts.
    """
    one = wanted.where("guid is not null").groupBy("guid").agg(F.min(F.struct("name", "description")).alias("w")).select(
        F.col("guid").alias("_guid"), F.concat(F.lit("local://source/"), "guid").alias("_address"),
        F.coalesce(F.nullif(F.trim("w.name"), F.lit("")), F.lit(LOCAL)).alias("_name"), F.coalesce(F.trim("w.description"), F.lit("")).alias("_description"),
    )
    told = who.select(F.col("tenant_guid").alias("_tenant"), F.col("bank_guid").alias("_bank"))
    values = {
        "guid": F.col("_guid"), "address": F.col("_address"), "name": F.col("_name"), "description": F.col("_description"), "source_type": F.lit("local_files"),
        "is_enabled": F.lit(True), "is_archived": F.lit(False), "tenant_guid": F.col("_tenant"), "bank_guid": F.col("_bank"),
    }
    known = one.join(sources.select(F.col("guid").alias("_guid")), "_guid", "left_semi").select(F.col("_guid").alias("_known"))
    lacking = one.join(known, F.col("_guid") == F.col("_known"), "left_anti")
    rows = sources.join(known, F.col("guid") == F.col("_known"), "left").join(lacking, F.col("_known").isNull() & (F.col("address") == F.col("_address")), "left")
    hit = F.col("_guid").isNotNull()
    change = F.when(F.col("_known").isNotNull(), "present").when(hit, "updated").otherwise("kept").alias("change")
    # one row
    after = rows.crossJoin(F.broadcast(told)).select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in sources.columns], change)
    new = lacking.join(sources.select(F.col("address").alias("_address")), "_address", "left_anti").crossJoin(F.broadcast(told))
    new = new.select(*[values.get(c, F.lit(None)).cast(sources.schema[c].dataType).alias(c) for c in sources.columns if c != "id"])
    return after.unionByName(deal_ids(new, [F.col("guid")], sources).withColumn("change", F.lit("inserted")))


def pages_by_url(docs: DataFrame) -> DataFrame:
    """key (the URL as the store compares it) and id of every document with a URL; raises where two have one key."""
    found = docs.where("url is not null").groupBy(key_of(F.col("url")).alias("key")).agg(F.min("id").alias("id"), F.count("*").alias("_n"))
    twice = F.raise_error(F.concat(F.lit("two documents have the URL "), F.col("key"))).cast("long")
    return found.select("key", F.when(F.col("_n") > 1, twice).otherwise(F.col("id")).alias("id"))


def served_set(chosen: DataFrame, available: DataFrame) -> DataFrame:
    """One row of the questions served: their number, when the newest was made, how many there are to choose from."""
    total = available.agg(F.count("*").alias("available"))
    return chosen.agg(F.count("*").alias("questions"), F.max("created_at").alias("newest")).crossJoin(total)  # one row each


def should_download(url: Column, kind: Column) -> Column:
    """Whether a document is fetched as a file before it is rendered: by its extension, of web pages too in lists of links."""
    found = F.nullif(extension(path(url)), F.lit(""))
    return F.coalesce(found.isin(*DOCUMENTS) | ((F.lower(kind) == "web_links") & found.isin(*PAGES)), F.lit(False))


def previewed(files: DataFrame) -> DataFrame:
    """What importing ``files`` (id, name, path, content: bytes) would give, without importing: title, text, preview, status and error of each."""

    @F.pandas_udf("text string, error string")
    def parsed(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(n, c) for n, c in zip(names, contents, strict=True)], columns=["text", "error"])

    rows = files.withColumn("_p", parsed("name", "content"))
    title = F.regexp_replace(F.element_at(F.split("name", "/"), -1), r"\.[^.]*$", "")
    bad = F.col("_p.error").isNotNull()
    shown = F.when(bad, NO_PREVIEW).otherwise(preview(F.col("_p.text"), F.col("name"), "-", 360))
    return rows.select(
        "id", "name", relative_path(F.coalesce("path", "name")).alias("path"), title.alias("title"), F.coalesce("_p.text", F.lit("")).alias("text"),
        shown.alias("preview"), F.when(bad, "parse_failed").otherwise("parsed").alias("status"), F.col("_p.error").alias("error"),
    )


def _wanted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources with guids, local ones some by another address; what an archive names, some of it new; and the identity."""
    sources = views.sources(spark, sf_dir)
    guid = guid_of(F.col("name"))
    local = F.concat(F.lit("local://source/"), guid)
    named = sources.select(
        "id", "name", F.concat(F.lit("about "), "name").alias("description"), "source_type", "is_enabled", "is_archived",
        F.when(F.col("id") % 3 == 0, guid).alias("guid"), F.when(F.col("id") % 3 == 1, local).otherwise(F.col("address")).alias("address"),
        F.lit("old").alias("tenant_guid"), F.lit("old").alias("bank_guid"),
    )
    wanted = sources.select(guid.alias("guid"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" local "), "name")).otherwise(" ").alias("name"), F.lit(" d ").alias("description"))
    tables = [views.table(spark, sf_dir, n).select(guid_of(F.col(f"{n[0]}_name")).alias("guid")) for n in ("region", "nation")]
    return named, wanted, identity(*tables)


def q_local_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensure_local(*_wanted(spark, sf_dir)).drop("is_enabled", "is_archived")


def q_pages_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the second snapshot by URL, however it is spelled."""
    return pages_by_url(views.incoming(spark, sf_dir))


def q_served_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of the questions that were served least."""
    questions = views.questions(spark, sf_dir)
    chosen = questions.join(questions.agg(F.min("served_count").alias("served_count")), "served_count")  # one row
    return served_set(chosen, questions).withColumn("drawn", F.lit(rotation(chosen, 10).count()).cast("long"))


def q_download_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed addresses as files of several kinds, in sites and in lists of links."""
    pages = views.table(spark, sf_dir, "pages")
    ends = F.element_at(F.array(*map(F.lit, ("", ".html", ".PDF", "/a.md", ".docx?x=1", ".tar.gz", "/"))), (F.col("page_id") % 7 + 1).cast("int"))
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), ends)
    return pages.select("page_id", *[should_download(url, F.lit(k)).alias(k) for k in ("web_site", "web_links")])


def q_previewed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file before its import, one in nine of a kind that has no parser."""
    docs = views.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("dir/f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, ".xyz").otherwise(".md"))
    files = docs.select(F.col("doc_id").alias("id"), name.alias("name"), F.concat(F.lit("./up//"), name).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return previewed(files).select("id", "path", "title", "status", "error", F.sha2("preview", 256).alias("preview_hash"))


QUERIES = {
    "local_sources": q_local_sources,
    "pages_by_url": q_pages_by_url,
    "served_set": q_served_set,
    "download_first": q_download_first,
    "previewed_files": q_previewed_files,
}


def _guid_sql(text: str) -> str:
    h = f"sha256({text})"
    byte = lambda i: f"substr({h}, {2 * i + 1}, 2)"
    parts = ["||".join(map(byte, (3, 2, 1, 0))), "||".join(map(byte, (5, 4))), "||".join(map(byte, (7, 6))), f"substr({h}, 17, 4)", f"substr({h}, 21, 12)"]
    return " || '-' || ".join(parts)


ORACLES = {
    "local_sources": f"""
WITH s AS (SELECT *, {_guid_sql("name")} AS g FROM src), who AS (
  SELECT (SELECT min({_guid_sql("r_name")}) FROM region) AS t, (SELECT min({_guid_sql("n_name")}) FROM nation) AS b)
SELECT id, CASE WHEN id % 3 = 1 THEN CASE WHEN id % 2 = 0 THEN 'local ' || name ELSE '{LOCAL}' END ELSE name END AS name,
  CASE WHEN id % 3 = 1 THEN 'd' ELSE 'about ' || name END AS description, CASE WHEN id % 3 = 1 THEN 'local_files' ELSE source_type END AS source_type,
  CASE WHEN id % 3 <> 2 THEN g END AS guid, CASE WHEN id % 3 = 1 THEN 'local://source/' || g ELSE address END AS address,
  CASE WHEN id % 3 = 1 THEN t ELSE 'old' END AS tenant_guid, CASE WHEN id % 3 = 1 THEN b ELSE 'old' END AS bank_guid,
  CASE id % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'updated' ELSE 'kept' END AS change FROM s, who
UNION ALL
SELECT (SELECT max(id) FROM src) + row_number() OVER (ORDER BY md5(g)), CASE WHEN id % 2 = 0 THEN 'local ' || name ELSE '{LOCAL}' END, 'd', 'local_files', g,
  'local://source/' || g, t, b, 'inserted' FROM s, who WHERE id % 3 = 2""",
    "pages_by_url": "SELECT key, id FROM incoming WHERE key IS NOT NULL",
    "served_set": """
WITH c AS (SELECT * FROM question WHERE served_count = (SELECT min(served_count) FROM question))
SELECT (SELECT count(*) FROM c) AS questions, (SELECT max(created_at) FROM c) AS newest, (SELECT count(*) FROM question) AS available,
  (SELECT least(count(*), 10) FROM c) AS drawn""",
    "download_first": r"""
SELECT page_id, kind IN ('pdf', 'md', 'docx') AS web_site, kind IN ('pdf', 'md', 'docx', 'html', 'htm') AS web_links FROM (
  SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' WHEN 3 THEN 'md' WHEN 4 THEN 'docx' WHEN 5 THEN 'gz'
    ELSE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '//[^/]*.*\.([^./]+)/?$', 1)) END AS kind,
  FROM (SELECT page_id, CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '//[^/]+/') THEN url ELSE 'x' END AS url FROM pages))""",
    "previewed_files": f"""
WITH f AS (
  SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents
), c AS (SELECT doc_id, trim(regexp_replace(translate(t, chr(13) || chr(10), '  '), ' +', ' ', 'g'), ' ') AS c FROM f
), p AS (SELECT doc_id, CASE WHEN c = '' THEN 'dir/f' || doc_id || '.md' ELSE c END AS c FROM c)
SELECT doc_id AS id, 'up/dir/f' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.xyz' ELSE '.md' END AS path, 'f' || doc_id AS title,
  CASE WHEN doc_id % 9 = 0 THEN 'parse_failed' ELSE 'parsed' END AS status, CASE WHEN doc_id % 9 = 0 THEN 'unsupported file type: xyz' END AS error,
  sha256(CASE WHEN doc_id % 9 = 0 THEN '{NO_PREVIEW}' WHEN length(c) <= 360 THEN c ELSE rtrim(left(c, 360), ' ') || '...' END) AS preview_hash FROM p""",
}
