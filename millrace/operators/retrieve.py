"""Context blocks of documents, fingerprints, lexical scores and retrieval under a budget."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import citation_text, let, search_terms, search_text
from ..functions.urls import title_of
from ..sources import views
from .eligibility import displayable, usable, with_source

MAX_BLOCKS, MAX_CHARS = 12, 60_000
#: Lines of a fingerprint in a row of its digest's task.
CHUNK_LINES = 8192
# The name of a source without one, and the mark of a block.
NO_SOURCE, BLOCK = "Bilgi Bankası", "Knowledge Document"
#: Wording of prompts; a deployment gives its own.
RULES = "Answer only from these documents:"
CLOSING = "Cite only these labels:"
EMPTY = "There are no documents yet: say that the answer isn't here, and don't guess."
#: The question of the flagship query.
QUESTION = "What are the thanedble reinth and tionhe with 2024 pathetic lyourer?"


def blocks(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """A context block for each unarchived document with content, whose source is missing or unarchived.

    A source that is missing or has a blank name goes by the default name. Title,
    type and URL may be null: their places stay empty, and the label is the
    title that `citation_title` gives.
    """
    found = docs.where("not is_archived and status_code = 'ok' and length(trim(content)) > 0 and source_id is not null")
    known = with_source(found, sources).where("source_name is null or not source_archived")
    name = F.coalesce(F.nullif(F.trim("source_name"), F.lit("")), F.lit(NO_SOURCE))
    shown = F.coalesce(F.nullif(F.trim("title"), F.lit("")), title_of(F.col("url")), F.lit(""))
    named = known.withColumns({"source_name": name, "title": shown})
    label = F.concat_ws(" - ", "source_name", "title")
    lines = {
        "DocumentId": F.col("id").cast("string"), "SourceId": F.col("source_id").cast("string"), "SourceName": F.col("source_name"),
        "SourceType": F.col("source_type"), "DocumentTitle": F.col("title"), "DocumentUrl": F.col("url"), "CitationLabel": label,
    }
    head = [F.concat(F.lit(f"[{k}] "), F.coalesce(v, F.lit(""))) for k, v in lines.items()]
    marked = lambda mark: F.lit(f"[{mark}]")
    block = F.concat_ws("\n", marked(BLOCK), *head, marked("Content"), "content", marked("/Content"), marked("/" + BLOCK))
    return named.select(
        F.col("id").alias("document_id"), "source_id", "source_name", "source_type", "title", "url",
        label.alias("label"), "content_hash", block.alias("block"),
        "is_enabled", "source_enabled",
    )


def active_blocks(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Blocks of active documents of active sources."""
    return blocks(docs, sources).where("is_enabled and source_enabled")


def fingerprint(rows: DataFrame, id_column: str, hash_column: str) -> DataFrame:
    """SHA-256, in upper-case hex, of the lines ``id|hash`` in order of id, and their number: one row.

    All tasks sort their range of the lines and join them into chunks of
    ``CHUNK_LINES``. One digest of one ordered text is sequential by definition:
    one task takes the chunks in order and carries the digest from each to the
    next, holding one at a time. `tree_fingerprint` has no such task.
    """
    line = F.concat_ws("|", F.col(id_column).cast("string"), hash_column).alias("line")
    ranged = rows.select(F.col(id_column).alias("id"), line).repartitionByRange("id", "line").sortWithinPartitions("id", "line")
    # a chunk of nothing, so that there is a row where there are no lines
    first = rows.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).alias("nth"), F.lit(0).alias("n"), F.lit("").alias("text"))
    chunks = ranged.select("line").mapInArrow(_chunked, "part int, nth int, n int, text string").unionByName(first)
    return chunks.repartition(1).sortWithinPartitions("part", "nth").select("n", "text").mapInArrow(_digested, "fingerprint string, documents long")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, nth, held = TaskContext.get().partitionId(), 0, []
    for batch in batches:
        held += batch.column("line").to_pylist()
        while len(held) >= CHUNK_LINES:
            yield pa.RecordBatch.from_pydict(_chunk(part, nth, held[:CHUNK_LINES]))
            held, nth = held[CHUNK_LINES:], nth + 1
    if held:
        yield pa.RecordBatch.from_pydict(_chunk(part, nth, held))


def _chunk(part: int, nth: int, lines: list[str]) -> dict[str, pa.Array]:
    numbers = {"part": part, "nth": nth, "n": len(lines)}
    return {k: pa.array([v], pa.int32()) for k, v in numbers.items()} | {"text": pa.array(["\n".join(lines)])}


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, total = hashlib.sha256(), 0
    for batch in batches:
        for n, text in zip(batch.column("n").to_pylist(), batch.column("text"), strict=True):
            if n:
                digest.update(("\n" if total else "").encode() + text.as_py().encode())
                total += n
    yield pa.RecordBatch.from_pydict({"fingerprint": pa.array([digest.hexdigest().upper()]), "documents": pa.array([total], pa.int64())})


def tree_fingerprint(rows: DataFrame, id_column: str, hash_column: str, buckets: int = 4096) -> DataFrame:
    """As `fingerprint`, of digests of ``buckets`` of documents: it changes whenever a line does, but has other values."""
    return sealed(bucket_sums(rows, id_column, hash_column, buckets))


def bucket_sums(rows: DataFrame, id_column: str, hash_column: str, buckets: int = 4096) -> DataFrame:
    """bucket, low, high and n: sums of the halves of the hashes of a bucket's lines, and their number.

    They don't depend on order, and lines can be taken out and added later.
    """
    bucket = F.pmod(F.xxhash64(id_column), F.lit(buckets)).cast("int").alias("bucket")
    low, high = F.shiftright(F.xxhash64(id_column, hash_column), 32), F.xxhash64(id_column, hash_column).bitwiseAND(0xFFFFFFFF)
    return rows.groupBy(bucket).agg(F.sum(low).alias("low"), F.sum(high).alias("high"), F.count("*").alias("n"))


def sealed(sums: DataFrame) -> DataFrame:
    """The fingerprint of `bucket_sums`, and the number of buckets that have lines."""
    lines = sums.where("n > 0").select("bucket", F.concat_ws(":", "low", "high", "n").alias("_sum"))
    return fingerprint(lines, "bucket", "_sum").withColumnRenamed("documents", "buckets")


def scored(found: DataFrame, terms: Column) -> DataFrame:
    """Blocks with a score: 12 for each term within source, title or URL, 2 for each within the block."""
    texts = F.struct(
        search_text(F.concat_ws(" ", "source_name", "title", "url")).alias("header"), search_text(F.col("block")).alias("body")
    )

    def score(x: Column) -> Column:
        hits = lambda part, t, n: F.when(F.contains(x[part], t), n).otherwise(0)
        return F.aggregate(terms, F.lit(0), lambda total, t: total + hits("header", t, 12) + hits("body", t, 2))

    return found.withColumn("score", let(texts, score))


def top_under_budget(found: DataFrame, max_blocks: int = MAX_BLOCKS, max_chars: int = MAX_CHARS) -> DataFrame:
    """The best blocks, in order, until there are enough or the next one would break the budget.

    Only ``max_blocks`` rows can be chosen, so each task keeps as many and one
    task orders just these.
    """
    order = [F.desc("score"), F.upper("title"), F.col("document_id")]
    # blocks without a score are last; left out after the limit, so scores are computed once
    best = found.withColumn("chars", F.char_length("block")).orderBy(*order).limit(max_blocks).where("score > 0")
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = best.withColumns({"rank": F.row_number().over(Window.orderBy(*order)), "used_chars": F.sum("chars").over(upto)})
    return ranked.where((F.col("rank") == 1) | (F.col("used_chars") <= max_chars))


def retrieve(spark: SparkSession, found: DataFrame, question: str) -> DataFrame:
    terms = spark.range(1).select(search_terms(F.lit(question)).alias("terms")).first()["terms"]
    literal = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    return top_under_budget(scored(found, literal))


def system_prompt(found: DataFrame, rules: str = RULES, closing: str = CLOSING, empty: str = EMPTY) -> DataFrame:
    """One row: the number of ``blocks`` and the ``prompt`` of them.

    The rules, the blocks by source, title and id, the closing and the labels in
    order, case ignored. Without blocks it is the text of an empty bank.
    ``found`` is what a budget chose (`top_under_budget`), so one row holds it.
    """
    ordered = lambda c, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, F.col(c).alias("_x")))), lambda s: s["_x"])
    each = F.array_join(ordered("block", "source_name", "title", "document_id"), "\n\n")
    labels = F.transform(ordered("label", F.upper("label").alias("_k"), F.col("document_id")), lambda x: F.concat(F.lit("- "), x))
    text = F.concat_ws("\n", F.lit(rules + "\n"), each, F.lit("\n" + closing), F.array_join(labels, "\n"))
    return found.agg(F.count("*").alias("blocks"), F.when(F.count("*") > 0, text).otherwise(empty).alias("prompt"))


def runtime_rules(questions: Column, sources_shown: Column) -> Column:
    """What the settings add to a prompt: how many questions to suggest (1 to 10), and whether sources are named."""
    n = F.least(F.greatest(questions, F.lit(1)), F.lit(10)).cast("string")
    named = F.when(sources_shown, "Name the sources in one line.").otherwise("Don't name sources.")
    return F.concat(F.lit("Suggest "), n, F.lit(" questions at most.\n"), named)


def runtime_prompt(prompt: Column, questions: Column, sources_shown: Column) -> Column:
    return F.concat_ws("\n\n", prompt, runtime_rules(questions, sources_shown))


def user_message(question: Column, questions: Column, sources_shown: Column) -> Column:
    """The trimmed question between its marks, then the rules once more; null is an empty question."""
    asked = F.trim(F.coalesce(question, F.lit("")))
    return F.concat(F.lit("[Question]\n"), asked, F.lit("\n[/Question]\n"), runtime_rules(questions, sources_shown))


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.documents(spark, sf_dir), views.sources(spark, sf_dir)


def q_retrieve_topk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve(spark, active_blocks(*_model(spark, sf_dir)), QUESTION)
    return found.select("rank", "document_id", "title", "score", "chars", "used_chars").orderBy("rank")


def q_active_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_blocks(*_model(spark, sf_dir)).select("document_id", "source_name", "label", "content_hash", "block")


def q_rebuilt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks(*_model(spark, sf_dir))
    return found.select("document_id", "source_name", "source_type", "label", F.sha2("block", 256).alias("block_hash"))


def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the active blocks and of the usable documents, and whether they agree."""
    docs, sources = _model(spark, sf_dir)
    cache = fingerprint(displayable(docs, sources).where("length(trim(content)) > 0"), "id", "content_hash")
    asked = fingerprint(usable(docs, sources), "id", "content_hash")
    both = cache.crossJoin(asked.select(F.col("fingerprint").alias("question_fingerprint")))  # one row each
    return both.withColumn("agree", F.col("fingerprint") == F.col("question_fingerprint"))


def q_system_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of the flagship question."""
    made = system_prompt(retrieve(spark, active_blocks(*_model(spark, sf_dir)), QUESTION))
    return made.select("blocks", F.sha2("prompt", 256).alias("prompt_hash"))


def q_runtime_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question asked as a message, with settings that differ between conversations."""
    asked = views.table(spark, sf_dir, "conversations").where("role = 'user'")
    n, shown = (F.col("conv_id") % 15).cast("int"), F.col("conv_id") % 2 == 0
    return asked.select("conv_id", "turn", F.sha2(user_message(F.col("text"), n, shown), 256).alias("message_hash"))


def q_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.array_join(F.array_sort(search_terms(F.col("text"))), " ").alias("terms"))


def q_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir)
    return docs.select("id", F.sha2(search_text(F.col("content")), 256).alias("search_hash"))


def q_citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks(*_model(spark, sf_dir))
    return found.select("document_id", citation_text(F.col("label")).alias("label_key"))


QUERIES = {
    "retrieve_topk_budget": q_retrieve_topk_budget,
    "active_blocks": q_active_blocks,
    "rebuilt_blocks": q_rebuilt_blocks,
    "fingerprint": q_fingerprint,
    "system_prompt": q_system_prompt,
    "runtime_prompts": q_runtime_prompts,
    "search_terms": q_search_terms,
    "search_text": q_search_text,
    "citation_labels": q_citation_labels,
}

_SEARCH = (
    "trim(regexp_replace(strip_accents(lower(translate({}, 'ıİşŞğĞüÜöÖçÇ', 'iissgguuoocc'))), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' ')"
)
_BLOCKS = """block AS (
  SELECT *, '[Knowledge Document]' || chr(10) || '[DocumentId] ' || document_id || chr(10) || '[SourceId] ' || source_id || chr(10)
    || '[SourceName] ' || source_name || chr(10) || '[SourceType] ' || coalesce(source_type, '') || chr(10) || '[DocumentTitle] ' || title || chr(10)
    || '[DocumentUrl] ' || url || chr(10) || '[CitationLabel] ' || label || chr(10) || '[Content]' || chr(10) || content || chr(10)
    || '[/Content]' || chr(10) || '[/Knowledge Document]' AS block FROM (
    SELECT d.id AS document_id, d.source_id, coalesce(s.name, 'Bilgi Bankası') AS source_name, s.source_type, d.title, d.url,
      coalesce(s.name, 'Bilgi Bankası') || ' - ' || d.title AS label, d.content_hash, d.content, d.is_enabled, s.is_enabled AS source_enabled
    FROM doc d LEFT JOIN src s ON s.id = d.source_id
    WHERE NOT d.is_archived AND d.status_code = 'ok' AND length(trim(d.content, ' ')) > 0 AND d.source_id IS NOT NULL
      AND (s.id IS NULL OR NOT s.is_archived)))"""
_TOP = f"""{_BLOCKS}, term AS (
  SELECT DISTINCT t FROM (SELECT unnest(string_split({_SEARCH.format("'" + QUESTION + "'")}, ' ')) AS t)
  WHERE length(t) >= 3 OR regexp_matches(t, '^[0-9]+$')
), text AS (
  SELECT *, {_SEARCH.format("concat_ws(' ', source_name, title, url)")} AS header, {_SEARCH.format("block")} AS body
  FROM block WHERE is_enabled AND source_enabled
), score AS (
  SELECT document_id, any_value(title) AS title, any_value(source_name) AS source_name, any_value(label) AS label,
    any_value(block) AS block, sum(12 * contains(header, t)::INT + 2 * contains(body, t)::INT)::INT AS score
  FROM text, term GROUP BY document_id
), ranked AS (
  SELECT *, length(block)::INT AS chars, row_number() OVER w::INT AS rank, sum(length(block)) OVER w AS used_chars FROM score
  WHERE score > 0 WINDOW w AS (ORDER BY score DESC, upper(title), document_id ROWS UNBOUNDED PRECEDING)
), top AS (SELECT * FROM ranked WHERE rank <= {MAX_BLOCKS} AND (rank = 1 OR used_chars <= {MAX_CHARS}))"""
_ACTIVE = "d.is_enabled AND NOT d.is_archived AND d.status_code = 'ok' AND length(trim(d.content, ' ')) > 0"
_PRINT = "upper(sha256(string_agg(d.id || '|' || d.content_hash, chr(10) ORDER BY d.id)))"
ORACLES = {
    "retrieve_topk_budget": f"WITH {_TOP} SELECT rank, document_id, title, score, chars, used_chars::BIGINT AS used_chars FROM top",
    "active_blocks": f"""WITH {_BLOCKS}
SELECT document_id, source_name, label, content_hash, block FROM block WHERE is_enabled AND source_enabled""",
    "rebuilt_blocks": f"""WITH {_BLOCKS}
SELECT document_id, source_name, source_type, label, sha256(block) AS block_hash FROM block""",
    "fingerprint": f"""
SELECT *, fingerprint = question_fingerprint AS agree FROM
  (SELECT {_PRINT} AS fingerprint, count(*) AS documents FROM doc d JOIN src s ON s.id = d.source_id
   WHERE {_ACTIVE} AND s.is_enabled AND NOT s.is_archived),
  (SELECT {_PRINT} AS question_fingerprint FROM doc d LEFT JOIN src s ON s.id = d.source_id
   WHERE {_ACTIVE} AND (s.id IS NULL OR (s.is_enabled AND NOT s.is_archived)))""",
    "system_prompt": f"""WITH {_TOP}
SELECT count(*) AS blocks, sha256(CASE WHEN count(*) = 0 THEN '{EMPTY.replace("'", "''")}' ELSE '{RULES}' || chr(10) || chr(10)
  || string_agg(block, chr(10) || chr(10) ORDER BY source_name, title, document_id) || chr(10) || chr(10) || '{CLOSING}' || chr(10)
  || string_agg('- ' || label, chr(10) ORDER BY upper(label), document_id) END) AS prompt_hash FROM top""",
    "runtime_prompts": """
SELECT conv_id, turn, sha256('[Question]' || chr(10) || trim(coalesce(text, ''), ' ') || chr(10) || '[/Question]' || chr(10)
  || 'Suggest ' || least(greatest(conv_id % 15, 1), 10) || ' questions at most.' || chr(10)
  || CASE WHEN conv_id % 2 = 0 THEN 'Name the sources in one line.' ELSE 'Don''t name sources.' END) AS message_hash
FROM conversations WHERE role = 'user'""",
    "search_terms": f"""
SELECT conv_id, turn, coalesce(string_agg(DISTINCT t, ' ' ORDER BY t) FILTER (length(t) >= 3 OR regexp_matches(t, '^[0-9]+$')), '') AS terms
FROM (SELECT conv_id, turn, unnest(string_split({_SEARCH.format("text")}, ' ')) AS t FROM conversations WHERE role = 'user')
GROUP BY conv_id, turn""",
    "search_text": f"SELECT id, sha256({_SEARCH.format('content')}) AS search_hash FROM doc",
    "citation_labels": f"""WITH {_BLOCKS} SELECT document_id,
  trim(regexp_replace(regexp_replace(label, '[^\\p{{L}}\\p{{Nd}}\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS label_key FROM block""",
}
