"""Suggested questions: eligibility, metadata, parsing, completion from templates, rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_question
from ..functions.urls import topic_of
from ..sources import views
from .eligibility import is_active, usable

TARGET = 100
LEAST_CHARS = 12
MAX_REFERENCES = 3
# Fixed value: a generated line: bullet or number, one to three ids, a separator, the question.
LINE = r"(?i)^\s*(?:[-*+]\s+|\d+[\.)]\s+)?(?:document[_\s-]?ids?\s*[:=#]?\s*)?(\d+(?:\s*,\s*\d+){0,2})\s*[|:\-–—]\s*(.+?)\s*$"

# The questions that are asked of any topic.
TEMPLATES = (
    "{} hakkında hangi bilgiler yer alıyor?",
    "{} kapsamında bilgi kaynağı ne anlatıyor?",
    "{} ile ilgili hangi hizmet veya çözümler öne çıkıyor?",
    "{} konusunda hangi süreçler, politikalar veya sorumluluklar belirtiliyor?",
    "{} hakkında kullanıcıların bilmesi gereken temel noktalar nelerdir?",
    "{} başlığında hangi ihtiyaçlara cevap veriliyor?",
    "{} sayfasındaki ana mesajlar nelerdir?",
    "{} ile ilgili hangi detaylar bilgi bankasında bulunuyor?",
    "{} hakkında hangi örnek sorular sorulabilir?",
    "{} içeriği bilgi kaynağını anlamak için nasıl kullanılabilir?",
)
NO_TOPIC = "Bilgi kaynağı"


def eligible(questions: DataFrame, refs: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Questions that have references, all of them to active documents of active sources."""
    active = docs.where(is_active(docs)).select(F.col("id").alias("document_id"))
    live = sources.where("is_enabled and not is_archived").select(F.col("id").alias("source_id"))
    invalid = refs.join(active, "document_id", "left_anti").select("question_id").union(
        refs.join(live, "source_id", "left_anti").select("question_id")
    )
    with_refs = questions.join(refs.select(F.col("question_id").alias("id")), "id", "left_semi")
    return with_refs.join(invalid.select(F.col("question_id").alias("id")), "id", "left_anti")


def metadata(found: DataFrame) -> DataFrame:
    """Number of questions, the newest's time and fingerprint."""
    return found.agg(
        F.count("*").alias("available"),
        F.max("created_at").alias("newest"),
        F.max_by("fingerprint", F.struct("created_at", "id")).alias("fingerprint"),
    )


def assemble(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Questions with the sorted, distinct ids of their documents."""
    lists = refs.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    return found.join(lists, "id", "left")


def rotation(found: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """The ``n`` (1 to 10; below 1: 4) questions served least, drawn at random among equals."""
    n = 4 if n < 1 else min(n, 10)
    return found.orderBy("served_count", F.xxhash64(F.lit(seed), "id")).limit(n)


def serve(questions: DataFrame, served: DataFrame, now: Column) -> DataFrame:
    """Questions after serving: counted, and stamped with the time; the others keep their last stamp, if they have one."""
    before = F.col("last_served_at") if "last_served_at" in questions.columns else F.lit(None)
    hit = served.select("id", F.lit(True).alias("_hit"))
    return questions.join(hit, "id", "left").select(
        *[c for c in questions.columns if c not in ("served_count", "last_served_at")],
        (F.col("served_count") + F.col("_hit").isNotNull().cast("int")).alias("served_count"),
        F.when(F.col("_hit"), now).otherwise(before).alias("last_served_at"),
    )


def parse(responses: DataFrame, docs: DataFrame, target: int = TARGET) -> DataFrame:
    """Questions in generated ``responses`` (response_id, text), with their known documents.

    Lines keep their order; of equal questions, ignoring case, the first stays.
    """
    lines = responses.select("response_id", F.posexplode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")).alias("line", "text"))
    parsed = lines.where(F.col("text").rlike(LINE)).select(
        "response_id", "line",
        normalize_question(F.regexp_extract("text", LINE, 2)).alias("question"),
        F.array_distinct(F.transform(F.split(F.regexp_extract("text", LINE, 1), r"\s*,\s*"), lambda x: x.cast("long"))).alias("ids"),
    )
    known = docs.where("source_id is not null").select(F.col("id").alias("document_id"))
    refs = parsed.select("response_id", "line", "question", F.posexplode("ids").alias("place", "document_id"))
    refs = refs.join(known, "document_id").groupBy("response_id", "line", "question").agg(
        F.array_sort(F.collect_list(F.struct("place", "document_id"))).alias("refs")
    )
    kept = refs.where(F.char_length("question") >= LEAST_CHARS)
    first = kept.groupBy("response_id", F.upper("question").alias("_key")).agg(
        F.min_by(F.struct("line", "question", "refs"), "line").alias("_first")
    )
    rank = F.row_number().over(Window.partitionBy("response_id").orderBy("line"))
    rows = first.select("response_id", "_first.*").withColumn("rank", rank).where(F.col("rank") <= target)
    ids = F.transform(F.slice("refs", 1, MAX_REFERENCES), lambda r: r["document_id"])
    return rows.select("response_id", "rank", "question", F.array_join(ids.cast("array<string>"), ",").alias("documents"))


def complete(generated: DataFrame, docs: DataFrame, target: int = TARGET) -> DataFrame:
    """``generated`` (rank, question, document_id), then template questions by document URL, up to ``target``.

    Of equal questions, ignoring case, the first stays. A document adds ten
    distinct questions or, if its topic came before, none; so only the first
    documents of each topic in order can matter, and just the first
    ``target`` topics are carried on.
    """
    bare = F.btrim(F.regexp_replace("title", r"(?U)\s+", " "), F.lit(" -|:"))
    topic = F.coalesce(F.nullif(bare, F.lit("")), F.nullif(topic_of(F.col("url")), F.lit("")), F.lit(NO_TOPIC))
    topics = docs.where("source_id is not null").select("id", F.upper("url").alias("_url"), topic.alias("topic"))
    firsts = topics.groupBy(F.upper("topic").alias("_key")).agg(F.min(F.struct("_url", "id", "topic")).alias("_first"))
    firsts = firsts.select("_first.*").orderBy("_url", "id").limit(target)
    asked = F.array(*[F.concat(F.lit(a), F.col("topic"), F.lit(b)) for a, b in (t.split("{}") for t in TEMPLATES)])
    made = firsts.select("_url", F.col("id").alias("document_id"), F.posexplode(asked).alias("place", "question"))
    rows = generated.select(F.lit(0).alias("_made"), F.lit("").alias("_url"), "document_id", F.col("rank").alias("place"), "question").unionByName(
        made.withColumn("_made", F.lit(1))
    )
    rows = rows.withColumn("question", normalize_question(F.col("question"))).where(F.char_length("question") >= LEAST_CHARS)
    order = ["_made", "_url", "document_id", "place"]
    if_first = rows.groupBy(F.upper("question").alias("_key")).agg(F.min(F.struct(*order, "question")).alias("_first"))
    best = if_first.select("_first.*").orderBy(*order).limit(target)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "question", "document_id")


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return (
        views.questions(spark, sf_dir), views.question_documents(spark, sf_dir),
        views.documents(spark, sf_dir), views.sources(spark, sf_dir),
    )


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as generated lines: each sentence a line with ids."""
    said = views.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    lines = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.concat(F.lit("- "), (F.col("conv_id") + i).cast("string"), F.lit(", "), (F.col("turn") * 3).cast("string"), F.lit(" | "), s),
    )
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("response_id"), F.array_join(lines, "\n").alias("text"))


def q_eligible_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible(*_all(spark, sf_dir)).select("id", "question", "served_count")


def q_question_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(eligible(*_all(spark, sf_dir)))


def q_question_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, refs, *_ = _all(spark, sf_dir)
    found = assemble(questions, refs)
    return found.select("id", "question", F.array_join(F.col("documents").cast("array<string>"), ",").alias("documents"))


def q_parse_generated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_responses(spark, sf_dir), views.documents(spark, sf_dir))


def q_complete_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, _, docs, sources = _all(spark, sf_dir)
    first = questions.select((F.col("id") + 1).cast("int").alias("rank"), "question", F.col("id").alias("document_id"))
    return complete(first, usable(docs, sources))


def q_rotation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served counts of a sample: which of the equals are drawn is random."""
    return rotation(views.questions(spark, sf_dir), 6).select("served_count")


def q_served_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = views.questions(spark, sf_dir).withColumn("last_served_at", F.when(F.col("id") % 3 == 0, F.col("created_at")))
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp_ntz")
    # those due by count and id, so that every row can be told
    served = questions.where("served_count = 0").orderBy("id").limit(6)
    return serve(questions, served, at(2)).select("id", "served_count", "last_served_at")


QUERIES = {
    "eligible_questions": q_eligible_questions,
    "question_metadata": q_question_metadata,
    "question_assembly": q_question_assembly,
    "parse_generated_questions": q_parse_generated_questions,
    "complete_questions": q_complete_questions,
    "rotation_sample": q_rotation_sample,
    "served_questions": q_served_questions,
}

_NORMAL = (
    "trim(regexp_replace(regexp_replace(regexp_replace({}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[*_~]', '', 'g'), '\\s+', ' ', 'g'), ' \"''`-*.')"
)
_ELIGIBLE = """eligible AS (
  SELECT * FROM question q WHERE EXISTS (SELECT 1 FROM question_doc r WHERE r.question_id = q.id) AND NOT EXISTS (
    SELECT 1 FROM question_doc r LEFT JOIN doc d ON d.id = r.document_id LEFT JOIN src s ON s.id = r.source_id
    WHERE r.question_id = q.id AND (d.id IS NULL OR s.id IS NULL OR NOT d.is_enabled OR d.is_archived OR d.status_code <> 'ok'
      OR NOT s.is_enabled OR s.is_archived)))"""
_TEMPLATES = ", ".join(f"(topic || '{t[2:]}')" for t in TEMPLATES)
ORACLES = {
    "eligible_questions": f"WITH {_ELIGIBLE} SELECT id, question, served_count FROM eligible",
    "question_metadata": f"""WITH {_ELIGIBLE}
SELECT count(*) AS available, max(created_at) AS newest, arg_max(fingerprint, created_at) AS fingerprint FROM eligible""",
    "question_assembly": """
SELECT q.id, any_value(q.question) AS question, string_agg(DISTINCT r.document_id::VARCHAR, ',' ORDER BY lpad(r.document_id::VARCHAR, 9, '0')) AS documents
FROM question q LEFT JOIN question_doc r ON r.question_id = q.id GROUP BY q.id""".replace(
        "string_agg(DISTINCT r.document_id::VARCHAR, ',' ORDER BY lpad(r.document_id::VARCHAR, 9, '0'))",
        "array_to_string(list_sort(list(DISTINCT r.document_id) FILTER (r.document_id IS NOT NULL)), ',')",
    ),
    "parse_generated_questions": f"""
WITH line AS (
  SELECT conv_id * 1000 + turn AS response_id, conv_id, turn, i - 1 AS line, string_split(text, chr(10))[i] AS s
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations WHERE role = 'assistant')
), parsed AS (
  SELECT response_id, line, list_distinct([conv_id + line]) || CASE WHEN turn * 3 = conv_id + line THEN [] ELSE [turn * 3] END AS ids,
    {_NORMAL.format("trim(s)")} AS q FROM line WHERE length(trim(s)) > 0
), kept AS (
  SELECT response_id, line, ids, CASE WHEN q = '' OR q LIKE '%?' THEN q ELSE q || '?' END AS question FROM parsed
), refs AS (
  SELECT response_id, line, question, list(d.id ORDER BY place) AS documents
  FROM (SELECT *, unnest(ids) AS ref, generate_subscripts(ids, 1) AS place FROM kept) k
  JOIN doc d ON d.id = k.ref WHERE d.source_id IS NOT NULL AND length(question) >= 12 GROUP BY ALL
), firsts AS (
  SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY response_id, upper(question) ORDER BY line) = 1
)
SELECT * FROM (SELECT response_id, row_number() OVER (PARTITION BY response_id ORDER BY line)::INT AS rank, question,
  array_to_string(documents, ',') AS documents FROM firsts) WHERE rank <= 100""",
    "complete_questions": f"""
WITH usable AS (
  SELECT d.*, trim(regexp_replace(d.title, '\\s+', ' ', 'g'), ' -|:') AS topic FROM doc d LEFT JOIN src s ON s.id = d.source_id
  WHERE d.is_enabled AND NOT d.is_archived AND d.status_code = 'ok' AND length(trim(d.content, ' ')) > 0
    AND d.source_id IS NOT NULL AND s.is_enabled AND NOT s.is_archived
), made AS (
  SELECT 1 AS made, upper(url) AS url, id AS document_id, i AS place, [{_TEMPLATES}][i] AS raw FROM usable, range(1, 11) AS r(i)
  UNION ALL SELECT 0, '', id, id + 1, question FROM question
), normal AS (
  SELECT *, {_NORMAL.format("raw")} AS q FROM made
), named AS (
  SELECT *, CASE WHEN q = '' OR q LIKE '%?' THEN q ELSE q || '?' END AS question FROM normal
), firsts AS (
  SELECT * FROM named WHERE length(question) >= 12
  QUALIFY row_number() OVER (PARTITION BY upper(question) ORDER BY made, url, document_id, place) = 1
)
SELECT * FROM (SELECT row_number() OVER (ORDER BY made, url, document_id, place)::INT AS rank, question, document_id FROM firsts) WHERE rank <= 100""",
    "rotation_sample": "SELECT served_count FROM question ORDER BY served_count LIMIT 6",
    "served_questions": """
SELECT id, served_count + CASE WHEN hit THEN 1 ELSE 0 END AS served_count,
  CASE WHEN hit THEN TIMESTAMP '2024-01-02 00:00:00' WHEN id % 3 = 0 THEN created_at END AS last_served_at
FROM (SELECT *, served_count = 0 AND row_number() OVER (PARTITION BY served_count ORDER BY id) <= 6 AS hit FROM question)""",
}
