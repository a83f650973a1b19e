"""A corpus pipeline over ``documents``, one of the llm operators a stage.

Each stage gets all that the one before it kept, as a table with the columns of
``documents`` and any others, which pass through; the last returns digests of
the encoded texts, a row for each copy of a document in the mix. Stages take
null and empty texts, texts of any length, missing and repeated doc_ids, and
empty tables, which give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import default_path, digests
from millrace.llm.common import WORD, fresh, keep, small_or_not, table
from millrace.llm.jaccard import linked_rows
from millrace.llm.mixing import mix
from millrace.llm.quality import accepted
from millrace.llm.secrets import find, redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that no quality rule rejects. Null and empty texts are rejected as too short; copies fare alike."""
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of least doc_id (none last), then of least text hash.

    Repeated rows and rows that share a doc_id are documents like any other:
    of rows equal in doc_id and text one stays. Texts without words, nulls
    included, link with nothing and all stay.
    """
    rows = keep(linked_rows(docs).where("root is not null").select("doc_id", "text_key", "root"), "rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    best = keep(best.select("best.doc_id", "best.text_key"), "best")
    doc, key, times = fresh(docs, "_doc", "_key", "_times")
    named = best.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key))
    id_, hash_ = F.col("doc_id").cast("long"), F.xxhash64("text")
    # rows that stand for a group together, as doc_id and text are equal
    same = rows.join(small_or_not(named, 24), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("text_key") == F.col(key)), "left_semi")
    same = same.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.count("*").alias(times))
    same = keep(same, "same")
    joined = docs.join(small_or_not(same, 32), id_.eqNullSafe(F.col(doc)) & (hash_ == F.col(key)))
    once = joined.where(F.col(times) == 1)
    again = joined.where(F.col(times) > 1).dropDuplicates([doc, key])
    wordless = docs.where(~F.coalesce("text", F.lit("")).rlike(WORD))
    out = [F.col(c) for c in docs.columns]
    return once.select(*out).union(again.select(*out)).union(wordless)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mark in the place of each secret and n_chars counted anew; null texts stay null."""
    base, spans = fresh(docs, "base_spans", "spans")
    found = find(docs, names=(base, spans))
    text = redact(F.col("text"), F.col(spans))
    n_chars = F.char_length("text").cast("long")
    whole = found.withColumn("text", text)
    return whole.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mix takes, none of texts without words.

    Rows are told apart by doc_id, source and text; those equal in all three
    get the copies that the first of them gets.
    """
    doc, source, key, epochs, copy = fresh(docs, "_doc", "_source", "_key", "_epochs", "_copy")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    taken = mix(keyed, carry=[key]).where("epochs > 0")
    taken = taken.groupBy(F.col("doc_id").alias(doc), F.col("source").alias(source), key).agg(F.max("epochs").alias(epochs))
    taken = small_or_not(keep(taken.withColumnRenamed(key, f"{key}_taken"), "taken"), 48)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source))
    copies = keyed.join(taken, same & (F.col(key) == F.col(f"{key}_taken")))
    return copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(epochs)))).select(*[F.col(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; null texts are empty."""
    return digests(docs, default_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: DuckDB has neither the tokenizer nor the order of the mix: the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
