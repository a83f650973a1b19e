"""Quality rules as a short-circuit cascade.

A rule is a boolean column: true rejects the document. On a bounded sample
each rule's cost (seconds above a bare scan) and selectivity (share rejected)
are estimated, and rules run in descending order of rejection per cost; a later
rule is not evaluated for a document that an earlier one has rejected. Which
rule rejects a document may depend on that order, whether it is kept does not.
DataFrame functions only.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, fresh, keep, let, table

#: Expected number of rows of the sample that costs and selectivities come from.
SAMPLE_ROWS = 2000
WINDOW = 5
#: Times that each rule is timed on the sample; the median counts, as the first one compiles.
READINGS = 3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _covered(grams: Column) -> Column:
    """Number of words in those windows whose hash occurs twice or more."""
    spots = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def repeated(spots: Column) -> Column:
        twice = F.filter(
            spots, lambda s, i: (s["g"] == F.get(spots, i - 1)["g"]) | (s["g"] == F.get(spots, i + 1)["g"])
        )
        return F.sort_array(F.transform(twice, lambda s: s["i"]))

    def union(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.get(starts, i + 1) - s))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + F.coalesce(step, F.lit(WINDOW)))

    return let(spots, lambda s: let(repeated(s), union))


def repeat_words(words: Column) -> Column:
    """Number of words in ``WINDOW``-word windows found twice or more in ``words``."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(
        hashed,
        lambda h: F.transform(
            F.slice(h, 1, F.size(h) - WINDOW + 1), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])
        ),
    )
    covered = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _covered(g)).otherwise(0))
    return F.when(F.size(words) > WINDOW, covered).otherwise(0).cast("long")


def stutters(words: Column) -> Column:
    """Number of words equal to the word before."""
    same = F.filter(words, lambda w, i: w == F.get(words, i - 1))
    return F.size(same).cast("long")


def dup_lines(text: Column) -> Column:
    """Number of lines that have a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"{WORD}[^\n]*")).cast("long")


def word_chars(text: Column) -> Column:
    return (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


SYMBOL = r"[#*$%&|<>]"


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_stutters, in place of any so named.

    Null texts are empty: all six are 0. Long texts are read whole, rows
    counted one by one; other columns pass through.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutters")
    [counts] = fresh(docs, "_counted")
    text = F.coalesce("text", F.lit(""))
    counted = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            stutters(w).alias("n_stutters"),
        ),
    )
    return docs.withColumn(counts, counted).select(
        *[F.col(c) for c in docs.columns],
        F.col(counts)["n_words"].alias("n_words"),
        word_chars(text).alias("word_chars"),
        count_of(text, SYMBOL).alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
        F.col(counts)["n_repeat_words"].alias("n_repeat_words"),
        F.col(counts)["n_stutters"].alias("n_stutters"),
    )


def base_rules(text: Column) -> dict[str, Column]:
    """The two base rules, from the text alone."""
    return {
        "few_words": count_of(text, WORD) < 10,
        "repeated_windows": let(words_of(text), lambda w: 100 * repeat_words(w) > 20 * F.size(w)),
    }


def method_rules(text: Column) -> dict[str, Column]:
    """Further rules, each from the text alone: symbols, shouting, repeated lines, stuttering."""
    return {
        "symbols": 100 * count_of(text, SYMBOL) > 10 * word_chars(text),
        "shouting": 100 * count_of(text, r"\p{Lu}") > 40 * word_chars(text),
        "repeated_lines": 100 * dup_lines(text) > 40 * worded_lines(text),
        "stutter": let(words_of(text), lambda w: 100 * stutters(w) > 20 * F.size(w)),
    }


@dataclass(frozen=True)
class Estimate:
    rule: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-4)


def estimate(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on a sample of about ``sample_rows`` rows, best first.

    Of an empty table nothing can be estimated: rules keep their given order.
    """
    n = docs.count()
    if not n:
        return [Estimate(r, 0.0, 0.0) for r in rules]
    sample = keep(docs.sample(min(1.0, sample_rows / n), seed=11).repartition(1), "sample")

    def seconds(measured: Column) -> tuple[float, float]:
        took = []
        plan = sample.agg(F.avg(measured.cast("int")))
        for _ in range(READINGS):
            began = time.perf_counter()
            share = plan.first()[0]
            took.append(time.perf_counter() - began)
        return median(took), share or 0.0

    bare, _ = seconds(F.char_length("text") > 1)
    timed = {name: seconds(rule) for name, rule in rules.items()}
    found = [Estimate(name, max(s - bare, 0.0), share) for name, (s, share) in timed.items()]
    return sorted(found, key=lambda e: -e.worth)


def cascade(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> Column:
    """The name of the first rule, by rejection per cost, that rejects a row; null if none does."""
    verdict = F.when(F.lit(False), F.lit(""))
    for e in estimate(docs, rules, sample_rows):
        verdict = verdict.when(rules[e.rule], F.lit(e.rule))
    return verdict


def quality(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (with a column text) plus rejected_by, null for the rows to keep.

    By default all base and method rules. Null texts are empty, have no words
    and are rejected as too short; long ones are read whole. Rows are judged one
    by one: copies and rows of one doc_id get the same verdict. Where several
    rules reject a row, which of them is named depends on their measured order.
    A column rejected_by is replaced, others pass through. An empty table gives
    an empty result.
    """
    rules = rules or all_rules()
    return docs.withColumn("rejected_by", cascade(docs.select("text"), rules, sample_rows))


def all_rules() -> dict[str, Column]:
    """The base and method rules over the column text."""
    text = F.coalesce("text", F.lit(""))
    return base_rules(text) | method_rules(text)


def accepted(docs: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, as they are; see `quality`."""
    return docs.where(cascade(docs.select("text"), rules or all_rules()).isNull())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    verdict = cascade(docs.select("text"), method_rules(F.coalesce("text", F.lit(""))))
    figures = measure(docs)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = figures.withColumn("base_failed", base)
    kept = F.when(F.col("base_failed"), False).otherwise(verdict.isNull())
    return judged.withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {"op3_quality": op3_quality}
ORACLES = {
    "op3_quality": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) AS c
  FROM p WHERE i + 4 <= len(ws)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(5) AS x(k) WHERE c > 1 GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n FROM p WHERE i > 1 AND ws[i] = ws[i-1] GROUP BY doc_id
), f AS (
  SELECT w.doc_id, text, len(ls) AS lines, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(s.n, 0) AS n_stutters
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 40 * lines OR 100 * n_stutters > 20 * n_words
    OR 100 * len(regexp_extract_all(text, '\p{Lu}')) > 40 * word_chars) AS kept
FROM b
"""
}
