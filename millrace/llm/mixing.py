"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, up to
``max_epochs`` times over. A copy of a document finishes at virtual time

    (tokens of its source up to and including this copy) / (weight of the source)

and the mix is the copies in order of that time until the token budget is
spent. All queues advance in proportion to their weights; one that runs dry
after ``max_epochs`` stops, and what is left is shared by weight among the
others, which is just the capped, re-shared target.

Only DataFrame functions are used. The order is found by range partitioning
and running sums (`common.running_totals`), so a source that holds most rows is
spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, n_words, running_totals, table

MAX_EPOCHS = 3


def _sources(sized: DataFrame, budget: int, weights: Column | None, max_epochs: int) -> DataFrame:
    """A row per source: rank by name, weight, size and capped target."""
    named = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = named.withColumn("_null", F.col("source").isNull().cast("int"))
    ranked = running_totals(named, [F.col("_null"), F.col("source")], {"rank": F.lit(1)})
    # 1, 2, 3 and again, unless weights are given
    cycle = (F.col("rank") - 1) % 3 + 1 if weights is None else weights
    ranked = ranked.select("source", "rank", "source_size", cycle.cast("double").alias("weight"))
    # sources by the level at which they run dry: those below the common level give all they have
    ranked = ranked.withColumn("dry_at", max_epochs * F.col("source_size") / F.col("weight"))
    ranked = keep(ranked, "sources")
    poured = running_totals(
        ranked,
        [F.col("dry_at"), F.col("rank")],
        {"dry_size": max_epochs * F.col("source_size"), "dry_weight": F.col("weight")},
    )
    whole = ranked.agg(F.sum("weight").alias("all_weight"))
    poured = poured.crossJoin(F.broadcast(whole))  # one row
    # level if just the sources before this one are dry
    level = (F.lit(float(budget)) - (F.col("dry_size") - max_epochs * F.col("source_size"))) / (
        F.col("all_weight") - (F.col("dry_weight") - F.col("weight"))
    )
    poured = keep(poured.withColumn("level", level), "levels")
    # the first source that isn't dry sets the level of all that aren't
    common = poured.where(F.col("dry_at") > F.col("level")).agg(
        F.min(F.struct("dry_at", "rank", "level"))["level"].alias("common")
    )
    poured = poured.crossJoin(F.broadcast(common))  # one row
    target = F.when(
        F.col("common").isNull() | (F.col("dry_at") <= F.col("common")), F.lit(float(max_epochs)) * F.col("source_size")
    ).otherwise(F.col("common") * F.col("weight"))
    return poured.select("source", "rank", "weight", "source_size", target.cast("double").alias("target"))


def shuffle_key(seed: int) -> Column:
    """What the documents of a source are shuffled by."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    budget: int | None = None,
    weights: Column | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    size: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How often each row of ``docs`` (doc_id, source, text) is in the mix.

    Returns doc_id, source, size, source_size, weight, target, epochs, taken,
    a row per input row, and the columns named in ``carry``. ``budget``: tokens
    of the mix, all by default.
    ``weights``: a column over ``source`` and ``rank`` (from 1, by code point,
    null last), by default 1, 2, 3 repeating. A mix never holds part of a
    document, so it ends within one document of the budget.

    Null or empty texts have size 0 and are never taken; null sources are one
    source; rows with the same doc_id are separate documents; rows that tie in
    all of doc_id, source and size are taken alike or differ by which comes
    first. An empty table gives an empty mix. Other columns are ignored.
    """
    measured = n_words(F.col("text")) if size is None else size
    sized = keep(docs.select("doc_id", "source", measured.alias("size"), *carry), "sized")
    if budget is None:
        budget = sized.agg(F.sum("size")).first()[0] or 0
    sources = keep(_sources(sized, budget, weights, max_epochs), "targets")
    queued = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    queued = queued.drop("_source").withColumn("_shuffled", shuffle_key(seed))
    order = [F.col("_shuffled"), F.col("doc_id"), F.col("size"), *map(F.col, carry)]
    queued = running_totals(queued, order, {"_done": F.col("size")}, within=["rank"])
    queued = keep(queued, "queued")

    finish = (F.col("epoch") * F.col("source_size") + F.col("_done")) / F.col("weight")
    copies = queued.where("size > 0").select(
        "size", "rank", "_shuffled", "doc_id", "source_size", "weight", "_done",
        F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"),
    )
    copies = copies.select(finish.alias("finish"), "rank", "_shuffled", "doc_id", "size", "epoch")
    key = ["finish", "rank", "_shuffled", "doc_id"]
    served = running_totals(copies, [F.col(c) for c in key], {"served": F.col("size")})
    last = served.where(F.col("served") <= budget).agg(F.max(F.struct(*key)).alias("last"))
    queued = queued.crossJoin(F.broadcast(last))  # one row

    def is_taken(epoch: int) -> Column:
        at = (F.lit(epoch) * F.col("source_size") + F.col("_done")) / F.col("weight")
        taken = F.struct(at.alias("finish"), "rank", "_shuffled", "doc_id") <= F.col("last")
        return F.coalesce(taken & (F.col("size") > 0), F.lit(False)).cast("int")

    epochs = sum((is_taken(e) for e in range(1, max_epochs)), is_taken(0))
    return queued.select(
        "doc_id", "source", "size", "source_size", "weight", "target", epochs.alias("epochs"), *carry
    ).withColumn("taken", F.col("size") * F.col("epochs"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by words to 100 % of all words."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {
    "op2_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size) / ((rank - 1) % 3 + 1)::DOUBLE AS dry_at,
    (SELECT sum(size) FROM sized)::DOUBLE AS budget FROM ranked
), leveled AS (
  SELECT *, (budget - (sum(3 * source_size) OVER o - 3 * source_size)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level
  FROM weighed WINDOW o AS (ORDER BY dry_at, rank ROWS UNBOUNDED PRECEDING)
), aimed AS (
  SELECT *, CASE WHEN common IS NULL OR dry_at <= common THEN 3.0::DOUBLE * source_size ELSE common * weight END AS target
  FROM leveled, (SELECT arg_min(level, dry_at) AS common FROM leveled WHERE dry_at > level)
), queued AS (
  SELECT d.*, t.rank, t.source_size, t.weight, t.target, t.budget, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS shuffled,
    sum(size) OVER (PARTITION BY t.rank ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS done
  FROM sized d JOIN aimed t ON d.source IS NOT DISTINCT FROM t.source
), served AS (
  SELECT doc_id, shuffled, rank, budget, sum(size) OVER (
    ORDER BY (epoch * source_size + done)::DOUBLE / weight, rank, shuffled, doc_id ROWS UNBOUNDED PRECEDING) AS served
  FROM queued, range(3) AS e(epoch) WHERE size > 0
), counted AS (
  SELECT doc_id, count(*)::INT AS epochs FROM served WHERE served <= budget GROUP BY doc_id
)
SELECT q.doc_id, size, source_size, target, size * coalesce(epochs, 0) AS taken, source, coalesce(epochs, 0)::INT AS epochs
FROM queued q LEFT JOIN counted c ON c.doc_id = q.doc_id
"""
}
