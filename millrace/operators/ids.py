"""Dense ids for new rows and running sums, without one window over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import scratch

#: Hex digits of a key's digest that name its range: 4096 ranges.
DIGITS = 3


def deal_ids(rows: DataFrame, key: Sequence[Column], after: DataFrame | None = None, column: str = "id", digits: int = DIGITS) -> DataFrame:
    """``rows`` with ``column``, numbers without gaps from 1 on, or from the greatest that ``after`` has in it.

    ``key`` tells rows apart: rows of one key get numbers in any order. The
    numbers follow the digests of the keys, so they depend on the keys alone.
    Ranges are the first ``digits`` of a digest, of equal size whatever the keys
    are; each is counted, and numbers its own rows from its offset. Only the
    ranges' counts, 16 ** ``digits`` at most, are summed up in one place and
    broadcast.
    """
    spelled = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    keyed = rows.withColumn("_digest", F.md5(spelled)).withColumn("_range", F.substring("_digest", 1, digits))
    counts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("_digest"))
    numbered = keyed.withColumn("_nth", nth).join(F.broadcast(offsets), "_range")
    number = F.col("_nth") + F.col("_before")
    if after is not None:
        # one row
        numbered = numbered.crossJoin(F.broadcast(after.agg(F.coalesce(F.max(column), F.lit(0)).alias("_last"))))
        number = number + F.col("_last")
    rest = [F.col(c) for c in rows.columns if c != column]
    return numbered.select(number.cast("long").alias(column), *rest)


def running(df: DataFrame, within: Sequence[str], order: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """``df`` with running sums, each row's own included, in ``order`` within equal ``within`` columns (not null).

    Rows are ranged by both and written; each range gets the sums of those
    before it, a row for each range and group, and a window runs inside a range
    only. So a group that has most of the rows is still spread over all tasks.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in (*within, *order)]
    ranged = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    path = scratch(spark, "ranged")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part", *within).agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in totals.items()])
    offsets = sums.select("_part", *within, *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in totals])
    upto = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.select("*", *[F.sum(v).over(upto).alias(f"_upto_{k}") for k, v in totals.items()]).join(offsets, ["_part", *within])
    return inside.select(*df.columns, *[(F.col(f"_upto_{k}") + F.col(f"_before_{k}")).alias(k) for k in totals])
