"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, and what stands between words: the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

#: Most bytes of keys that may be broadcast; a larger side is joined by shuffle.
BROADCAST_BYTES = 64 << 20

#: Most keys that `join_uneven` broadcasts: a key that has less than this part of all rows isn't hot.
HOT_KEYS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session (tests, a laptop) has none, a local folder is set. On
    a cluster that would lose data, so it is an error there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives the planner true sizes.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def forget(*kept: DataFrame) -> None:
    """Delete what `keep` wrote, once all that is made from it is written too."""
    for df in kept:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_or_not(keys: DataFrame, row_bytes: int | Column = 16) -> DataFrame:
    """``keys`` to be broadcast if their bytes are few enough, else as they are, for a shuffled join.

    ``row_bytes``: of each row; an expression where rows hold lists.
    """
    size = keys.agg(F.sum(row_bytes)).first()[0] or 0 if isinstance(row_bytes, Column) else keys.count() * row_bytes
    return F.broadcast(keys) if size <= BROADCAST_BYTES else keys


def join_uneven(rows: DataFrame, named: DataFrame, on: Sequence[str], count: str) -> DataFrame:
    """``rows`` joined with ``named``, which has a row for each key and, in ``count``, how many of ``rows`` have it.

    The keys that most rows have, ``HOT_KEYS`` at most, are broadcast, so that
    none of them is one task's; a key of the others has no more than that part
    of all rows, and is joined by shuffle.
    """
    total = named.agg(F.sum(count)).first()[0] or 0
    least = max(64, -(-total // HOT_KEYS))
    hot = named.where(F.col(count) >= least)
    rest = [c for c in named.columns if c not in on]
    [mark] = fresh(rows, "_hot")
    marked = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), [*on], "left")
    found = marked.where(F.col(mark)).drop(mark)
    others = marked.where(F.col(mark).isNull()).drop(mark, *rest)
    return found.unionByName(others.join(named.where(F.col(count) < least), [*on]))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` doesn't have yet, in any case."""
    known = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        found.append(name)
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    totals: dict[str, Column],
    within: Sequence[str] = (),
) -> DataFrame:
    """Running sums in a global order, without a window over all rows.

    Rows are range-partitioned by ``within`` and ``order``; each partition gets
    the sum of those before it (one row per partition and group), and a window
    runs inside a partition only. So one group holding most rows is still
    spread over all tasks. ``within`` columns must not be null. Rows that tie
    on ``order`` take any order among themselves.
    """
    ranged = keep(
        df.repartitionByRange(*[F.col(c) for c in within], *order).withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    keys = ["_part", *within]
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys).agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in totals.items()])
    offsets = offsets.select(
        *keys, *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in totals]
    )
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.select("*", *[F.sum(v).over(upto).alias(k) for k, v in totals.items()])
    out = inside.join(offsets, keys)
    for k in totals:
        out = out.withColumn(k, F.col(k) + F.col(f"_before_{k}"))
    return out.drop("_part", *[f"_before_{k}" for k in totals])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as many as the longest array so far needs."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            make = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
            self.up, self.down = make(np.uint64(self.base)), make(np.uint64(pow(self.base, -1, 2**64)))
        return self.up, self.down

    def sums(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum of values[start + k] * base^k over each range: the same for equal ranges, wherever they stand."""
        up, down = self.of(len(values) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
            return (total[ends] - total[starts]) * down[starts]


powers = Powers(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 stand between words."""
    return _SPACES[data]


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and 64-bit hashes of the words of ``data``, bytes of UTF-8."""
    edges = np.flatnonzero(np.diff(~is_space(data), prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    return starts, ends, mix64(powers.sums(data.astype(np.uint64) + np.uint64(1), starts, ends))


def hash_windows(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` words in a row, from the words' hashes."""
    at = np.arange(max(0, len(words) - n + 1))
    return mix64(powers.sums(words, at, at + n) + np.uint64(n))
