"""Sharding by Karmarkar-Karp differencing.

Groups (here: equal texts) are indivisible and go to ``n_shards`` shards of
near equal bytes. Multi-way differencing starts with one partial partition a
group (its bytes in one part, the others empty) and repeatedly combines the two
with the largest spread, the heaviest part of one with the lightest of the
other. A combination of partial partitions is again a partial partition, so
the work is a tree: groups are hashed into bins of bounded size, each task
differences one bin, and the bins' results are differenced in turn, level by
level, until one partition is left. No task or driver ever holds more than a
bin of groups or of partial partitions. Up to ``GROUPS_PER_BIN`` groups that is
differencing as it is defined; beyond, the order of the method holds within a
bin, and the largest spreads of different bins meet when bins are combined.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, running_totals, table

GROUPS_PER_BIN = 8192
PARTS_PER_BIN = 512
ROW_BYTES = 16


def difference(loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions, the rows of ``loads`` (n x k), into one.

    Returns (k part totals, n x k: where each part of each row went). Of rows
    with the same spread the earlier comes first; parts of equal load keep
    their order.
    """
    n, k = loads.shape
    tree: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    heap = [(int(row.min()) - int(row.max()), i) for i, row in enumerate(loads)]
    heapq.heapify(heap)
    held = dict(enumerate(loads))
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = held.pop(a), held.pop(b)
        down, up = np.argsort(-x, kind="stable"), np.argsort(y, kind="stable")
        joined = x[down] + y[up]
        at_a, at_b = np.empty(k, np.int32), np.empty(k, np.int32)
        at_a[down] = at_b[up] = np.arange(k)
        tree.append((a, at_a, b, at_b))
        made = n + len(tree) - 1
        held[made] = joined
        heapq.heappush(heap, (int(joined.min()) - int(joined.max()), made))
    went: dict[int, np.ndarray] = {heap[0][1]: np.arange(k, dtype=np.int32)}
    total = held[heap[0][1]]
    for made in range(len(tree) - 1, -1, -1):
        a, at_a, b, at_b = tree[made]
        to = went.pop(n + made)
        went[a], went[b] = to[at_a], to[at_b]
    return total, np.stack([went[i] for i in range(n)])


def _bins(n: int, most: int) -> int:
    return max(1, -(-n // most))


def place_groups(groups: DataFrame, n_shards: int) -> DataFrame:
    """Shard of each of ``groups`` (group, bytes; group unique): group, shard."""
    n_bins = _bins(groups.count(), GROUPS_PER_BIN)
    binned = groups.select("group", "bytes", F.pmod(F.xxhash64("group"), F.lit(n_bins)).cast("long").alias("bin"))

    def first_level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True], ignore_index=True)
        loads = np.zeros((len(pdf), n_shards), np.int64)
        loads[:, 0] = pdf["bytes"]
        _, went = difference(loads)
        return pdf.assign(part=went[:, 0].astype(np.int64))[["group", "bytes", "bin", "part"]]

    placed = keep(
        binned.groupBy("bin").applyInPandas(first_level, "group string, bytes long, bin long, part long"), "parts"
    )
    # the partial partition of each bin: bytes of its parts
    loads = placed.groupBy("bin", "part").agg(F.sum("bytes").alias("bytes"))
    steps = []
    while n_bins > 1:
        n_up = _bins(n_bins, PARTS_PER_BIN)

        def next_level(pdf: pd.DataFrame) -> pd.DataFrame:
            bins = np.sort(pdf["bin"].unique())
            of_bin = np.zeros((len(bins), n_shards), np.int64)
            of_bin[np.searchsorted(bins, pdf["bin"]), pdf["part"]] = pdf["bytes"]
            _, went = difference(of_bin)
            return pd.DataFrame(
                {
                    "bin": np.repeat(bins, n_shards),
                    "part": np.tile(np.arange(n_shards), len(bins)),
                    "bytes": of_bin.ravel(),
                    "up": pdf["up"].iloc[0],
                    "up_part": went.ravel().astype(np.int64),
                }
            )

        step = loads.withColumn("up", F.pmod(F.xxhash64("bin"), F.lit(n_up)).cast("long"))
        step = keep(
            step.groupBy("up").applyInPandas(next_level, "bin long, part long, bytes long, up long, up_part long"),
            "level",
        )
        steps.append(step)
        loads = step.groupBy(F.col("up").alias("bin"), F.col("up_part").alias("part")).agg(
            F.sum("bytes").alias("bytes")
        )
        # hashing may leave bins without rows; their number still bounds the next level
        n_bins = n_up
    for step in steps:
        placed = (
            placed.join(step.select("bin", "part", "up", "up_part"), ["bin", "part"])
            .drop("bin", "part")
            .withColumnsRenamed({"up": "bin", "up_part": "part"})
        )
    return placed.select("group", F.col("part").cast("int").alias("shard"))


def shard(docs: DataFrame, n_shards: int = 40, group: Column | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Shards for the rows of ``docs`` (doc_id, text), rows of a group together.

    Returns doc_id, size, text_crc32, group, shard (from 0) and slot (from 0,
    gapless in a shard, by doc_id). ``group``: a string column, by default the
    digest of the text, so that equal texts stay together. Shards get near
    equal bytes; no partition can be better than its largest group.

    Null texts count as empty. Rows with one doc_id are separate rows; those
    that are equal throughout take any order of slots. With fewer groups than
    shards some shards stay empty, as all do for an empty table. Other columns
    are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.md5(text.cast("binary")) if group is None else F.coalesce(group.cast("string"), F.lit(""))
    rows = keep(
        docs.select(
            "doc_id",
            (F.octet_length(text) + row_bytes).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            key.alias("group"),
        ),
        "rows",
    )
    shards = place_groups(rows.groupBy("group").agg(F.sum("size").alias("bytes")), n_shards)
    placed = rows.join(shards, "group")
    order = [F.col("doc_id"), F.col("group")]
    numbered = running_totals(placed, order, {"slot": F.lit(1)}, within=["shard"])
    return numbered.withColumn("slot", (F.col("slot") - 1).cast("long"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together."""
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict[str, str] = {}
