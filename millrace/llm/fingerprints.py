"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least of its inner s-mers, by
hash, lies at its first or last place. That depends on the k-mer alone, so the
same passage gives the same anchors wherever it stands, and what is edited
elsewhere changes none of them.

A fingerprint holds each anchor once, at its first position, in order of
position: 8 hex digits of hash and 8 of position. All anchors of a text are in
it, whatever its length, so it grows with the text: two in K - S + 1 places.

`matching` matches by position: common anchors vote for the shift between their
positions in the two texts, and those count that agree with another on theirs.
An edit moves all that follows by one shift, so a few shifts hold what two
versions have in common, and chance matches hold none.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table

K, S = 24, 8
#: Common anchors that must agree on a shift, where both texts have so many.
AGREE = 2
#: Bytes of text in a range of doc_id.
RANGE_BYTES = 64 << 20
_A = np.uint64(0x9E3779B97F4A7C15)


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of ``text``.

    ``s`` is a power of two that divides ``k``. A text of fewer than ``k`` code
    points is one anchor, an empty one has none.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(points)
    if n < k:
        rolled = np.uint64(n)
        with np.errstate(over="ignore"):
            for p in points:
                rolled = rolled * _A + p
        return np.zeros(min(n, 1), np.int64), mix64(np.array([rolled][: min(n, 1)], np.uint64))
    with np.errstate(over="ignore"):
        # hashes of all s-mers, by doubling; power: _A to the length so far
        rolled, power, length = points, _A, 1
        while length < s:
            rolled = rolled[:-length] * power + rolled[length:]
            power, length = power * power, 2 * length
        inner = mix64(rolled)
        # the least in each window of k - s + 1
        width = k - s + 1
        least, length = inner, 1
        while 2 * length <= width:
            least = np.minimum(least[:-length], least[length:])
            length *= 2
        if length < width:
            rest = width - length
            least = np.minimum(least[: len(least) - rest], least[rest:])
        at = np.flatnonzero((inner[: n - k + 1] == least) | (inner[k - s :] == least))
        whole = rolled[at]
        for j in range(s, k, s):
            whole = whole * power + rolled[at + j]
        return at, mix64(whole)


def fingerprint(text: str) -> str:
    at, hashed = anchors(text)
    short = (hashed >> np.uint64(32)).astype(np.uint32)
    # of equal ones the first
    order = np.argsort(short, kind="stable")
    first = order[np.append(True, short[order[1:]] != short[order[:-1]])] if len(order) else order
    short, at = short[first], at[first]
    order = np.argsort(at, kind="stable")
    rows = np.empty((len(at), 2), ">u4")
    rows[:, 0], rows[:, 1] = short[order], at[order]
    return rows.tobytes().hex()


def _read(print_: str) -> np.ndarray:
    """Hashes and positions (n x 2) of a fingerprint."""
    return np.frombuffer(bytes.fromhex(print_), ">u4").reshape(-1, 2).astype(np.int64)


def matching(a: str, b: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Shifts of b's positions against a's, how many common anchors agree on each, and the number of all anchors.

    The most agreed first, of equals the least shift.
    """
    x, y = _read(a), _read(b)
    _, in_x, in_y = np.intersect1d(x[:, 0], y[:, 0], assume_unique=True, return_indices=True)
    shifts, votes = np.unique(y[in_y, 1] - x[in_x, 1], return_counts=True)
    order = np.lexsort((np.abs(shifts), -votes))
    shifts, votes = shifts[order], votes[order]
    agreed = votes >= min(AGREE, len(x), len(y))
    return shifts[agreed], votes[agreed], len(x) + len(y) - len(in_x)


def likeness(a: str, b: str) -> float:
    """Share of the anchors of both texts that match by position, 0 to 1; two empty texts are alike."""
    if a == b:
        return 1.0
    _, votes, n = matching(a, b)
    return float(votes.sum() / n) if n else 0.0


def align(a: str, b: str) -> tuple[int, int]:
    """(shift, anchors): how far most common anchors of b stand behind those of a, and how many agree; (0, 0) if none do."""
    shifts, votes, _ = matching(a, b)
    return (int(shifts[0]), int(votes[0])) if len(shifts) else (0, 0)


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def with_next(docs: DataFrame, column: str = "text") -> tuple[DataFrame, str]:
    """Rows dealt into ranges of doc_id, each range with the first row of the next one as a guest.

    Returns a DataFrame sorted within partitions by bucket, guest, doc_id and
    text, and the name of its bucket column. Only the range starts, one for
    ``RANGE_BYTES`` of text, go through the driver and a broadcast: 1.6 million
    numbers for 100 TB. Rows of one doc_id are in one range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    n = max(4 * parts, -(-n_bytes // RANGE_BYTES))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    # ranges of ids alone; their starts are ids that exist, so that no range is empty
    ranged = ids.repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("start"))
    starts = np.sort(np.array([r["start"] for r in ranged.select("start").collect()], np.int64))
    low = int(starts[0]) if len(starts) else None
    sent = spark.sparkContext.broadcast(starts[1:])

    @F.pandas_udf("bucket int, guest int")
    def place(doc_id: pd.Series) -> pd.DataFrame:
        cuts = sent.value
        known = doc_id.notna().to_numpy()
        at = doc_id.fillna(0).to_numpy(np.int64)
        bucket = np.searchsorted(cuts, at, side="right")
        opens = np.zeros(len(at), bool)
        if len(cuts):
            opens = (bucket > 0) & (cuts[np.maximum(bucket, 1) - 1] == at)
        guest = np.where(opens, bucket - 1, -1)
        guest = np.where(known & (at == (0 if low is None else low)), len(cuts), guest)
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "guest": guest.astype(np.int32)})

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(column, F.lit("")).alias("text"))
    placed = placed.withColumn("_at", place("doc_id"))
    own = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(n))).otherwise(F.col("_at.bucket"))
    guest = F.when(F.col("doc_id").isNotNull() & (F.col("_at.guest") >= 0), F.col("_at.guest"))
    seats = F.array_compact(
        F.array(
            F.struct(own.cast("int").alias("bucket"), F.lit(0).alias("guest")),
            F.when(guest.isNotNull(), F.struct(guest.alias("bucket"), F.lit(1).alias("guest"))),
        )
    )
    seated = placed.select("doc_id", "text", F.inline(seats))
    return seated.repartition(max(parts, n // 4), "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text"), "bucket"


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text, and their likeness.

    The edited text takes its last quarter from the next row by doc_id (the
    last row's next is the first). Rows with one doc_id follow each other by
    text; rows without doc_id have no place in the order, and an empty next
    text. Null texts are empty; empty texts have an empty fingerprint. An
    empty table gives an empty result. Other columns are ignored.
    """
    seated, _ = with_next(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text, fingerprint

        def row(text: str, print_: str, following: str, next_print: str):
            edited = edit(text, following)
            edited_print = fingerprint(edited)
            sha = hashlib.sha256(edited.encode()).hexdigest()
            likes = likeness(print_, edited_print), likeness(print_, next_print)
            return len(text), sha, print_, edited_print, *likes

        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("bucket", "guest", "doc_id", "text")]
            for bucket, guest, doc_id, text in zip(*columns, strict=True):
                bucket, doc_id, text = bucket.as_py(), doc_id.as_py(), text.as_py()
                print_ = fingerprint(text)
                if held:
                    follows = held[0] == bucket and bucket >= 0
                    out.append((held[1], *row(held[2], held[3], *((text, print_) if follows else ("", "")))))
                held = None if guest.as_py() else (bucket, doc_id, text, print_)
            yield _batch(out)
        if held:
            yield _batch([(held[1], *row(held[2], held[3], "", ""))])

    return seated.mapInArrow(run, SCHEMA)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and the next documents."""
    return compare_next(table(spark, sf_dir, "documents"))


QUERIES = {"op5_fingerprints": op5_fingerprints}
ORACLES: dict[str, str] = {}
