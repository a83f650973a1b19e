"""Periodic runs of words, by masking and Main–Lorentz.

A run of period q has ``max(LEAST, POWER * q)`` words or more, so it and itself
moved by q words overlap in ``OVERLAP`` words at least, whatever q is. So every
word of a run stands in a k-gram, k = ``OVERLAP``, that its document has twice.
Words outside such k-grams are masked; runs lie within the segments between.
The test is made a second time inside each segment, where both places of a
k-gram have to be.

Main and Lorentz look for repetitions over the middle of ever larger blocks: a
run lies in a smallest block, whose middle it holds, and there two words q apart
either side of the middle are equal, as are those before and after them as far
as the run reaches. How far that is comes from ranks of all stretches of 2^j
words, so nothing rests on hashes. All segments of a batch are searched at once,
put one after another, with words between them that equal no other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_windows, mix64, table

#: Fewest words of a run, and how many times its period it has at least.
LEAST = 24
POWER = 3
#: Words that a run and itself moved by its period have in common at least: k of the k-grams.
OVERLAP = min(max(LEAST, POWER * q) - q for q in range(1, LEAST + 1))
#: Bytes of texts that are searched at once; a longer text is searched alone.
BATCH_BYTES = 1 << 21


class _Ids(dict):
    """A number for each word, dealt when it is first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _spans(flags: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Start and end (rows of two) of the stretches of set flags within equal values of ``group``."""
    starts = flags.copy()
    starts[1:] &= ~flags[:-1] | (group[1:] != group[:-1])
    ends = flags.copy()
    ends[:-1] &= ~flags[1:] | (group[1:] != group[:-1])
    return np.stack([np.flatnonzero(starts), np.flatnonzero(ends) + 1], 1)


def repeated_grams(words: np.ndarray, group: np.ndarray, k: int = OVERLAP) -> np.ndarray:
    """Start and end of the stretches of words that stand in k-grams which their group has twice."""
    covered = np.zeros(len(words), bool)
    if len(words) < k:
        return _spans(covered, group)
    grams = hash_windows(mix64(words.astype(np.uint64) + np.uint64(1)), k)
    at = np.flatnonzero(group[: len(grams)] == group[k - 1 :])
    grams = mix64(grams[at] ^ mix64(group[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    depth = np.zeros(len(words) + 1, np.int32)
    np.add.at(depth, at[twice], 1)
    np.add.at(depth, at[twice] + k, -1)
    return _spans(np.cumsum(depth[:-1]) > 0, group)


def _ranks(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """For j = 0, 1, ... ranks of the 2^j words from each place on; equal ranks are equal words."""
    found, step = [words.astype(np.int64)], 1
    while 2 * step <= longest:
        last = found[-1]
        both = last[: len(words) - 2 * step + 1] * (len(words) + 1) + last[step : len(words) - step + 1]
        order = np.argsort(both)
        rank = np.empty(len(both), np.int64)
        rank[order] = np.cumsum(np.append(False, both[order[1:]] != both[order[:-1]]))
        found.append(rank)
        step *= 2
    return found


def _reach(ranks: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
    """How many words from x and from y on (x < y) are equal, or before them."""
    far = np.zeros(len(x), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        rank, step = ranks[j], 1 << j
        # the longest stretch may fit more than once
        for _ in range(2 if j == len(ranks) - 1 else 1):
            a, b = (x - far - step, y - far - step) if back else (x + far, y + far)
            fits = (a >= 0) if back else (b < len(rank))
            equal = fits & (rank[np.where(fits, a, 0)] == rank[np.where(fits, b, 0)])
            far += np.where(equal, step, 0)
    return far


def main_lorentz(words: np.ndarray, longest: int) -> np.ndarray:
    """Runs (rows of start, end, period) of ``words``, small numbers; none has more than ``longest`` words."""
    n, none = len(words), np.zeros((0, 3), np.int64)
    if n < LEAST:
        return none
    ranks = _ranks(words, min(longest, n))
    found = [none]
    block = 1 << (LEAST - 1).bit_length()
    while True:
        middles = np.arange(block // 2, n, block)
        most = min(block, longest) // POWER
        low = 1
        while low <= most and len(middles):
            # of the words that must be equal on both sides, half are on one of them
            sure = max(low, OVERLAP // 2).bit_length() - 1
            high = min(most, (2 << sure) - 1)
            rank, step = ranks[sure], 1 << sure
            per = max(1, (1 << 20) // (high - low + 1))
            for at in range(0, len(middles), per):
                q = np.tile(np.arange(low, high + 1), len(middles[at : at + per]))
                middle = np.repeat(middles[at : at + per], high - low + 1)
                for x in (middle, middle - q):
                    y = x + q
                    after = (x >= 0) & (y < len(rank))
                    before = (x >= step) & (y - step < len(rank))
                    after[after] = rank[x[after]] == rank[y[after]]
                    before[before] = rank[x[before] - step] == rank[y[before] - step]
                    chosen = np.flatnonzero(after | before)
                    if not len(chosen):
                        continue
                    x, y, period = x[chosen], y[chosen], q[chosen]
                    start = x - _reach(ranks, x, y, True)
                    end = y + _reach(ranks, x, y, False)
                    long = end - start >= np.maximum(LEAST, POWER * period)
                    found.append(np.stack([start[long], end[long], period[long]], 1))
            low = high + 1
        if block >= n:
            break
        block *= 2
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # the same stretch has multiples of its period too
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def _long(segments: np.ndarray) -> np.ndarray:
    """The segments that have room for a run."""
    return segments[segments[:, 1] - segments[:, 0] >= LEAST]


def _within(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words of the segments, and the segment of each."""
    sizes = segments[:, 1] - segments[:, 0]
    before = np.cumsum(sizes) - sizes
    return np.repeat(segments[:, 0] - before, sizes) + np.arange(sizes.sum()), np.repeat(np.arange(len(segments)), sizes)


def runs_of(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Runs (rows of start, end, period, by start and period) of the words of several documents; ``doc`` ascends."""
    at, group = _within(_long(repeated_grams(words, doc)))
    inner = _long(repeated_grams(words[at], group))
    segments = np.stack([at[inner[:, 0]], at[inner[:, 1] - 1] + 1], 1)
    at, group = _within(segments)
    if not len(segments):
        return np.zeros((0, 3), np.int64)
    order = np.argsort(words[at])
    known = words[at][order]
    ids = np.empty(len(at), np.int64)
    ids[order] = np.cumsum(np.append(False, known[1:] != known[:-1]))
    # a word of its own behind each segment
    place = np.arange(len(at)) + group
    sizes = segments[:, 1] - segments[:, 0]
    line = np.empty(len(at) + len(segments), np.int64)
    line[np.cumsum(sizes + 1) - 1] = len(at) + np.arange(len(segments))
    line[place] = ids
    back = np.zeros(len(line) + 1, np.int64)
    back[place] = at
    runs = main_lorentz(line, int(sizes.max()))
    runs = np.stack([back[runs[:, 0]], back[runs[:, 1] - 1] + 1, runs[:, 2]], 1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _search(texts: list[bytes], sources: list[np.ndarray | None] | None = None) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and runs (by number of the word) of each text; ``sources``: the words' order in each text, if not its own."""
    split = [t.split() for t in texts]
    if sources:
        split = [w if s is None else [w[i] for i in s.tolist()] for w, s in zip(split, sources, strict=True)]
    counts = np.array([len(w) for w in split], np.int64)
    ids = _Ids()
    words = np.concatenate([np.zeros(0, np.int64), *[np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in split]])
    runs = runs_of(words, np.repeat(np.arange(len(split)), counts))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    bounds = np.searchsorted(runs[:, 0], offsets)
    for k, w in enumerate(split):
        yield w, runs[bounds[k] : bounds[k + 1]] - np.array([offsets[k], offsets[k], 0])


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts (UTF-8) of stretches of ``BATCH_BYTES``."""
    texts, held, first = [], 0, 0
    for k, text in enumerate(column.cast(pa.binary())):
        data = text.as_py() or b""
        if texts and held + len(data) > BATCH_BYTES:
            yield first, texts
            texts, held, first = [], 0, k
        texts.append(data)
        held += len(data)
    if texts:
        yield first, texts


def runs(docs: DataFrame) -> DataFrame:
    """``docs`` with runs and collapsed.

    ``runs``: the stretches of words (start, length, period in words, by start
    and period) that have their smallest period three times or more and
    ``LEAST`` words, as long as they go. ``collapsed``: the words that stand in
    no run after its first period, joined by one space.

    Words are what the six ASCII white-space characters part. Null and empty
    texts have no runs and an empty collapsed text. A text is searched whole, by
    one task, with about 16 bytes for each level of its longest segment a word.
    Repeated rows fare alike; columns named runs or collapsed are replaced, all
    others pass through; an empty table gives an empty result.
    """
    docs = docs.drop("runs", "collapsed")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch.column("text")):
                listed, collapsed = [], []
                for words, found in _search(texts):
                    listed.append([{"start": s, "length": e - s, "period": q} for s, e, q in found.tolist()])
                    out = dropped(len(words), found) if len(found) else None
                    kept = words if out is None else [w for w, d in zip(words, out.tolist(), strict=True) if not d]
                    collapsed.append(b" ".join(kept).decode())
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(listed, kind), pa.array(collapsed, pa.string())], names=[*names, "runs", "collapsed"]
                )

    spans = F.lit(None).cast("array<struct<start: long, length: long, period: long>>")
    return docs.mapInArrow(run, docs.withColumns({"runs": spans, "collapsed": F.lit(None).cast("string")}).schema)


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """Order of the words of a text of n words that the contract makes periodic; None where it is left alone."""
    h = crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, one in ten made periodic: their runs, the one of greatest exponent, and what collapsing leaves."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch.column("text")):
                ids = batch.column("doc_id").slice(first, len(texts))
                sources = [None if d is None else planted(d, len(t.split())) for d, t in zip(ids.to_pylist(), texts, strict=True)]
                rows = []
                for words, found in _search(texts, sources):
                    best = [None] * 4
                    if len(found):
                        listed = [(s, e - s, q) for s, e, q in found.tolist()]
                        # by exact length / period: cross-multiplied by means of integers
                        top = listed[0]
                        for one in listed[1:]:
                            if one[1] * top[2] > top[1] * one[2]:
                                top = one
                        best = [*top, 1000 * top[1] // top[2]]
                        lines = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
                        out = dropped(len(words), found).tolist()
                        words = [w for w, d in zip(words, out, strict=True) if not d]
                    else:
                        lines = ""
                    rows.append([len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()])
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])],
                    names=["doc_id", *numbers, "runs_sha256", "collapsed_sha256"],
                )

    whole = ", ".join(f"{c} long" for c in ["doc_id", *numbers])
    return docs.mapInArrow(run, f"{whole}, runs_sha256 string, collapsed_sha256 string")


QUERIES = {"op11_runs": op11_runs}
ORACLES = {
    "op11_runs": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)) AS h
  FROM documents
), g AS (
  SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, (h // 10) % greatest(len(ws), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d
), w AS (
  SELECT doc_id, n, i, ws[CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END + 1] AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM g)
), same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same
), all_periods AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), r AS (
  SELECT doc_id, s, len, min(q) AS q FROM all_periods GROUP BY ALL
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) AS rank FROM r
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.len) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN ranked ON ranked.doc_id = d.doc_id AND rank = 1 LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
}
