"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text and cuts where it is least among the
``REACH`` places on either side. Such a cut depends on the ``HASH_BYTES`` +
``REACH`` bytes before it and the ``REACH`` after it only, never on the cut
before, so two texts cut a common passage alike from there on. Where a text
repeats itself with a short period (a word over and over) there are equal least
places and no such cut; chunks end at some of these, so that they fall in step
there too.

Texts are cut with single spaces between words, as another line width makes no
other passage. Chunks are deduplicated by digest: one that stands at a single place of the
corpus ends a run of chunks that others have too. A repeated passage lies in
such a run, or reaches over its ends as far as the bytes that settle the chunk
beside it, no further. Passages of ``REPEAT_WORDS`` words or more are then found
exactly in these stretches: a window of so many words is repeated if it occurs
at two places or more, in one document or several, and the first place (by
doc_id, then place) keeps it.

A passage may hold no whole chunk that its own bytes settle: 50 words of a letter
each, say. Windows without one are told by each text for itself, and looked at
whatever the chunks around say; so nothing is missed.

Neither step joins chunks or windows with each other. Both aggregate by key to
the one place to be told (that of a single chunk; the first of a window), which
merges before the shuffle, so a line that every document has is as light as any
other; and whatever is not told of a document is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, hash_windows, hash_words, is_space, keep, mix64, running_totals, small_or_not, table

MOST_BYTES = 128
#: Places on either side of a cut whose hashes are no less: a cut in 2 * REACH + 1 bytes, and never two within REACH.
REACH = 12
#: Bytes that a hash depends on.
HASH_BYTES = 8
#: Words of a repeated passage.
REPEAT_WORDS = 50
#: A word's place is its document's block times this, and its number in the block; long documents have several blocks.
BLOCK_BITS = 24
#: Windows in a batch that a task returns.
BATCH_WINDOWS = 1 << 20


def gears() -> np.ndarray:
    """A 32-bit number for each byte, from a multiplicative rule."""
    with np.errstate(over="ignore"):
        x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEARS = gears()
#: The hash where no cut may be.
_NEVER = np.uint32(0xFFFFFFFF)


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of ``data`` (bytes of UTF-8), never inside a character, and which are settled by the bytes around."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    # in 32 bits a byte is shifted out after 8 steps of 4; sums over 1, 2, 4 and 8 bytes
    rolled = _GEARS[data]
    for s in (1, 2, 4):
        older = rolled[:-s] << np.uint32(4 * s)
        rolled = rolled.copy()
        rolled[s:] += older
    # mixed, as the lowest bits hold the last byte only
    rolled *= np.uint32(0x9E3779B1)
    rolled ^= rolled >> np.uint32(15)
    starts = (data & 0xC0) != 0x80
    rolled[~np.append(starts[1:], True)] = _NEVER
    rolled[: HASH_BYTES - 1] = _NEVER
    # the least of REACH places, from the least of 1, 2, 4 and so on
    padded = np.full(n + 2 * REACH, _NEVER, np.uint32)
    padded[REACH : REACH + n] = rolled
    least, width = padded, 1
    while 2 * width <= REACH:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: n + REACH + 1], least[REACH - width : n + 2 * REACH + 1 - width])
    before, after = least[:n], least[REACH + 1 :]
    wanted = np.flatnonzero((rolled < before) & (rolled <= after)) + 1
    # equal least places within REACH: the text repeats itself with a short period
    level = np.flatnonzero((rolled == before) & (rolled <= after) & (rolled < _NEVER)) + 1
    if not len(level) and np.diff(np.concatenate([[0], wanted, [n]])).max() <= MOST_BYTES:
        ends = wanted if len(wanted) and wanted[-1] == n else np.append(wanted, n)
        return ends, np.ones(len(ends), bool)
    ends, sure, at, k = [], [], 0, 0
    level = level.tolist()
    for end in [*wanted.tolist(), n]:
        first = True
        while k < len(level) and level[k] < end:
            # the first such place, and then the last within 2 * REACH of the one before
            while not first and k + 1 < len(level) and level[k + 1] < end and level[k + 1] - at <= 2 * REACH:
                k += 1
            while level[k] - at > MOST_BYTES:
                at += MOST_BYTES
                while not starts[at]:
                    at -= 1
                ends.append(at)
                sure.append(False)
            if level[k] > at:
                at = level[k]
                ends.append(at)
                sure.append(False)
            k, first = k + 1, False
        while end - at > MOST_BYTES:
            at += MOST_BYTES
            while not starts[at]:
                at -= 1
            ends.append(at)
            sure.append(False)
        if end > at:
            ends.append(end)
            sure.append(True)
            at = end
    return np.array(ends, np.int64), np.array(sure)


def chunk(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Ends (bytes) and digests of the chunks of a text, its words parted by single spaces, the bounds of passages beside each, and the number of words.

    The bounds are words: a passage that doesn't hold the chunk, but does hold
    one behind it, begins no earlier than the first; one that holds a chunk
    before it ends no later than the second.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    space = is_space(data)
    again = np.zeros(len(data), bool)
    again[1:] = space[1:] & space[:-1]
    # words count, not how they are parted
    data = np.where(space, np.uint8(32), data)[~again]
    raw = data.tobytes()
    ends, sure = cuts(data)
    if not len(ends):
        return ends, ends, ends, ends, 0
    begins = data != 32
    begins[1:] &= data[:-1] == 32
    upto = np.concatenate([[0], np.cumsum(begins)])
    digest, at, digests = xxhash.xxh3_64_intdigest, 0, []
    for end in ends.tolist():
        digests.append(digest(raw[at:end]))
        at = end
    # all between two sure cuts is settled by the bytes from somewhat before the first to somewhat behind the second;
    # a chunk without a sure end by the bytes up to MOST_BYTES behind it, and those before the sure cut before last
    anchors = np.concatenate([[0], ends[sure]])
    starts = np.concatenate([[0], ends[:-1]])
    k = np.searchsorted(anchors, starts, side="right") - 1
    first = anchors[np.maximum(np.where(sure, k, k - 1), 0)]
    last = np.append(anchors, len(data))[np.searchsorted(anchors, ends)]
    last = np.where(sure, last, np.maximum(last, ends + MOST_BYTES))
    low = np.maximum(upto[np.maximum(first - HASH_BYTES - REACH, 0)] - 1, 0)
    high = upto[np.minimum(last + REACH, len(data))]
    return ends, np.array(digests, np.uint64).view(np.int64), low, high, int(upto[-1])


def unsettled(low: np.ndarray, high: np.ndarray, n_words: int, repeat_words: int) -> np.ndarray:
    """Ranges of words (start, end, ...) of the windows that hold no chunk which their own bytes settle."""
    n = n_words - repeat_words + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # the first words of windows that hold a chunk and all that settles it
    first, last = np.maximum(high + 1 - repeat_words, 0), np.minimum(low, n - 1)
    some = first <= last
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, first[some], 1)
    np.add.at(depth, last[some] + 1, -1)
    bare = np.flatnonzero(np.diff(np.cumsum(depth[:-1]) == 0, prepend=False, append=False)).reshape(-1, 2)
    bare[:, 1] += repeat_words - 1
    return _joined(bare[:, 0], bare[:, 1])


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ranges (start, end, start, ...), those that meet as one; ``low`` ascends."""
    if not len(low):
        return np.zeros(0, np.int64)
    reached = np.maximum.accumulate(high)
    new = np.append(True, low[1:] > reached[:-1])
    return np.stack([low[new], reached[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]], 1).ravel()


def _lists(found: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, kind), *found]).astype(kind))


def _key() -> Column:
    """What stands for a text: its MD5."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _chunks(docs: DataFrame, repeat_words: int) -> DataFrame:
    """key, doc_id, n_words, bare (see `unsettled`) and digests, low and high (arrays, an entry a chunk) of every row of ``docs``."""
    rows = docs.where("length(text) > 0").select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [chunk(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("doc_id"), pa.array([c[4] for c in cut], pa.int64()),
                    _lists([c[1] for c in cut], np.int64), _lists([c[2] for c in cut], np.int32), _lists([c[3] for c in cut], np.int32),
                    _lists([unsettled(c[2], c[3], c[4], repeat_words) for c in cut], np.int32),
                ],
                names=["key", "doc_id", "n_words", "digests", "low", "high", "bare"],
            )

    return rows.mapInArrow(
        run, "key binary, doc_id long, n_words long, digests array<long>, low array<int>, high array<int>, bare array<int>"
    )


def _stretches(docs: DataFrame, repeat_words: int) -> DataFrame:
    """Stretches of the texts in which repeated passages can be, a row for each text that has some.

    key, first_doc (the least doc_id that has the text), copies (2 if several
    rows have it), ranges (array of words: start, end, start, end, ...), block
    and blocks: the text's first block of places, and their number.
    """
    cut = keep(_chunks(docs, repeat_words).withColumn("row", F.monotonically_increasing_id()), "chunks")
    # rows with equal text are one; its chunks count once
    texts = cut.groupBy("key").agg(
        F.min("row").alias("row"), F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"),
        F.min("doc_id").alias("first_doc"), F.first("n_words").alias("n_words"), F.first(F.size("digests")).alias("n_chunks"),
    )
    texts = keep(texts.where(F.col("n_words") >= repeat_words), "texts")
    read = cut.join(small_or_not(texts.select("row")), "row", "left_semi")
    each = read.select("row", F.posexplode(F.arrays_zip("digests", "low", "high")).alias("seq", "c"))
    each = each.select("row", "seq", F.col("c.digests").alias("digest"), F.col("c.low").alias("low"), F.col("c.high").alias("high"))
    # a chunk at one place only: the least of its columns are its own
    once = each.groupBy("digest").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("row", "seq", "low", "high")]).where("n = 1")
    lone = once.groupBy("row").agg(F.collect_list(F.struct("seq", "low", "high")).alias("lone"))
    bare = read.where("size(bare) > 0").select("row", "bare")
    laid = texts.join(lone, "row", "left").join(bare, "row", "left")

    def ranges_of(lone, bare, n_words: int, n_chunks: int, copies: int) -> np.ndarray:
        if copies > 1 or lone is None or not len(lone):
            return np.array([0, n_words])
        seq, low, high = (lone.field(c).to_numpy() for c in ("seq", "low", "high"))
        order = np.argsort(seq)
        seq = np.concatenate([[-1], seq[order], [n_chunks]])
        low, high = np.concatenate([[0], low[order]]), np.append(high[order], n_words)
        wide = (np.diff(seq) > 1) & (high - low >= repeat_words)
        low, high = low[wide], high[wide]
        if bare is not None:
            more = bare.to_numpy().reshape(-1, 2)
            low, high = np.concatenate([low, more[:, 0]]), np.concatenate([high, more[:, 1]])
            order = np.argsort(low, kind="stable")
            low, high = low[order], high[order]
        return _joined(low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c) for c in ("lone", "bare", "n_words", "n_chunks", "copies"))
            ranges = [
                ranges_of(x.values, b.values, n.as_py(), k.as_py(), c.as_py()) for x, b, n, k, c in zip(*columns, strict=True)
            ]
            kept = pa.array([len(r) > 0 for r in ranges])
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "first_doc", "copies", "n_words")), _lists(ranges, np.int32)],
                names=["key", "first_doc", "copies", "n_words", "ranges"],
            )
            yield out.filter(kept)

    found = laid.mapInArrow(run, "key binary, first_doc long, copies int, n_words long, ranges array<int>")
    order = [F.col("first_doc").isNull(), F.col("first_doc"), F.col("key")]
    blocks = F.shiftright("n_words", BLOCK_BITS) + 1
    placed = running_totals(found.withColumn("blocks", blocks), order, {"upto": F.col("blocks")})
    return keep(placed.select("key", "first_doc", "copies", "ranges", (F.col("upto") - F.col("blocks")).alias("block"), "blocks"), "stretches")


def _windows(docs: DataFrame, stretches: DataFrame, repeat_words: int) -> DataFrame:
    """hash, place and copies of each window of ``repeat_words`` words in the stretches; of equal texts once.

    A window that its document had before gets a hash of its own and, for
    copies, where that was: -1 - the number of the word.
    """
    keys = small_or_not(stretches.withColumnRenamed("key", "_key"), 64 + 4 * F.size("ranges"))
    rows = docs.where("length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key().alias("key"))
    # a row that repeats both doc_id and text counts again, of a text that is counted as several anyway
    rows = rows.join(keys, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("first_doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [np.concatenate([f[k] for f in found]) for k in range(3)], names=["hash", "place", "copies"]
            )

        for batch in batches:
            found, held = [], 0
            for text, ranges, block, copies in zip(*(batch.column(c) for c in ("text", "ranges", "block", "copies")), strict=True):
                _, _, words = hash_words(np.frombuffer(text.as_py().encode(), np.uint8))
                bounds = ranges.values.to_numpy().reshape(-1, 2).tolist()
                at = np.concatenate([np.arange(a, b - repeat_words + 1) for a, b in bounds])
                hashed = np.concatenate([hash_windows(words[a:b], repeat_words) for a, b in bounds])
                times = np.full(len(at), copies.as_py(), np.int32)
                place = (block.as_py() << BLOCK_BITS) + at
                _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
                before = at[first[which]]
                again = before < at
                hashed[again] = mix64(hashed[again] ^ mix64(place[again].view(np.uint64)))
                times[again] = -1 - before[again]
                found.append((hashed.view(np.int64), place, times))
                held += len(at)
                if held > BATCH_WINDOWS:
                    yield batch_of(found)
                    found, held = [], 0
            if found:
                yield batch_of(found)

    return rows.select("text", "ranges", "block", "copies").mapInArrow(run, "hash long, place long, copies int")


def passages(docs: DataFrame, repeat_words: int = REPEAT_WORDS, across: bool = False) -> DataFrame:
    """key, first_doc, spans, drops and shared of the texts with repeated passages, by words.

    ``spans``: all words of repeated windows (``across``: of those that another
    row has too); ``drops``: those that no first window holds, for the rows of
    first_doc; ``shared``: those that another row has (arrays of start, end,
    start, ...).
    """
    stretches = _stretches(docs, repeat_words)
    windows = _windows(docs, stretches, repeat_words)
    firsts = windows.groupBy("hash").agg(F.min("place").alias("place"), F.sum("copies").alias("n"), F.min("copies").alias("least"))
    # the number in the block, whether the window is repeated, and above 32 bits where its document had it before
    code = F.shiftleft(F.col("place").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)), 1) + (F.col("n") > 1).cast("long")
    code += F.when(F.col("least") < 0, F.shiftleft(-F.col("least").cast("long"), 32)).otherwise(0)
    told = firsts.select(F.shiftright("place", BLOCK_BITS).alias("at"), code.alias("code"))
    told = told.groupBy("at").agg(F.collect_list("code").alias("codes"))
    blocks = stretches.select("key", "block", F.explode(F.sequence("block", F.col("block") + F.col("blocks") - 1)).alias("at"))
    told = told.join(blocks, "at").groupBy("key").agg(F.collect_list(F.struct((F.col("at") - F.col("block")).alias("nth"), "codes")).alias("told"))
    laid = stretches.join(told, "key", "left")

    def runs(flags: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.diff(flags, prepend=False, append=False))

    def covered(windows: np.ndarray) -> np.ndarray:
        """The words of the windows (flags of their first words)."""
        depth = np.zeros(len(windows) + repeat_words, np.int32)
        at = np.flatnonzero(windows)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + repeat_words, -1)
        return np.cumsum(depth)[:-1] > 0

    def spans_of(ranges: np.ndarray, told) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, links = int(ranges[-1]), []
        repeated, first = np.zeros(n, bool), np.zeros(n, bool)
        for a, b in ranges.reshape(-1, 2).tolist():
            repeated[a : max(a, b - repeat_words + 1)] = True
        for one in told or ():
            codes = one["codes"].values.to_numpy()
            at = (int(one["nth"].as_py()) << BLOCK_BITS) + ((codes & 0xFFFFFFFF) >> 1)
            before = (codes >> 32) - 1
            repeated[at[(codes % 2 == 0) & (before < 0)]] = False
            first[at[(codes % 2 == 1) & (before < 0)]] = True
            links.append((at[before >= 0], before[before >= 0]))
        for at, before in links:
            repeated[at] = repeated[before]
        shared = covered(repeated)
        if across:
            return runs(shared), runs(shared & ~covered(first)), runs(shared)
        for at, before in links:
            # the first place of what only this text has
            first[before[~repeated[before]]] = True
        for at, before in links:
            repeated[at] = repeated[before] = True
        spans = covered(repeated)
        return runs(spans), runs(spans & ~covered(first)), runs(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(r.values.to_numpy(), t.values) for r, t in zip(batch.column("ranges"), batch.column("told"), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("first_doc"), *(_lists([f[k] for f in found], np.int32) for k in range(3))],
                names=["key", "first_doc", "spans", "drops", "shared"],
            )
            yield out.filter(pa.array([len(f[0]) > 0 for f in found]))

    return laid.mapInArrow(run, "key binary, first_doc long, spans array<int>, drops array<int>, shared array<int>")


SPAN = "struct<start: int, end: int, words: int>"


def repeats(docs: DataFrame, repeat_words: int = REPEAT_WORDS, across: bool = False) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and others) that hold repeated passages, with spans, drops and shared.

    ``spans``: the passages (start, end in code points, end exclusive; words),
    whole and apart, each of ``repeat_words`` words or more that stand elsewhere
    too, in this document or another (``across``: in another row, only).
    ``drops``: what of them is not the first of its kind, first by doc_id, then
    by place; it may go. ``shared``: what of them stands in another row.

    Rows with equal text are copies, of which those of the least doc_id are
    first (all of them, if rows repeat both doc_id and text, or if no copy has a
    doc_id). Rows without doc_id come last. Null and empty texts have no
    passages; an empty table gives an empty result. Columns named spans, drops
    or shared are replaced, others pass through.
    """
    docs = docs.drop("spans", "drops", "shared")
    found = keep(passages(docs, repeat_words, across), "passages")
    key, doc = fresh(docs, "_key", "_first")
    found = found.select(F.col("key").alias(key), F.col("first_doc").alias(doc), "spans", "drops", "shared")
    own = F.unhex(F.md5(F.col("text").cast("binary")))
    lists = ("spans", "drops", "shared")
    rows = docs.join(small_or_not(found, 64 + 4 * sum((F.size(c) for c in lists), F.lit(0))), own == F.col(key))
    # other copies go as a whole
    drops = F.when(F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), F.col("drops")).otherwise(F.col("spans"))
    rows = rows.select(*[F.col(c) for c in docs.columns], "spans", drops.alias("drops"), "shared")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            laid: list[list] = [[], [], []]
            for text, *each in zip(batch.column("text"), *(batch.column(c) for c in lists), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                starts, ends, _ = hash_words(data)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for out, words in zip(laid, each, strict=True):
                    bounds = words.values.to_numpy().reshape(-1, 2).tolist()
                    out.append([{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]]), "words": b - a} for a, b in bounds])
            columns = [batch.column(c) for c in names] + [pa.array(x, kind) for x in laid]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *lists])

    none = F.lit(None).cast(f"array<{SPAN}>")
    return rows.mapInArrow(run, docs.withColumns(dict.fromkeys(lists, none)).schema)


def without(text: Column, spans: Column) -> Column:
    """``text`` without ``spans`` (ascending, apart)."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text)))
    kept = F.transform(ends, lambda end, i: F.substring(text, end + 1, F.get(starts, i) - end))
    return F.array_join(kept, "")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages left only where they stand first.

    All rows and columns stay, and only texts get shorter: see `repeats` for
    copies, nulls and rows that repeat a doc_id. A text is settled by its own
    passages, so of each passage one place at least stays whole.
    """
    spans, drops, key = fresh(docs, "spans", "drops", "_text")
    found = repeats(docs.select("doc_id", "text")).select("doc_id", "text", F.col("drops"))
    # one row a text and doc_id, of which all rows have the same drops
    found = found.groupBy(F.col("doc_id").alias(spans), F.unhex(F.md5(F.col("text").cast("binary"))).alias(key)).agg(F.first("drops").alias(drops))
    found = small_or_not(keep(found.where(F.size(drops) > 0), "drops"), 64 + 16 * F.size(drops))
    own = F.unhex(F.md5(F.col("text").cast("binary")))
    marked = docs.join(found, F.col("doc_id").eqNullSafe(F.col(spans)) & (own == F.col(key)), "left")
    text = F.when(F.col(drops).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(drops)))
    return marked.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with passages of 50 words or more that stand elsewhere too, in another document (shared) or in their own."""
    found = repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["words"])
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_spans"),
        words(F.col("spans")).alias("repeated_words"),
        words(F.col("drops")).alias("dropped_words"),
        words(F.col("shared")).alias("shared_words"),
        spelled(F.col("spans")).alias("spans"),
        spelled(F.col("drops")).alias("drops"),
        spelled(F.col("shared")).alias("shared"),
    )


QUERIES = {"op1_substrings": op1_substrings}
ORACLES: dict[str, str] = {}
