"""Repeated byte strings by a run-length index over pieces that can share them.

A string of ``length`` bytes that starts at two places anywhere has to go from
both. What could share one is brought together first. The hashes of all grams
(a quarter of ``length``) of a window of ``length`` bytes have a least one, equal
for equal windows wherever they stand; neighbouring windows with the same least
hash are a stretch. A stretch whose hash stands at one place of the corpus holds
nothing repeated. The bytes of the others, pieces, are dealt by that hash, so
that equal windows meet, and equal pieces become one before they travel on.

A task sorts the suffixes of the pieces of whole hashes and keeps what a
run-length index keeps: the runs of the Burrows–Wheeler transform, with the
places of their first and last suffixes and how far these agree with the
suffixes beside them. Then it streams the pieces: the matching statistic of a
place against all other places is one less than that of the place before, but
for the samples at the ends of runs. Windows with a statistic of ``length`` or
more are repeated. In a repetitive collection there are few runs for its size.

A hash whose distinct pieces have more than ``GROUP_BYTES`` isn't one task's:
its windows are dealt anew by the least hash of longer grams, and if that is not
enough either, each by its own digest, to be counted.

Tasks tell documents what is *not* repeated, a single place each; a frequent
passage is never joined with the documents that have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh, join_uneven, keep, mix64, powers, small_or_not, table

#: Bytes of a repeated string.
LENGTH = 400
#: Most bytes of the distinct pieces of a hash that one task takes.
GROUP_BYTES = 1 << 20
#: Bytes of pieces that are indexed together.
INDEX_BYTES = 1 << 19
#: Windows of a piece; a longer stretch makes several.
PIECE_WINDOWS = 1 << 14
#: Bytes of texts that are hashed at once; a longer text is hashed alone.
BATCH_BYTES = 1 << 20

#: A number for each byte value, from a rule.
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers.of(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:n])])
        return mix64((total[k:] - total[:-k]) * down[: n - k + 1])


def _sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """The least (or most, by ``least``) of ``width`` values from each place on."""
    done = 1
    while 2 * done <= width:
        values, done = least(values[:-done], values[done:]), 2 * done
    if done < width:
        values = least(values[: len(values) - width + done], values[width - done :])
    return values


def stretches(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with the same least gram hash, in texts laid one after another (``bounds``: their ends, from 0).

    Text, first window (in ``data``), number of windows, hash, and whether the
    hash stands there twice or more.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    hashes = gram_hashes(data, gram)
    width = length - gram + 1
    least = _sliding(hashes, width, np.minimum)
    # windows over the end of a text are none
    last = np.searchsorted(bounds, np.arange(len(least)), side="right")
    text = last - 1
    valid = np.arange(len(least)) + length <= bounds[np.minimum(last, len(bounds) - 1)]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, len(least)))
    start, size = start[valid[start]], size[valid[start]]
    value = least[start]
    # places of hashes that are the least of some window, few; those of a stretch with its own hash
    most = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, least, 0), np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(hashes == _sliding(most, width, np.maximum))
    low, high = np.searchsorted(chosen, start), np.searchsorted(chosen, start + size + width - 1)
    counts = high - low
    each = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    stretch = np.repeat(np.arange(len(start)), counts)
    own = np.bincount(stretch, hashes[chosen[each]] == value[stretch], len(start))
    return text[start], start, size, value, own > 1


def _suffixes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """The suffix array of pieces laid one after another, and ranks of the first bytes from each place on, by their number.

    ``ends``: of each piece. A piece ends with a mark of its own, less than any byte.
    """
    n, m = len(data), len(ends)
    piece = np.repeat(np.arange(m), np.diff(np.append(0, ends)))
    left = ends[piece] - np.arange(n)
    # seven bytes in a number, 0 behind the piece
    packed = np.zeros(n, np.int64)
    symbols = np.append(data.astype(np.int64) + 1, np.zeros(7, np.int64))
    for t in range(7):
        packed = packed << 9 | np.where(left > t, symbols[t : t + n], 0)
    levels, steps, key, step = [], [], packed, 7
    longest = int(left.max())
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, key[order[1:]] != key[order[:-1]]))
        levels.append(rank.astype(np.int32))
        steps.append(step)
        if rank[order[-1]] == n - 1 or step > 2 * longest:
            return order, levels, steps
        behind = np.append(rank[step:] + m, np.zeros(min(step, n), np.int64))[:n]
        key = rank * (n + m) + np.where(left > step, behind, piece)
        step *= 2


def _agree(levels: list[np.ndarray], steps: list[int], data: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes from x and from y on are equal, inside their pieces."""
    most = np.minimum(left[x], left[y])
    far = np.zeros(len(x), np.int64)
    for rank, step in zip(levels[::-1], steps[::-1], strict=True):
        fits = far + step <= most
        a, b = np.where(fits, x + far, 0), np.where(fits, y + far, 0)
        far += np.where(fits & (rank[a] == rank[b]), step, 0)
    for _ in range(6):
        fits = far < most
        a, b = np.where(fits, x + far, 0), np.where(fits, y + far, 0)
        far += fits & (data[a] == data[b])
    return far


class RunIndex:
    """The runs of the Burrows–Wheeler transform of pieces, with a sample at each end of a run.

    ``heads`` and ``lengths``: the byte (-1: a piece's first) and the suffixes
    of each run. ``first`` and ``last``: places of a run's first and last
    suffix. ``before`` and ``after``: bytes that the first one has in common
    with the suffix before it, and the last one with that behind it.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        self.ends = np.cumsum([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        order, levels, steps = _suffixes(data, self.ends)
        starts = np.append(0, self.ends[:-1])
        byte = data[order - 1].astype(np.int64)
        opens = np.zeros(len(data), bool)
        opens[starts] = True
        byte[opens[order]] = -1
        new = np.append(True, (byte[1:] != byte[:-1]) | (byte[1:] < 0))
        at = np.flatnonzero(new)
        self.heads, self.lengths = byte[at], np.diff(np.append(at, len(data)))
        self.first, self.last = order[at], order[np.append(at[1:], len(data)) - 1]
        left = np.repeat(self.ends, np.diff(np.append(0, self.ends))) - np.arange(len(data))
        beside = _agree(levels, steps, data, left, self.last[:-1], self.first[1:])
        self.before, self.after = np.append(0, beside), np.append(beside, 0)

    def statistics(self) -> np.ndarray:
        """For each place, how many bytes from there on stand at another place too, streamed from place to place."""
        n = int(self.ends[-1])
        found = np.zeros(n, np.int64)
        for places, values in ((self.first, self.before), (self.last, self.after)):
            order = np.argsort(places)
            places, values = places[order], values[order]
            # one less a place, from the sample at or before it
            at = np.repeat(places + values, np.diff(np.append(places, n)))
            found = np.maximum(found, at - np.arange(n))
        return found


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows of ``length`` bytes stand at two places or more of the pieces."""
    index = RunIndex(pieces)
    flags = index.statistics() >= length
    return [flags[e - len(p) : e - length + 1] for p, e in zip(pieces, index.ends.tolist(), strict=True)]


def _key() -> Column:
    """What stands for a text: its MD5."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _lists(found: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, kind), *found]).astype(kind))


def _rows(docs: DataFrame, length: int) -> DataFrame:
    """key, doc_id, n_bytes and the stretches (starts, sizes, values, twice: arrays) of the rows with a window."""
    rows = docs.where(F.octet_length("text") >= length).select(
        _key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")
    )
    gram = length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(batch: pa.RecordBatch, first: int, texts: list[bytes]) -> pa.RecordBatch:
            bounds = np.append(0, np.cumsum([len(t) for t in texts]))
            text, start, size, value, twice = stretches(np.frombuffer(b"".join(texts), np.uint8), bounds, length, gram)
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            part = batch.slice(first, len(texts))
            lists = [(start - bounds[text]).astype(np.int32), size.astype(np.int32), value.view(np.int64), twice]
            return pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("doc_id"), pa.array(np.diff(bounds)), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists)],
                names=["key", "doc_id", "n_bytes", "starts", "sizes", "values", "twice"],
            )

        for batch in batches:
            texts, held, first = [], 0, 0
            for k, data in enumerate(batch.column("data")):
                data = data.as_py()
                if texts and held + len(data) > BATCH_BYTES:
                    yield batch_of(batch, first, texts)
                    texts, held, first = [], 0, k
                texts.append(data)
                held += len(data)
            if texts:
                yield batch_of(batch, first, texts)

    schema = "key binary, doc_id long, n_bytes long, starts array<int>, sizes array<int>, values array<long>, twice array<boolean>"
    return rows.mapInArrow(run, schema)


def _candidates(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """row, key, doc_id, starts, sizes and values of the stretches whose hash stands at two places or more, of each text once."""
    rows = rows.join(small_or_not(texts.select("row")), "row", "left_semi")
    each = rows.select("row", F.explode(F.arrays_zip("starts", "values", "twice")).alias("s"))
    each = each.select("row", F.col("s.starts").alias("start"), F.col("s.values").alias("value"), F.col("s.twice").alias("twice"))
    # a hash at one place only: the least of its columns are its own
    lone = each.groupBy("value").agg(
        F.count("*").alias("n"), F.max("twice").alias("twice"), F.min("row").alias("row"), F.min("start").alias("start")
    )
    lone = lone.where("n = 1 and not twice").groupBy("row").agg(F.collect_list("start").alias("lone"))
    laid = rows.select("row", "key", "doc_id", "starts", "sizes", "values").join(lone, "row", "left")
    return laid.mapInArrow(_shared, "row long, key binary, doc_id long, starts array<int>, sizes array<int>, values array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each row that aren't lone; rows that have some."""
    columns = ("starts", "sizes", "values")
    for batch in batches:
        found: list[list[np.ndarray]] = [[], [], []]
        for *lists, lone in zip(*(batch.column(c) for c in (*columns, "lone")), strict=True):
            starts, sizes, values = (x.values.to_numpy() for x in lists)
            shared = np.ones(len(starts), bool) if lone.values is None else ~np.isin(starts, lone.values.to_numpy())
            for out, x in zip(found, (starts, sizes, values), strict=True):
                out.append(x[shared])
        kinds = (np.int32, np.int32, np.int64)
        out = pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row", "key", "doc_id")), *(_lists(x, k) for x, k in zip(found, kinds, strict=True))],
            names=["row", "key", "doc_id", *columns],
        )
        yield out.filter(pa.array([len(x) > 0 for x in found[0]]))


_PIECES = "value long, digest binary, row long, start long, known boolean, piece binary"


def _cut(data: np.ndarray, start: int, size: int, length: int, gram: int) -> Iterator[tuple[int, int, bool]]:
    """First window, number and whether they are known to be repeated, of the pieces of a stretch.

    Where a stretch is longer than one gram can make it, its text repeats
    itself; windows that it has twice are known, and only the first stays.
    """
    if size <= length - gram + 1:
        yield start, size, False
        return
    windows = gram_hashes(data[start : start + size + length - 1], length)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    # 0: alone; 1: the first of several; 2: a later one
    kind = np.zeros(size, np.int8)
    kind[order[:-1][same]] = 1
    kind[order[1:][same]] = 2
    edges = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    for a, b in zip(edges.tolist(), np.append(edges[1:], size).tolist(), strict=True):
        if kind[a] < 2:
            for at in range(a, b, PIECE_WINDOWS):
                yield start + at, min(PIECE_WINDOWS, b - at), bool(kind[a])


def _pieces_of(data: np.ndarray, row: int, offset: int, found: Iterator[tuple[int, int, int]], known: bool, length: int, gram: int) -> Iterator[tuple]:
    raw = data.tobytes()
    for start, size, value in found:
        for at, n, twice in _cut(data, start, size, length, gram):
            piece = raw[at : at + n + length - 1]
            yield value, xxhash.xxh3_128_digest(piece), row, offset + at, known or twice, piece


def _batches_of(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Record batches of some megabytes."""
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), schema, strict=True)], names=[n for n, _ in schema])
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1])
        if size > 4 << 20:
            yield make()
            held, size = [], 0
    if held:
        yield make()


_ARROW = [("value", pa.int64()), ("digest", pa.binary()), ("row", pa.int64()), ("start", pa.int64()), ("known", pa.bool_()), ("piece", pa.binary())]


def _pieces(docs: DataFrame, candidates: DataFrame, length: int) -> DataFrame:
    """The pieces of the candidates: value, digest, row, start (its first window), known and piece."""
    named = candidates.withColumnsRenamed({"key": "_key", "doc_id": "_doc"})
    named = small_or_not(named, 40 + 16 * F.size("starts"))
    rows = docs.where(F.octet_length("text") >= length).select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key().alias("key"))
    # a row that repeats both doc_id and text sends its pieces again: they are repeated anyway
    rows = rows.join(named, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    rows = rows.select(F.col("text").cast("binary").alias("data"), "row", "starts", "sizes", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for data, row, *lists in zip(*(batch.column(c) for c in ("data", "row", "starts", "sizes", "values")), strict=True):
                    found = zip(*(x.values.to_pylist() for x in lists), strict=True)
                    yield from _pieces_of(np.frombuffer(data.as_py(), np.uint8), row.as_py(), 0, found, False, length, length // 4)

        yield from _batches_of(each(), _ARROW)

    return rows.mapInArrow(run, _PIECES)


def _distinct(pieces: DataFrame) -> DataFrame:
    """Equal pieces as one: known if there are several; the row and start of one that is alone are its own."""
    return pieces.groupBy("value", "digest").agg(
        F.min("row").alias("row"), F.min("start").alias("start"), (F.max("known") | (F.count("*") > 1)).alias("known"), F.first("piece").alias("piece")
    )


def _refined(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """The pieces' windows dealt by the least hash of longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for value, row, start, known, piece in zip(*(batch.column(c).to_pylist() for c in ("value", "row", "start", "known", "piece")), strict=True):
                    data = np.frombuffer(piece, np.uint8)
                    _, at, size, own, _ = stretches(data, np.array([0, len(data)]), length, gram)
                    own = mix64(own ^ mix64(np.array([value]).view(np.uint64))).view(np.int64)
                    yield from _pieces_of(data, row, start, zip(at.tolist(), size.tolist(), own.tolist(), strict=True), known, length, gram)

        yield from _batches_of(each(), _ARROW)

    return pieces.mapInArrow(run, _PIECES)


_TOLD = "row long, start long, end long"


def _told(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "start", "end"])


def _indexed(pieces: DataFrame, length: int) -> DataFrame:
    """row, start and end of the windows that are not repeated, of pieces of which all with one value are here."""
    # all of a value in one task, one after another: of bounded size
    dealt = pieces.repartition("value").sortWithinPartitions("value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def told() -> pa.RecordBatch:
            out = []
            for (row, start, known, _), flags in zip(held, repeated([h[3] for h in held], length), strict=True):
                if not known:
                    edges = np.flatnonzero(np.diff(~flags, prepend=False, append=False)).tolist()
                    out += [(row, start + a, start + b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            return _told(out)

        def close() -> int:
            """The group is whole: it is indexed if it has a piece that isn't known."""
            if all(p[2] for p in group):
                return 0
            held.extend(group)
            return sum(len(p[3]) for p in group)

        last = None
        for batch in batches:
            for value, row, start, known, piece in zip(*(batch.column(c).to_pylist() for c in ("value", "row", "start", "known", "piece")), strict=True):
                if value != last:
                    size += close()
                    group, last = [], value
                    if size >= INDEX_BYTES:
                        yield told()
                        held, size = [], 0
                group.append((row, start, known, piece))
        close()
        if held:
            yield told()

    return dealt.select("value", "row", "start", "known", "piece").mapInArrow(run, _TOLD)


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """As `_indexed`, by the digests of single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for row, start, known, piece in zip(*(batch.column(c).to_pylist() for c in ("row", "start", "known", "piece")), strict=True):
                    for k in range(len(piece) - length + 1):
                        yield row, start + k, known, xxhash.xxh3_128_digest(piece[k : k + length])

        yield from _batches_of(each(), [("row", pa.int64()), ("start", pa.int64()), ("known", pa.bool_()), ("digest", pa.binary())])

    windows = pieces.mapInArrow(run, "row long, start long, known boolean, digest binary")
    once = windows.groupBy("digest").agg(F.count("*").alias("n"), F.max("known").alias("known"), F.min("row").alias("row"), F.min("start").alias("start"))
    return once.where("n = 1 and not known").select("row", "start", (F.col("start") + 1).alias("end"))


def _unrepeated(pieces: DataFrame, length: int, group_bytes: int) -> DataFrame:
    """row, start and end of the pieces' windows that stand at one place only."""
    found = None
    for gram in (5 * length // 8, None):
        pieces = keep(_distinct(pieces), "pieces")
        sizes = pieces.groupBy("value").agg(F.sum(F.octet_length("piece")).alias("bytes"), F.min("known").alias("known"))
        large = keep(sizes.where((F.col("bytes") > group_bytes) & ~F.col("known")).select("value"), "large")
        some = not large.isEmpty()
        large = small_or_not(large)
        small = pieces.join(large, "value", "left_anti") if some else pieces
        told = keep(_indexed(small, length), "told")
        found = told if found is None else found.union(told)
        if not some:
            return found
        rest = pieces.join(large, "value", "left_semi")
        if gram is None:
            return found.union(keep(_counted(rest, length), "told"))
        pieces = _refined(rest, length, gram)
    return found


def _spans(candidates: DataFrame, told: DataFrame, length: int) -> DataFrame:
    """key, doc_id and spans (bytes: start, end, start, ...) of the rows in which something is repeated."""
    lists = told.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("free"))
    laid = candidates.join(lists, "row", "left")

    def spans_of(starts: np.ndarray, sizes: np.ndarray, free) -> np.ndarray:
        low = int(starts[0])
        depth = np.zeros(int(starts[-1] + sizes[-1]) - low + 1, np.int32)
        np.add.at(depth, starts - low, 1)
        np.add.at(depth, starts + sizes - low, -1)
        if free is not None:
            np.add.at(depth, free.field("start").to_numpy() - low, -1)
            np.add.at(depth, free.field("end").to_numpy() - low, 1)
        edges = np.flatnonzero(np.diff(np.cumsum(depth) > 0, prepend=False)).reshape(-1, 2) + low
        if not len(edges):
            return np.zeros(0, np.int64)
        # windows reach on, and spans that meet are one
        edges[:, 1] += length - 1
        new = np.append(True, edges[1:, 0] > edges[:-1, 1])
        return np.stack([edges[new, 0], edges[np.append(np.flatnonzero(new)[1:] - 1, len(edges) - 1), 1]], 1).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c) for c in ("starts", "sizes", "free"))
            spans = [spans_of(s.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(np.int64), f.values) for s, n, f in zip(*columns, strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), _lists(spans, np.int64)], names=["key", "doc_id", "spans"])
            yield out.filter(pa.array([len(s) > 0 for s in spans]))

    return laid.mapInArrow(run, "key binary, doc_id long, spans array<long>")


def marked(docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """key (MD5 of the text), doc_id and spans (bytes: start, end, start, ...) of the rows with repeated strings."""
    rows = keep(_rows(docs, length).withColumn("row", F.monotonically_increasing_id()), "stretches")
    # rows with equal text are one, all of it repeated if they are several
    texts = rows.groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"))
    texts = keep(texts, "texts")
    candidates = keep(_candidates(rows, texts), "candidates")
    told = _unrepeated(_pieces(docs, candidates, length), length, group_bytes)
    alone = candidates.join(small_or_not(texts.where("copies = 1").select("row")), "row", "left_semi")
    spans = _spans(alone, told, length)
    copies = keep(texts.where("copies > 1").select("key", "copies", F.array(F.lit(0).cast("long"), "n_bytes").alias("spans")), "copies")
    whole = join_uneven(rows.select("key", "doc_id"), copies, ["key"], "copies").select("key", "doc_id", "spans").distinct()
    spans = keep(spans.union(whole), "spans")
    forget(candidates)
    return spans


def without_repeats(docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` (doc_id, text and others) with removed and kept.

    ``removed``: the bytes (UTF-8; start, end) covered by a string of ``length``
    bytes that also starts anywhere else in the texts, in this one or another;
    stretches that meet are one. ``kept``: the bytes that are left (binary, as
    a character may lose some of its own).

    Strings are judged on the texts as they are, so all places of one go, and
    all of equal texts of ``length`` bytes or more. Null and empty texts have
    nothing to remove and keep no bytes. Rows with one doc_id, or none, are
    documents like any other. Columns named removed or kept are replaced,
    others pass through; an empty table gives an empty result.
    """
    docs = docs.drop("removed", "kept")
    spans = marked(docs.select("doc_id", "text"), length, group_bytes)
    key, doc, found = fresh(docs, "_key", "_doc", "_spans")
    spans = spans.select(F.col("key").alias(key), F.col("doc_id").alias(doc), F.col("spans").alias(found))
    spans = small_or_not(spans, 40 + 8 * F.size(found))
    own = F.unhex(F.md5(F.col("text").cast("binary")))
    rows = docs.join(spans, (own == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left").drop(key, doc)
    names = docs.columns
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, cut in zip(batch.column("text").cast(pa.binary()), batch.column(found), strict=True):
                data = text.as_py() or b""
                bounds = [] if cut.values is None else cut.values.to_pylist()
                removed.append([{"start": a, "end": b} for a, b in zip(bounds[::2], bounds[1::2], strict=True)])
                edges = [0, *bounds, len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            columns = [*(batch.column(c) for c in names), pa.array(removed, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "removed", "kept"])

    more = {"removed": F.lit(None).cast("array<struct<start: long, end: long>>"), "kept": F.lit(None).cast("binary")}
    return rows.mapInArrow(run, docs.withColumns(more).schema)


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their strings of 400 bytes that stand elsewhere too."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op13_suffixes": op13_suffixes}
ORACLES = {
    "op13_suffixes": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), part AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 1310) AS p FROM (SELECT *, unnest(range(0, greatest(length(h) // 2 - 399, 0), 256)) AS i FROM d)
), w AS (
  SELECT doc_id, i + j AS i, md5(substr(p, 2 * j + 1, 800)) AS m FROM (SELECT *, unnest(range(0, least(256, length(p) // 2 - 399))) AS j FROM part)
), r AS (
  SELECT doc_id, i, i > 400 + lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS opens
  FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (
    SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r) GROUP BY doc_id, span
), g AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s
), k AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
    string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM g JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
}
