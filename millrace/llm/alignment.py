"""Alignment of two tokenizers through a dictionary of groups.

Both tokenizers cut the bytes of a text. Where a token of either ends at the
same byte, a group ends: the tokens of one side between two such places spell
what those of the other do, and each of them is linked with each of the others.

Most groups of a corpus are the same few, so they are interned: a group's key is
a hash of its ids, and a document is a list of keys with the times it has them.
What follows costs by distinct groups, not by tokens:

1. Each task keeps a dictionary of the groups it meets, with the number of its
   documents that hold them, and the pairs of ids that a group links, each once
   with its number of links. Dictionaries are merged by key.
2. A pair's count is the sum of its groups' documents, less one for each further
   group of the same document that links it; those are told by the tasks.
3. A group's links are valued by their pairs, and documents add up the values of
   their groups by key.

Joins by key and by pair broadcast the most frequent keys (`join_uneven`), so
that a group which every document has is no task's alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import forget, join_uneven, keep, mix64, powers, small_or_not, table

#: Bytes of texts that are aligned at once; a longer text is aligned alone.
BATCH_BYTES = 1 << 20
# Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a piece has in place of a space.
SPACE = "\u2581"
#: Words whose pieces a worker keeps.
HELD_WORDS = 1 << 17
#: Groups in a task's dictionary before it is told and begun anew.
HELD_GROUPS = 1 << 17


@dataclass
class Pair:
    """The two tokenizers, as files: A in the tokenizers library's JSON (byte-level), B a sentencepiece model."""

    a_json: str
    b_model: bytes

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Pair:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())


class Both:
    """Both tokenizers in a worker, with the bytes of their tokens.

    A is run by its ranks, as the file's merges are in order of the ids they
    make (else it is refused). B's pieces hold U+2581 at their start only, so it
    cuts each word and the spaces before it by itself, and words are kept.
    """

    def __init__(self, files: Pair) -> None:
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        spec = json.loads(files.a_json)
        model, byte_of = spec["model"], {c: i for i, c in enumerate(byte_symbols())}
        kind = spec["normalizer"], spec["pre_tokenizer"], model.get("end_of_word_suffix")
        if kind != (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None):
            raise ValueError(f"a tokenizer of another kind: {kind}")
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
        made = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("merges that aren't in order of the ids they make")
        # without special tokens, so that their strings in a text are ordinary text
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=files.b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.a_size[list(ranks.values())] = list(map(len, ranks))
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.names = [str(i) for i in range(max(len(self.a_size), len(pieces)))]
        self.words: dict[str, list[int] | None] = {}

    def pieces(self, texts: list[str]) -> Iterator[list[int] | None]:
        """Ids of B of each text (which begins with a space); None where they don't spell it."""
        cut = [self.cut(t) or [t] if self.by_word else [t] for t in texts]
        new = list({w for words in cut for w in words if w not in self.words})
        if len(self.words) + len(new) > HELD_WORDS:
            self.words, new = {}, list({w for words in cut for w in words})
        for word, ids in zip(new, self.b.encode([w[1:] for w in new], num_threads=1) if new else [], strict=True):
            self.words[word] = ids if b"".join(map(self.b_bytes.__getitem__, ids)) == word.encode() else None
        for words in cut:
            ids = [*map(self.words.__getitem__, words)]
            yield None if None in ids else list(chain.from_iterable(ids))

    #: A word with the spaces before it, and those that end the text.
    cut = staticmethod(re.compile(r" +[^ ]+(?: +\Z)?").findall)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides for each text; none where a side doesn't spell it."""
        whole = [" " + t for t in texts]
        for text, b in zip(whole, self.pieces(whole), strict=True):
            if b is None or len(text) < 2:
                yield [], []
                continue
            a = self.a.encode_ordinary(text)
            yield (a, b) if self.a.decode_bytes(a) == text.encode() else ([], [])


#: By id of the broadcast: a worker keeps its tokenizers from task to task.
_held: dict[int, Both] = {}


def _both(sent) -> Both:
    number, files = sent
    if number not in _held:
        _held.clear()
        _held[number] = Both(files.value)
    return _held[number]


def _first_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct values, ascending by value, and which of them each value is."""
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _counted(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each range and how often it has them, laid one after another, and their number in each range."""
    sizes = ends - starts
    group = np.repeat(np.arange(len(starts)), sizes)
    code = np.sort(group << 32 | ids[_ranges(starts, sizes)])
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(code)))
    return code[at] & 0xFFFFFFFF, times, np.bincount(code[at] >> 32, minlength=len(starts))


@dataclass
class Dictionary:
    """Groups that a task has met: by key the pairs they link and how many of its documents hold them."""

    number: dict[int, int] = field(default_factory=dict)
    docs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    again: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def add(self, keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, links: np.ndarray) -> None:
        """Distinct groups of a batch: ``sizes`` of each one's part of ``pairs`` and ``links``."""
        known, number = len(self.number), self.number
        at = np.array([number.setdefault(k, len(number)) for k in keys.tolist()], np.int64)
        self.docs = np.append(self.docs, np.zeros(len(number) - known, np.int64))
        self.docs[at] += docs
        new = np.flatnonzero(at >= known)
        chosen = _ranges((np.cumsum(sizes) - sizes)[new], sizes[new])
        self.parts.append((sizes[new], pairs[chosen], links[chosen]))

    def told(self) -> tuple[list[pa.Array], list[pa.Array]]:
        """Columns of the groups (key, docs, pairs, links) and of the pairs that documents link in several groups (pair, again)."""
        sizes, pairs, links = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in self.parts)]) for k in range(3))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pairs, links)]
        pair, times = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in self.again)]) for k in (0, 1))
        first, which = _first_of(pair)
        sums = np.bincount(which, times, len(first)).astype(np.int64)
        return [pa.array(list(self.number), pa.int64()), pa.array(self.docs), *lists], [pa.array(pair[first]), pa.array(sums)]


def _align(both: Both, texts: list[str], held: Dictionary, spell: bool) -> list[list]:
    """n_a, n_b, n_groups, n_links, groups (or its digest), keys and times of each text; adds its groups to ``held``."""
    sides = list(both.encode(texts))
    n_a, n_b = (np.array([len(s[k]) for s in sides], np.int64) for k in (0, 1))
    a, b = (np.fromiter(chain.from_iterable(s[k] for s in sides), np.int64) for k in (0, 1))
    ends_a, ends_b = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    # groups end where both sides do; tokens before each end
    at = np.searchsorted(ends_b, ends_a)
    meets = ends_b[at] == ends_a if len(ends_b) else np.zeros(0, bool)
    to_a, to_b = np.flatnonzero(meets) + 1, at[meets] + 1
    from_a, from_b = np.append(0, to_a)[:-1], np.append(0, to_b)[:-1]
    size_a, size_b = to_a - from_a, to_b - from_b
    hashed = [mix64(powers.sums(mix64(x.astype(np.uint64) + np.uint64(1)), s, e) + n.astype(np.uint64)) for x, s, e, n in ((a, from_a, to_a, size_a), (b, from_b, to_b, size_b))]
    with np.errstate(over="ignore"):
        keys = mix64(hashed[0] * np.uint64(0x9E3779B97F4A7C15) + hashed[1]).view(np.int64)
    doc = np.searchsorted(np.cumsum(n_a), to_a)
    first, group = _first_of(keys)
    # distinct groups of each document, with times
    held_by = np.sort(doc * max(len(first), 1) + group)
    new = np.flatnonzero(np.append(True, held_by[1:] != held_by[:-1])) if len(held_by) else held_by
    times = np.diff(np.append(new, len(held_by)))
    of_doc, of_group = np.divmod(held_by[new], max(len(first), 1))
    # pairs of each distinct group
    ids_a, times_a, kinds_a = _counted(a, from_a[first], to_a[first])
    ids_b, times_b, kinds_b = _counted(b, from_b[first], to_b[first])
    sizes = kinds_a * kinds_b
    starts_b = np.cumsum(kinds_b) - kinds_b
    one_a = np.repeat(np.arange(len(ids_a)), np.repeat(kinds_b, kinds_a))
    one_b = _ranges(np.repeat(starts_b, kinds_a), np.repeat(kinds_b, kinds_a))
    pairs, links = ids_a[one_a] << 32 | ids_b[one_b], times_a[one_a] * times_b[one_b]
    held.add(keys[first], np.bincount(of_group, minlength=len(first)), sizes, pairs, links)
    # pairs that several groups of a document link
    known, which = _first_of(pairs)
    each = _ranges((np.cumsum(sizes) - sizes)[of_group], sizes[of_group])
    code = np.sort(np.repeat(of_doc, sizes[of_group]) * max(len(known), 1) + which[each])
    further = code[1:][code[1:] == code[:-1]] % max(len(known), 1)
    held.again.append((pairs[known][further], np.ones(len(further), np.int64)))

    names = both.names.__getitem__
    spelled = []
    for i, j, k, n in zip(from_a[first].tolist(), to_a[first].tolist(), from_b[first].tolist(), to_b[first].tolist(), strict=True):
        spelled.append(f"{','.join(map(names, a[i:j].tolist()))}|{','.join(map(names, b[k:n].tolist()))}")
    group_ends, listed = np.cumsum(np.bincount(doc, minlength=len(texts))), group.tolist()
    told, start = [], 0
    for end in group_ends.tolist():
        line = ";".join(map(spelled.__getitem__, listed[start:end]))
        told.append(line if spell or not line else hashlib.sha256(line.encode()).hexdigest())
        start = end
    n_groups = np.diff(np.append(0, group_ends))
    n_links = np.bincount(doc, size_a * size_b, len(texts)).astype(np.int64)
    bounds = np.append(0, np.cumsum(np.bincount(of_doc, minlength=len(texts)))).astype(np.int32)
    return [
        pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_links), pa.array(told, pa.string()),
        pa.ListArray.from_arrays(bounds, pa.array(keys[first][of_group])), pa.ListArray.from_arrays(bounds, pa.array(times)),
    ]


#: Columns of the documents' rows, of the groups' and of the pairs', in one table; those of other kinds are null.
_KINDS = {
    "doc": ["n_a long", "n_b long", "n_groups long", "n_links long", "groups string", "keys array<long>", "times array<long>"],
    "group": ["key long", "docs long", "pairs array<long>", "links array<long>"],
    "again": ["pair long", "further long"],
}


def _told(docs: DataFrame, a_path: str, b_path: str, spell: bool) -> DataFrame:
    """doc_id and kind, with the columns of that kind, of every document, of every task's groups and repeated pairs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    broadcast = docs.sparkSession.sparkContext.broadcast(Pair.load(a_path, b_path))
    sent = (broadcast._jbroadcast.id(), broadcast)
    schema = ", ".join(["doc_id long", "kind string", *chain.from_iterable(_KINDS.values())])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held = _both(sent), Dictionary()

        def batch_of(kind: str, columns: list[pa.Array], ids: pa.Array | None = None) -> pa.RecordBatch:
            own = dict(zip([c.split()[0] for c in _KINDS[kind]], columns, strict=True))
            n = len(columns[0])
            own |= {"kind": pa.array([kind] * n, pa.string())} | ({} if ids is None else {"doc_id": ids})
            return pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in types], names=types.names)

        def end() -> Iterator[pa.RecordBatch]:
            for kind, columns in zip(("group", "again"), held.told(), strict=True):
                yield batch_of(kind, columns)

        for batch in batches:
            texts, size, first = [], 0, 0
            column = batch.column("text").to_pylist()
            for k, text in enumerate(column):
                texts.append(text or "")
                size += len(texts[-1])
                if size >= BATCH_BYTES or k + 1 == len(column):
                    yield batch_of("doc", _align(both, texts, held, spell), batch.column("doc_id").slice(first, len(texts)))
                    texts, size, first = [], 0, k + 1
                    if len(held.number) >= HELD_GROUPS:
                        yield from end()
                        held = Dictionary()
        yield from end()

    return rows.mapInArrow(run, schema)


@dataclass
class Alignment:
    """What two tokenizers make of a corpus.

    ``documents``: doc_id, n_a, n_b, n_groups, n_links, groups, n_best and
    count_sum, a row for each document. ``pairs``: a, b, docs (documents that
    link them) and best (whether no other partner of a has more), a row for each
    linked pair of ids.
    """

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, spell: bool = True) -> Alignment:
    """Groups, links and counts of the documents of ``docs`` (doc_id, text).

    A reads a space and the text, B the text, before which it puts a space; null
    and empty texts, and those that a side doesn't give back byte for byte, have
    no tokens: all their numbers are 0 and their groups ''. ``groups`` spells
    the ids of all groups, `a1,a2|b1;a3|b2,b3`; without ``spell`` it is that
    line's SHA-256. Rows with one doc_id are documents of their own, rows
    without one too. A text is aligned whole, by one task. Other columns are
    ignored, and an empty table gives empty results. Two groups with one key of
    64 bits would be an error, not a wrong count.
    """
    told = keep(_told(docs, a_path, b_path, spell).withColumn("row", F.monotonically_increasing_id()), "aligned")
    groups = told.where("kind = 'group'").select("key", "docs", "pairs", "links", F.xxhash64("pairs", "links").alias("check"))
    groups = groups.groupBy("key").agg(
        F.sum("docs").alias("docs"), F.first("pairs").alias("pairs"), F.first("links").alias("links"),
        (F.min("check") != F.max("check")).alias("clash"),
    )
    groups = keep(groups, "groups")
    if not groups.where("clash").isEmpty():
        raise ValueError("two groups have one key")
    linked = groups.select("key", "docs", F.explode(F.arrays_zip("pairs", "links")).alias("p"))
    linked = keep(linked.select("key", "docs", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links")), "linked")
    one = F.lit(1).cast("long")
    counts = linked.select("pair", "docs", one.alias("groups")).union(
        told.where("kind = 'again'").select("pair", -F.col("further"), F.lit(0).cast("long"))
    )
    counts = keep(counts.groupBy("pair").agg(F.sum("docs").alias("count"), F.sum("groups").alias("groups")), "counts")
    a = F.shiftright("pair", 32)
    # a row for each id of A
    most = keep(counts.groupBy(a.alias("a")).agg(F.max("count").alias("most")), "most")
    pairs = counts.withColumn("a", a).join(small_or_not(most), "a")
    pairs = keep(pairs.select("a", "pair", "count", "groups", (F.col("count") == F.col("most")).alias("best")), "pairs")
    valued = join_uneven(linked.select("key", "pair", "links"), pairs.select("pair", "count", "groups", "best"), ["pair"], "groups")
    valued = valued.groupBy("key").agg(
        F.sum(F.col("links") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum")
    )
    valued = keep(valued.join(groups.select("key", "docs"), "key"), "valued")
    forget(linked, counts, most)
    rows = told.where("kind = 'doc'")
    each = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("g"))
    each = each.select("row", F.col("g.keys").alias("key"), F.col("g.times").alias("times"))
    sums = join_uneven(each, valued, ["key"], "docs").groupBy("row").agg(
        *[F.sum(F.col("times") * F.col(c)).alias(c) for c in ("n_best", "count_sum")]
    )
    documents = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "row", "left")
    documents = documents.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}).drop("row")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return Alignment(documents, pairs.select("a", b.alias("b"), F.col("count").alias("docs"), "best"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: numbers of tokens, groups and links, what the links' pairs count, and a digest of the groups."""
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = align(table(spark, sf_dir, "documents"), a, b, spell=False).documents
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op12_alignment": op12_alignment}
ORACLES: dict[str, str] = {}
