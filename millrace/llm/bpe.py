"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols. A segment tree holds, for every symbol that still
stands, the rank of the merge with its right neighbour; its root is the
leftmost of the lowest ranks. A merge changes at most three leaves, so each
costs a logarithm of the word's length, until the root says that no pair is
mergeable. That also holds for "words" of a million characters.

A tokenizer is a file in the JSON format of the tokenizers library: NFC, white
space as separator, lower case, then a pattern, byte-level symbols and a suffix
on the last symbol of a word. It is read on the driver and broadcast: its size
is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Most entries of each of the two generations of a worker's cache of words.
CACHE_ENTRIES = 400_000
#: Longest word that is cached.
CACHE_CHARS = 40
NEVER = 1 << 62

# The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Words(dict):
    """Ids of words. In two generations: a full one becomes the old one, and what is used comes back from it."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.old: dict[str, list[int]] = {}

    def __missing__(self, word: str) -> list[int]:
        ids = self.old.get(word)
        if ids is None:
            ids = self.tokenizer.encode_word(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


@dataclass
class Tokenizer:
    """Tables of a byte-level BPE with word ends."""

    tokens: list[str]
    first: list[int]  # id of a byte's symbol
    last: list[int]  # the same at the end of a word
    ranks: dict[int, int]  # two ids -> rank of their merge
    made: list[int]  # rank -> id of the merged symbol
    pattern: str
    special: dict[str, int]
    def __post_init__(self) -> None:
        self.find = regex.compile(self.pattern).findall
        # the same for lower-case ASCII, where letters and numbers are just these
        plain = self.pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self.find_ascii = re.compile(plain).findall
        self.words = _Words(self)
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None

    def __reduce__(self):
        return Tokenizer, (self.tokens, self.first, self.last, self.ranks, self.made, self.pattern, self.special)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [
            [n["type"] for n in spec["normalizer"]["normalizers"]], [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        ]
        if kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]:
            raise ValueError(f"a tokenizer of another kind: {kinds}")
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", WHITE)
        return cls(
            tokens,
            [vocab[c] for c in byte_symbols()],
            [vocab[c + suffix] for c in byte_symbols()],
            {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(pairs)},
            [vocab[a + b] for a, b in pairs],
            pattern,
            special,
        )

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of one word's symbols, leftmost lowest rank first."""
        n = len(ids)
        if n < 2:
            return ids
        ranks, made = self.ranks, self.made
        leaves = 1 << (n - 1).bit_length()
        # a leaf is rank * step + place: the least is the leftmost of the lowest rank
        step = 2 * leaves
        tree = [NEVER] * step
        for i in range(n - 1):
            rank = ranks.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[leaves + i] = rank * step + i
        for k in range(leaves - 1, 0, -1):
            x, y = tree[2 * k], tree[2 * k + 1]
            tree[k] = x if x < y else y
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while (root := tree[1]) != NEVER:
            rank, i = divmod(root, step)
            h, j = before[i], after[i]
            k = after[j]
            ids[i] = symbol = made[rank]
            ids[j] = -1
            after[i] = k
            # the leaves of the symbol, of the one it took in, and of the one before
            a, b, c = leaves + (i if h < 0 else h), leaves + i, leaves + j
            tree[b] = tree[c] = NEVER
            if k < n:
                before[k] = i
                rank = ranks.get(symbol << 32 | ids[k])
                if rank is not None:
                    tree[b] = rank * step + i
            if h >= 0:
                rank = ranks.get(ids[h] << 32 | symbol)
                tree[a] = NEVER if rank is None else rank * step + h
            while a > 1:
                a, b, c = a >> 1, b >> 1, c >> 1
                x, y = tree[2 * a], tree[2 * a + 1]
                tree[a] = x if x < y else y
                if b != a:
                    x, y = tree[2 * b], tree[2 * b + 1]
                    tree[b] = x if x < y else y
                if c != b:
                    x, y = tree[2 * c], tree[2 * c + 1]
                    tree[c] = x if x < y else y
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        first = self.first
        ids = [first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return self.merge(ids)

    def _plain(self, text: str) -> Iterable[int]:
        if text.isascii():
            found = self.find_ascii(text.lower())
        else:
            # lower case is taken character by character: a final sigma is like any other
            found = self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return chain.from_iterable(map(self.words.__getitem__, found))

    def encode(self, text: str) -> list[int]:
        if self.split_special is None or "<" not in text:
            return list(self._plain(text))
        ids: list[int] = []
        for part in self.split_special(text):
            if part in self.special:
                ids.append(self.special[part])
            else:
                ids += self._plain(part)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings, joined by a space: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


#: By id of the broadcast: a worker keeps its tokenizer, and what it has cached, from task to task.
_held: dict[int, Tokenizer] = {}


def _tokenizer(sent) -> Tokenizer:
    if sent.id_held not in _held:
        _held.clear()
        _held[sent.id_held] = sent.broadcast.value
    return _held[sent.id_held]


@dataclass
class Sent:
    id_held: int
    broadcast: object


def send(spark: SparkSession, path: str) -> Sent:
    broadcast = spark.sparkContext.broadcast(Tokenizer.load(path))
    return Sent(broadcast._jbroadcast.id(), broadcast)


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``docs`` with ids array<int>, the encoding of ``column``; null texts are empty.

    Special tokens named in a text become their ids, none are added. Rows are
    encoded one by one; other columns pass through, one named ids is replaced.
    """
    sent = send(docs.sparkSession, path)
    rest = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(sent)
        for batch in batches:
            ids = [tokenizer.encode(t or "") for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"]
            )

    return rest.mapInArrow(run, rest.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``encoded`` with decoded, the text of its ids; null ids decode to an empty text."""
    sent = send(encoded.sparkSession, path)
    rest = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(sent)
        for batch in batches:
            texts = [tokenizer.decode(i or ()) for i in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    return rest.mapInArrow(run, rest.withColumn("decoded", F.lit(None).cast("string")).schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encodes and decodes in one pass.

    Null and empty texts have no tokens and the digests of the empty text; long
    texts are encoded whole. Rows are encoded one by one, repeats too; other
    columns are ignored, and an empty table gives an empty result.
    """
    sent = send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(sent)
        spelled = [str(i) for i in range(len(tokenizer.tokens))].__getitem__
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column("text"):
                ids = tokenizer.encode(text.as_py() or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(spelled, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(tokenizer.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded, by digests."""
    return digests(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
