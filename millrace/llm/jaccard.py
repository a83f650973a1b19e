"""N-gram Jaccard join with filters under several global token orders.

Documents are sets of word shingles; two link when their Jaccard similarity is
0.8 or more. If A and B link, the first tokens of their intersection stand in a
short prefix of both under *any* global order of tokens, so a candidate must
share prefix tokens under every order used. The steps, each exact:

1. Equal sets are one class from here on.
2. Under the first order (by hash) a class needs several prefix tokens that
   other classes have in theirs. Most classes fail and link with nothing.
3. Whole sets are made for those that are left, and the most frequent tokens
   counted. The further orders put these last, by frequency, and the others by
   a different hash each, so passages that many documents share head no prefix.
4. Stars tie large groups of copies together without making pairs: classes that
   agree on a min-hash are compared with the most central of them, and then
   those that still share a list of the second order with another component with
   the most central of its largest component and with one class in ``SOME``.
5. All candidates between the components that are left: they share a prefix
   token under the second order, with length and position filters, then prefix
   tokens under the third and fourth, and bitmaps of their sets that leave room
   for enough common tokens, and are then verified on their whole sets.

A token's list never meets itself: in step 5 only lists that span components
are joined, and the largest component in each meets the others only.

Tokens are 64-bit hashes of shingles, classes 128-bit digests of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, hash_windows, hash_words, join_uneven, keep, mix64, small_or_not, table

SHINGLE = 5
#: Similarity at which two documents link, in hundredths.
PERCENT = 80
#: Most tokens that are ordered by frequency; their number is checked before they are broadcast.
HOT_TOKENS = 1 << 18
HOT_LEAST = 8
STARS = 4
#: How many tokens before its own an entry of a list carries.
EARLIER = 8
#: Of so many classes one is compared with those of other components first.
SOME = 16
#: Entries of a list that are joined in one task.
LIST_ROWS = 4096
#: Words of 64 bits in the bitmap of a set.
BITS = 16
#: Min-hashes that tell how central a class is: how many others agree on them.
CENTRAL = 8

_SEEDS = [np.uint64(((k + 1) * 0xD6E8FEB86659FD93) % 2**64) for k in range(CENTRAL + 4)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(text: str) -> np.ndarray:
    """Distinct tokens of ``text``, ascending: hashes of five words, A-Z in lower case, or of all if there are fewer."""
    _, _, words = hash_words(_LOWER[np.frombuffer(text.encode(), np.uint8)])
    if not len(words):
        return words
    return np.unique(hash_windows(words, min(SHINGLE, len(words))))


def partner_least(n):
    """Fewest tokens that a partner of a set of ``n`` has, which it then has in common with it."""
    return (PERCENT * n + 99) // 100


def wanted(n):
    """Common prefix tokens that the first order asks for."""
    return np.maximum(1, n // 20)


def prefix_length(n, common=1):
    return n - partner_least(n) + common


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, digest, class (the digest's first eight bytes), n and prefix of every row.

    The prefix is that of the first order, as long as its filter asks for.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py() or "") for t in batch.column("text")]
            digests = [_digest(s) for s in sets]
            # a single token links with equal sets only, and has no prefix
            heads = [s[: prefix_length(len(s), int(wanted(len(s)))) if len(s) > 1 else 0] for s in sets]
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(h) for h in heads], out=offsets[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(digests, pa.binary()),
                    pa.array(np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)),
                ],
                names=["doc_id", "text_key", "digest", "class", "n", "prefix"],
            )

    return rows.mapInArrow(
        run, "doc_id long, text_key long, digest binary, class long, n long, prefix array<long>"
    )


def _survivors(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes with enough prefix tokens, under the first order, that other classes have too.

    Tokens of one class alone are counted, and what its prefix has beside them
    is shared: an aggregate, so a token that most classes have meets nobody.
    """
    prefixes = sets.select("class", F.explode("prefix").alias("token"))
    own = prefixes.groupBy("token").agg(F.min("class").alias("class"), F.max("class").alias("most")).where("class = most")
    misses = own.groupBy("class").agg(F.count("*").alias("misses"))
    least = F.floor((PERCENT * F.col("n") + 99) / 100)
    length = F.col("n") - least + F.greatest(F.lit(1), F.floor(F.col("n") / 20))
    hits = length - F.coalesce("misses", F.lit(0))
    need = F.greatest(F.lit(1), F.floor(least / 20))
    return classes.where("n > 1").join(misses, "class", "left").where(hits >= need)


def _whole_sets(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """digest, n and tokens of the survivors."""
    keys = small_or_not(survivors.select(F.col("text_key").alias("_key")).distinct())
    rows = docs.select("text").join(keys, F.xxhash64("text") == F.col("_key"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {_digest(s): s for s in (shingles(t.as_py() or "") for t in batch.column("text"))}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sets), pa.binary()),
                    pa.array([len(s) for s in sets.values()], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets.values()], pa.list_(pa.int64())),
                ],
                names=["digest", "n", "tokens"],
            )

    return rows.mapInArrow(run, "digest binary, n long, tokens array<long>").dropDuplicates(["digest"])


def _hot(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, ascending, and their numbers of classes; ``HOT_TOKENS`` at most."""
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= HOT_LEAST)
    counts = keep(counts, "counts")
    sizes = counts.groupBy(F.floor(F.log2("count")).alias("bin")).count().orderBy(F.desc("bin")).collect()
    total, least = 0, None
    for bin_, n in sizes:
        if (total := total + n) > HOT_TOKENS:
            break
        least = 2**bin_
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counts.where(F.col("count") >= least).toPandas().sort_values("token")
    return found["token"].to_numpy(), found["count"].to_numpy()


def _orders(sets: DataFrame) -> DataFrame:
    """digest, n, star keys, prefixes under the second (with places), third and fourth order, and a bitmap."""
    hot = sets.sparkSession.sparkContext.broadcast(_hot(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = hot.value
        names = ["stars", "second", "third", "fourth", "bits"]
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for tokens in batch.column("tokens"):
                signed = tokens.values.to_numpy()
                plain = signed.view(np.uint64)
                at = np.minimum(np.searchsorted(frequent, signed), max(len(frequent) - 1, 0))
                count = np.where(frequent[at] == signed, counts[at], 0) if len(frequent) else np.zeros(len(signed), int)
                hashed = [mix64(plain ^ seed) for seed in _SEEDS]
                found[0].append(np.array([h.min() for h in hashed[:CENTRAL]]).view(np.int64))
                for k in (1, 2, 3):
                    order = np.lexsort((hashed[CENTRAL + k - 1], count))
                    found[k].append(signed[order[: prefix_length(len(signed))]])
                found[4].append(bitmap(hashed[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("n"), *(pa.array(c, pa.list_(pa.int64())) for c in found)],
                names=["digest", "n", *names],
            )

    lists = ", ".join(f"{c} array<long>" for c in ("stars", "second", "third", "fourth", "bits"))
    return sets.mapInArrow(run, f"digest binary, n long, {lists}")


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """``BITS`` words with a bit for each token: one that another set's lacks stands for a token that it lacks."""
    flags = np.zeros(64 * BITS, np.uint8)
    flags[(hashes % np.uint64(64 * BITS)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.int64)


def _room(n_a: Column, bits_a: Column, n_b: Column, bits_b: Column) -> Column:
    """Whether two sets can have enough in common to link: of each, at least the tokens of bits that the other lacks aren't."""
    lacking = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j)))), F.lit(0), lambda s, k: s + k)
    common = F.least(n_a - lacking(bits_a, bits_b), n_b - lacking(bits_b, bits_a))
    return 100 * common >= PERCENT * (n_a + n_b - common)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b of digests) whose sets link."""
    side = lambda c: sets.select(F.col("digest").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("t_a", "t_b"))
    both = both.select("a", "b", "n_a", "n_b", common.alias("common"))
    return both.where(100 * F.col("common") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node that links reach) for every node of ``links`` (a, b).

    Labels are nodes of the same component and only fall. In a round every node
    offers the least label of its neighbours to itself and to the node that its
    own label names, so whole trees hook onto others, and then takes its label's
    label. When a round changes nothing, neighbours agree everywhere. Every round
    is written to the shared folder, and the round before deleted; a component
    of any size is a matter of joins and partial minima, never of one task.
    """
    edges = keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    last = labels = keep(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        offers = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("near"))
        offers = offers.select("node", "near", F.col("root").alias("old")).union(
            offers.select("root", "near", F.lit(None).cast("binary"))
        )
        hooked = keep(offers.groupBy("node").agg(F.min("near").alias("root"), F.max("old").alias("old")), "hooked")
        jump = hooked.select(F.col("node").alias("_at"), F.col("root").alias("_root"))
        moved = hooked.join(jump, F.col("root") == F.col("_at")).select("node", "old", F.least("root", "_root").alias("root"))
        moved = keep(moved, "moved")
        forget(hooked, last)
        last, labels = moved, moved.select("node", "root")
        if moved.where("old != root").isEmpty():
            forget(edges)
            return labels


def _central(orders: DataFrame) -> DataFrame:
    """``orders`` with central: how many classes agree on each min-hash, added up."""
    keys = orders.select("digest", F.posexplode("stars").alias("star", "key"))
    sizes = keys.groupBy("star", "key").agg(F.count("*").alias("members")).where("members > 1")
    sums = join_uneven(keys, keep(sizes, "sizes"), ["star", "key"], "members").groupBy("digest").agg(F.sum("members").alias("central"))
    return orders.join(sums, "digest", "left").withColumn("central", F.coalesce("central", F.lit(0)))


def _stars(orders: DataFrame) -> DataFrame:
    """Pairs of each class with the most central one of the same min-hash."""
    keys = orders.select("digest", "central", F.posexplode("stars").alias("star", "key")).where(F.col("star") < STARS)
    hubs = keys.groupBy("star", "key").agg(
        F.max(F.struct("central", "digest"))["digest"].alias("hub"), F.count("*").alias("n")
    )
    pairs = join_uneven(keys, keep(hubs.where("n > 1"), "hubs"), ["star", "key"], "n").where("hub <> digest")
    return pairs.select(F.least("hub", "digest").alias("a"), F.greatest("hub", "digest").alias("b")).distinct()


def _spanning(orders: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of the second order's lists (token; digest, n, at, central, root) that hold several components.

    With main, the largest component of the list, and listed, its entries.
    """
    placed = orders.join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    placed = placed.withColumn("root", F.coalesce("root", "digest"))
    lists = keep(placed.select("digest", "n", "central", "root", F.posexplode("second").alias("at", "token")), "lists")
    sizes = lists.groupBy("token", "root").agg(F.count("*").alias("members"))
    mixed = sizes.groupBy("token").agg(
        F.max_by("root", "members").alias("main"), F.count("*").alias("roots"), F.sum("members").alias("listed")
    )
    mixed = keep(mixed.where("roots > 1").drop("roots"), "mixed")
    spanning = keep(join_uneven(lists, mixed, ["token"], "listed"), "spanning")
    forget(lists, mixed)
    return spanning


def _hubs(spanning: DataFrame, orders: DataFrame) -> DataFrame:
    """Pairs of each class outside a list's largest component with the most central class inside."""
    hubs = spanning.where("root = main").groupBy("token").agg(F.max(F.struct("central", "digest", "n")).alias("hub"))
    outside = spanning.where("root <> main")
    hubs = keep(hubs.join(outside.groupBy("token").agg(F.count("*").alias("others")), "token"), "hubs")
    near = join_uneven(outside, hubs, ["token"], "others")
    near = near.where(100 * F.least("n", "hub.n") >= PERCENT * F.greatest("n", "hub.n"))
    hub = F.col("hub.digest")
    return near.select(F.least("digest", hub).alias("a"), F.greatest("digest", hub).alias("b")).distinct()


def _some(spanning: DataFrame, orders: DataFrame) -> DataFrame:
    """Those of `_hubs`, and of `_between` with one class in ``SOME``.

    A class that links with many of a component is tied to it here, and meets
    no other class of it later; `_between` is for those that don't.
    """
    return _hubs(spanning, orders).union(_between(spanning, orders, SOME)).distinct()


def _between(spanning: DataFrame, orders: DataFrame, one_in: int = 1) -> DataFrame:
    """Candidate pairs of classes in different components; with ``one_in``, of those outside a main one with one in so many.

    A pair meets in the list of every common prefix token. Entries carry the few
    tokens before theirs, and where two entries have one of these in common the
    pair has met before: so it is made once or little more, and always at its
    first common token. Lists of over ``LIST_ROWS`` entries are dealt into
    parts of so many, which the entries outside the main component all meet.
    """
    start = F.greatest(F.col("at") - EARLIER + 1, F.lit(1))
    earlier = F.slice("second", start, F.least(F.col("at"), F.lit(EARLIER)))
    entries = spanning.join(orders.select("digest", "second"), "digest").withColumn("earlier", earlier).drop("second")
    parts = F.ceil(F.col("listed") / LIST_ROWS).cast("int")
    entries = keep(entries.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("digest"), "parts").cast("int")), "entries")
    columns = ("digest", "n", "root", "at", "earlier")
    left = entries.where("root != main").select(
        "token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"l_{c}") for c in columns]
    )
    overlap = F.ceil(PERCENT * (F.col("l_n") + F.col("n")) / (100 + PERCENT))
    # were this the first common token, what stands from here on is all that can be common
    reach = F.least(F.col("l_n") - F.col("l_at"), F.col("n") - F.col("at"))
    met = F.lit(True)
    if one_in > 1:
        entries = entries.where(F.pmod(F.xxhash64("digest", F.lit(one_in)), F.lit(one_in)) == 0)
    else:
        met = (F.col("root") == F.col("main")) | (F.col("l_digest") < F.col("digest"))
    pairs = left.join(entries, ["token", "part"]).where(
        (F.col("l_root") != F.col("root"))
        & met
        & (100 * F.least("l_n", "n") >= PERCENT * F.greatest("l_n", "n"))
        & (reach >= overlap)
        & ~F.arrays_overlap("l_earlier", "earlier")
    )
    return pairs.select(F.least("l_digest", "digest").alias("a"), F.greatest("l_digest", "digest").alias("b")).distinct()


def _meet(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """The pairs that share prefix tokens under the third and the fourth order too, and whose bitmaps leave room."""
    side = lambda c: orders.select(F.col("digest").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "third", "fourth", "bits")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    meets = F.arrays_overlap("third_a", "third_b") & F.arrays_overlap("fourth_a", "fourth_b")
    meets = meets & _room(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"))
    return both.where(meets).select("a", "b")


def linked_rows(docs: DataFrame) -> DataFrame:
    """As `jaccard_join`, with text_key (xxhash64 of the text) and root, a digest that just a component's rows share.

    root is null for rows without shingles.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = keep(_sets(rows), "sets")
    light = keep(full.drop("prefix"), "light")
    classes = light.where("n > 0").groupBy("digest").agg(
        F.first("class").alias("class"), F.first("n").alias("n"), F.min("text_key").alias("text_key"), F.min("doc_id").alias("least_doc")
    )
    classes = keep(classes, "classes")
    survivors = keep(_survivors(full, classes).select("digest", "text_key"), "survivors")
    forget(full)
    sets = keep(_whole_sets(rows, survivors), "whole")
    plain = keep(_orders(sets), "orders")
    orders = keep(_central(plain), "central")
    forget(plain)
    links = keep(_verify(_stars(orders), sets), "stars")
    for step, candidates in (("some", _some), ("between", _between)):
        spanning = _spanning(orders, components(links))
        pairs = keep(_meet(candidates(spanning, orders), orders), f"{step}_pairs")
        links = links.union(keep(_verify(pairs, sets), step))
        forget(spanning, pairs)
    roots = components(links)
    forget(sets, orders, survivors)

    joined = classes.select("digest", "least_doc").join(roots, F.col("digest") == F.col("node"))
    ids = joined.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = joined.join(ids, "root").select("digest", "root", "component_id")
    # a class without links is a component of its own
    own = classes.select("digest", "least_doc").join(named, "digest", "left")
    component = F.when(F.col("root").isNull(), F.col("least_doc")).otherwise(F.col("component_id"))
    own = own.select("digest", F.coalesce("root", "digest").alias("root"), component.alias("component_id"))
    columns = ("doc_id", "text_key", F.col("n").alias("n_shingles"))
    alone = light.where("n = 0").select(*columns, F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("component_id"))
    return light.where("n > 0").join(own, "digest").select(*columns, "root", "component_id").union(alone)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    component_id is the least doc_id that links reach, the row's own included.
    Null texts and texts without words have no shingles and link with nothing.
    Rows with one doc_id are documents of their own; rows without doc_id link
    like others but give a component no id (it is null if no row has one). An
    empty table gives an empty result. Other columns are ignored.
    """
    return linked_rows(docs).select("doc_id", "n_shingles", "component_id")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: size of the shingle set and component."""
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard": op10_jaccard}
ORACLES = {
    "op10_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), r AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
}
