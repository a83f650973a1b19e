"""Repeated byte strings against counting every string."""

import hashlib
import random
from collections import Counter

import numpy as np


def removed(texts, length):
    """Spans of every text that strings of ``length`` bytes with a second place cover."""
    data = [(t or "").encode() for t in texts]
    places = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - length + 1):
            if places[d[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append(tuple(map(tuple, spans)))
    return out


def rest(text, spans):
    data, at, kept = (text or "").encode(), 0, b""
    for a, b in spans:
        kept, at = kept + data[at:a], b
    return kept + data[at:]


def hard(seed, scale=1):
    rng = random.Random(seed)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz éß🙂": "".join(rng.choices(of, k=n))
    pool = [letters(rng.randint(10, 260 * scale)) for _ in range(25)] + ["x" * 90 * scale, "ab" * 60 * scale, letters(13) * 9 * scale]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.6 else letters(rng.randint(1, 150 * scale)) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    core = letters(60 * scale)
    texts += [letters(70 * scale) + core + letters(70 * scale) for _ in range(30)]
    texts += [None, "", "short", texts[3], texts[3], "x" * 5000, "x" * 4001, "na " * 2000, letters(17) * 200, letters(30_000)]
    return texts


def found(spark, rows, length, group_bytes):
    from millrace.llm import suffixes

    table = spark.createDataFrame(rows, "doc_id long, text string, kept string, `row` int, _key string").repartition(5)
    got = suffixes.without_repeats(table, length, group_bytes)
    assert got.columns == ["doc_id", "text", "row", "_key", "removed", "kept"]
    got = got.collect()
    return Counter((r.doc_id, r.text, tuple(map(tuple, r.removed)), bytes(r.kept)) for r in got)


def test_removal_equals_counting(spark):
    # groups of any size in one task; groups dealt anew by longer grams, and then by windows
    for seed, length, group_bytes in ((1, 40, 1 << 20), (2, 40, 3000), (3, 400, 1 << 14)):
        texts = hard(seed, length // 40)
        rows = [(i, t, "k", 1, "z") for i, t in enumerate(texts)]
        rows += [(3, texts[3], "k", 2, "z"), (5, texts[9], None, 3, None), (None, texts[11], None, 4, None), (None, texts[12] + "!", None, 5, None)]
        spans = removed([r[1] for r in rows], length)
        want = Counter((r[0], r[1], s, rest(r[1], s)) for r, s in zip(rows, spans, strict=True))
        assert found(spark, rows, length, group_bytes) == want
        assert sum(map(len, spans)) > 50


def test_index_equals_counting():
    from millrace.llm import suffixes

    rng = random.Random(3)
    for _ in range(100):
        length, letters = rng.choice([8, 12, 20]), rng.choice([1, 2, 26])
        pool = [bytes(rng.choices(range(97, 97 + letters), k=rng.randint(5, 60))) for _ in range(4)]
        pieces = [b"".join(rng.choices(pool, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        pieces = [p for p in pieces if len(p) >= length]
        if not pieces:
            continue
        places = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        for p, flags in zip(pieces, suffixes.repeated(pieces, length), strict=True):
            assert flags.tolist() == [places[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]
        index = suffixes.RunIndex(pieces)
        assert index.lengths.sum() == sum(map(len, pieces)) and (index.heads < 0).sum() == len(pieces)


def test_index_has_few_runs_for_copies():
    from millrace.llm import suffixes

    rng = random.Random(1)
    base = bytes(rng.choices(range(97, 123), k=2000))
    runs = [len(suffixes.RunIndex([base[: 1900 + k] + bytes([65 + k]) for k in range(n)]).heads) for n in (1, 40)]
    assert runs[1] < 2 * runs[0]


def test_equal_windows_meet():
    from millrace.llm import suffixes

    rng = random.Random(2)
    passage = bytes(rng.choices(range(97, 123), k=400))
    values = set()
    for _ in range(30):
        before, after = (bytes(rng.choices(range(97, 123), k=rng.randint(0, 900))) for _ in range(2))
        data = np.frombuffer(before + passage + after, np.uint8)
        _, start, size, value, _ = suffixes.stretches(data, np.array([0, len(data)]), 400, 100)
        assert start[0] == 0 and size.sum() == len(data) - 399
        values.add(int(value[np.searchsorted(start, len(before), side="right") - 1]))
    assert len(values) == 1


def test_op13_equals_counting(spark):
    from millrace.llm import suffixes

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for (d, t), spans in zip(rows, removed([t for _, t in rows], 400), strict=True):
        sizes = len((t or "").encode()), sum(b - a for a, b in spans), len(spans)
        want[d] = (*sizes, hashlib.sha256(rest(t, spans)).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in suffixes.op13_suffixes(spark, folder).collect()} == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(empty).count() == 0
