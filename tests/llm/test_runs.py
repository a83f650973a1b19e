"""Runs of words against a search of every period, and the query against a plain version over whole tables."""

import hashlib
import random
from zlib import crc32


def brute(words):
    """(start, length, period) of every run, by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q) and i > start:
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def hard(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(200):
        words = []
        for _ in range(rng.randint(0, 5)):
            kind, base = rng.random(), [rng.choice("abc") for _ in range(rng.randint(1, 30))]
            if kind < 0.5:
                words += (base * 40)[: rng.randint(1, 200)]
            elif kind < 0.8:
                words += rng.choices("ab", k=rng.randint(1, 100))
            else:
                words += [str(rng.random()) for _ in range(rng.randint(1, 50))]
        texts.append(rng.choice([" ", "\n", " \t\r\x0b\x0c"]).join(words))
    # Fibonacci and Thue-Morse words hold runs of many periods
    a, b, t = "b", "a", "a"
    for _ in range(12):
        a, b = b, b + a
    for _ in range(9):
        t += t.translate({97: "b", 98: "a"})
    edges = [None, "", " \n ", "x", "x " * 23, "x " * 24, "a b " * 12, "a b " * 11 + "a", "ab\xa0cd " * 30, "é " * 40, " ".join(b), " ".join(t)]
    texts += [*edges, ("long " * 7 + "tail ") * 5000, " ".join(map(str, range(30_000))) + " x" * 3000]
    return texts


def test_runs_equal_every_period(spark):
    from millrace.llm import runs as R

    texts = hard(2)
    rows = [(i, t, "own", 5) for i, t in enumerate(texts)] + [(3, texts[3], "own", 5), (None, texts[8], None, None)]
    got = R.runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, `period` int").repartition(4))
    assert got.columns == ["doc_id", "text", "period", "runs", "collapsed"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        words = [w.decode() for w in (r.text or "").encode().split()]
        found = [tuple(x) for x in r.runs]
        if len(words) < 5000:
            assert found == brute(words)
        assert r.collapsed == " ".join(collapse(words, found))
    long = [[tuple(x) for x in r.runs] for r in got if r.text and len(r.text) > 100_000]
    assert sorted(long) == [[(0, 40_000, 8)], [(30_000, 3000, 1)]]


def test_masking_loses_no_run():
    import numpy as np

    from millrace.llm import runs as R

    assert R.OVERLAP == 16
    rng = random.Random(4)
    for _ in range(200):
        q = rng.randint(1, 40)
        words = rng.choices("abcdefgh", k=rng.randint(0, 50)) + ([str(k) for k in range(q)] * 60)[: max(24, 3 * q)] + rng.choices("abcdefgh", k=30)
        ids = np.array([hash(w) for w in words])
        kept = R.repeated_grams(ids, np.zeros(len(ids), np.int64))
        for s, n, _ in brute(words):
            assert any(a <= s and s + n <= b for a, b in kept.tolist())


def test_op11_equals_a_plain_version(spark):
    from millrace.llm import runs as R

    folder = "/root/testdata/sf0.001"
    want = {}
    for d, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        w = [x.decode() for x in (text or "").encode().split()]
        n, h = len(w), crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        told = sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(collapse(w, runs)))
        want[d] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *told)
    assert {r[0]: tuple(r[1:]) for r in R.op11_runs(spark, folder).collect()} == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.runs(empty).count() == 0
