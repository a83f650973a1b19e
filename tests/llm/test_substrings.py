"""Repeated passages against brute force, on planted, periodic and hard texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=50, across=False):
    """doc_id, spans and drops of every row with windows of n words that stand at two places or more."""
    places = defaultdict(list)
    words = [list(WORD.finditer(t or "")) for _, t in rows]
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        w = [m[0] for m in words[i]]
        for j in range(len(w) - n + 1):
            places[tuple(w[j : j + n])].append((i, j))
    repeated, first = [set() for _ in rows], [set() for _ in rows]
    for found in places.values():
        if len({i for i, _ in found}) > 1 or (len(found) > 1 and not across):
            for i, j in found:
                repeated[i].update(range(j, j + n))
                # rows that repeat doc_id and text of the first aren't told apart from it
                if rows[i] == rows[found[0][0]] and j == found[0][1]:
                    first[i].update(range(j, j + n))

    def spans(i, chosen):
        out = []
        for k in sorted(chosen):
            if out and out[-1][1] == k:
                out[-1][1] = k + 1
            else:
                out.append([k, k + 1])
        return tuple((words[i][a].start(), words[i][b - 1].end(), b - a) for a, b in out)

    return Counter((rows[i][0], spans(i, repeated[i]), spans(i, repeated[i] - first[i])) for i in range(len(rows)) if repeated[i])


def found(df, n=50, across=False):
    from millrace.llm import substrings as sub

    return Counter((r.doc_id, tuple(map(tuple, r.spans)), tuple(map(tuple, r.drops))) for r in sub.repeats(df, n, across).collect())


def hard(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    pool = [prose(rng.randint(45, 140)) for _ in range(12)]
    periodic = ["x ", "word ", "ab cd ", "na na batman ", "é ", "1234567 89 "]
    rows = []
    for i in range(300):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.35:
                parts.append(prose(rng.randint(5, 80)))
            elif kind < 0.6:
                w = rng.choice(pool).split()
                a = rng.randint(0, len(w) - 1)
                parts.append(" ".join(w[a : rng.randint(a, len(w))]))
            elif kind < 0.75:
                parts.append(rng.choice(periodic) * rng.randint(1, 200))
            elif kind < 0.8:
                parts.append("x" * rng.randint(1, 3000))
            else:
                parts.append(rng.choice(pool))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, rows[3][1]), (504, rows[3][1]), (3, rows[3][1]), (3, "other " + rows[3][1])]
    rows += [(None, rows[4][1]), (None, prose(70)), (505, "word " * 3000), (506, "x" * 60000), (507, "é🙂 " * 500), (508, prose(40_000))]
    return rows


def test_repeats_equal_brute_force(spark):
    for seed in (1, 4):
        rows = hard(seed)
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert found(table) == brute(rows)
        assert found(table, across=True) == brute(rows, across=True)
    assert found(table, 20) == brute(rows, 20)
    assert not found(table.limit(0))


def test_repeats_of_the_given_documents(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(given) == brute([(r.doc_id, r.text) for r in given.collect()])


def test_planted_passages_are_found_to_the_word(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 6))) for _ in range(n))
    rows, planted = [], {}
    for n in (49, 50, 51, 55, 60, 15):
        for _ in range(60):
            passage = prose(n)
            for _ in range(2):
                planted[len(rows)] = n
                rows.append((len(rows), " ".join([prose(rng.randint(40, 90)), passage, prose(rng.randint(40, 90))])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(table)
    assert got == brute(rows)
    # a neighbour may be equal by chance
    assert Counter(planted[d] for d, spans, _ in got if spans[0][2] <= planted[d] + 1 and planted[d] >= 50) == dict.fromkeys((50, 51, 55, 60), 120)


def test_passages_of_short_words_and_repeats_inside(spark):
    """All passages of words of a letter or two are found, and those that only their own document repeats are told apart."""
    from millrace.llm import substrings as sub

    rng = random.Random(11)
    prose = lambda n, most: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randint(1, most))) for _ in range(n))
    rows = []
    for k in range(250):
        passage = prose(50, 1 + k % 2)
        rows += [(len(rows) + j, " ".join([prose(rng.randint(3, 90), 5), passage, prose(rng.randint(3, 90), 5)])) for j in (0, 1)]
    own = prose(60, 6)
    rows += [(600, " ".join([prose(70, 6), own, prose(70, 6), own])), (601, prose(200, 6))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(table)
    assert got == brute(rows) and {d for d, *_ in got} == {d for d, _ in rows} - {601}
    shared = {r.doc_id: tuple(map(tuple, r.shared)) for r in sub.repeats(table).collect()}
    across = {d: spans for d, spans, _ in brute(rows, across=True)}
    assert {d: s for d, s in shared.items() if s} == across and not shared[600]


def test_dedup_leaves_each_passage_once(spark):
    from millrace.llm import substrings as sub

    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(n))
    passage, copy = prose(60), prose(80)
    rows = [(1, f"{prose(20)} {passage} {prose(20)}"), (2, f"{prose(20)}\n{passage}\n{prose(20)}"), (3, copy), (4, copy), (5, None), (None, copy), (6, "short")]
    table = spark.createDataFrame([(*r, "a", 2, b"k") for r in rows], "doc_id long, text string, spans string, `row` int, key binary")
    kept = sub.dedup(table)
    assert kept.columns == table.columns and {r.spans for r in kept.collect()} == {"a"}
    texts = Counter((r.doc_id, " ".join((r.text or "").split())) for r in kept.collect())
    want = [(1, rows[0][1]), (2, " ".join(rows[1][1].replace(passage, "").split())), (3, copy), (4, ""), (5, ""), (None, ""), (6, "short")]
    assert texts == Counter(want)
    assert sub.dedup(table.limit(0)).count() == 0


def test_cuts_resist_insertions():
    from millrace.llm import substrings as sub

    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdeféß", k=5)) for _ in range(2000))
    own = set(sub.chunk(text)[1].tolist())
    moved = set(sub.chunk(text[:3000] + "inserted words é " + text[3000:])[1].tolist())
    assert len(own - moved) <= 4
    for odd in ("", "a", "é" * 1000, "🙂" * 500, "x" * 5000, " " * 300, "na " * 900, text):
        data = np.frombuffer(odd.encode(), np.uint8)
        ends, _ = sub.cuts(data)
        assert len(odd) == 0 or (ends[-1] == len(data) and (np.diff(ends) > 0).all() and np.diff(ends, prepend=0).max() <= sub.MOST_BYTES)
        assert all((data[e] & 0xC0) != 0x80 for e in ends[:-1].tolist())
