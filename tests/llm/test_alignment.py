"""Groups, links and counts of two tokenizers against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain(texts):
    """n_a, n_b, n_groups, n_links, groups, n_best, count_sum of each text, and documents of each pair."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        ids = [a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")]
        sides = [[bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [b_bytes(i) for i in ids[1]]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            found.append(None)
            continue
        ends = [{len(b"".join(s[: k + 1])): k + 1 for k in range(len(s))} if len(s) < 500 else _ends(s) for s in sides]
        groups, last = [], (0, 0)
        for end in sorted(ends[0].keys() & ends[1].keys()):
            at = ends[0][end], ends[1][end]
            groups.append((ids[0][last[0] : at[0]], ids[1][last[1] : at[1]]))
            last = at
        found.append((len(ids[0]), len(ids[1]), groups))
    docs = Counter(p for f in found if f for p in {(x, y) for ga, gb in f[2] for x in ga for y in gb})
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    rows = []
    for f in found:
        if not f:
            rows.append((0, 0, 0, 0, "", 0, 0))
            continue
        links = [(x, y) for ga, gb in f[2] for x in ga for y in gb]
        line = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in f[2])
        rows.append((f[0], f[1], len(f[2]), len(links), line, sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links)))
    return rows, {(x, y, n, n == most[x]) for (x, y), n in docs.items()}


def _ends(tokens):
    found, at = {}, 0
    for k, t in enumerate(tokens):
        at += len(t)
        found[at] = k + 1
    return found


def test_alignment_equals_a_plain_version(spark):
    from millrace.llm import alignment

    rng = random.Random(5)
    texts = [None, "", " ", "x", "  two  spaces\n\n", "a<|endoftext|>b </s><s>", "▁ marks ▁", "é🙂‍👩‍🔬 漢字かな", "\x00\x01 nul", "ﬁ ½ Å", "e \u0301 a", " \n x  ", "end   ", "   start", "tab\tand\r\nline"]
    texts += ["".join(rng.choices("abcdefghij .,;!?()-'\n0123456789éü漢🙂", k=rng.randint(1, 300))) for _ in range(120)]
    texts += [" ".join(rng.choices(["the", "data", "New", "York", "token", "izer", "123", "Ünïcode"], k=rng.randint(1, 60))) for _ in range(120)]
    texts += ["x" * 20_000, " " * 5000, "🙂" * 3000, "word " * 20_000, texts[20], texts[20]]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(7, texts[30], "k", 2), (None, texts[31], None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, `key` string, `row` int").repartition(5)
    want, pairs = plain([r[1] for r in rows])
    found = alignment.align(table, *PATHS)
    assert Counter(tuple(r) for r in found.documents.collect()) == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert {tuple(r) for r in found.pairs.collect()} == pairs
    empty = alignment.align(table.limit(0), *PATHS)
    assert empty.documents.count() == empty.pairs.count() == 0


def test_op12_equals_a_plain_version(spark):
    from millrace.llm import alignment

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain([t for _, t in rows])
    sha = lambda x: x and hashlib.sha256(x.encode()).hexdigest()
    assert {r[0]: tuple(r[1:]) for r in alignment.op12_alignment(spark, folder).collect()} == {
        d: (*w[:4], sha(w[4]), *w[5:]) for (d, _), w in zip(rows, want, strict=True)
    }


def test_a_dictionary_begun_anew_tells_the_same():
    from millrace.llm import alignment

    both = alignment.Both(alignment.Pair.load(*PATHS))
    texts = ["the data of New York", "the data, the token", "New data", "the the"] * 3
    once = alignment.Dictionary()
    alignment._align(both, texts, once, False)
    docs, pairs = Counter(), Counter()
    for text in texts:
        held = alignment.Dictionary()
        alignment._align(both, [text], held, False)
        groups, again = held.told()
        docs.update(dict(zip(groups[0].to_pylist(), groups[1].to_pylist(), strict=True)))
        pairs.update(dict(zip(*(x.to_pylist() for x in again), strict=True)))
    groups, again = once.told()
    assert docs == dict(zip(groups[0].to_pylist(), groups[1].to_pylist(), strict=True))
    assert pairs == dict(zip(*(x.to_pylist() for x in again), strict=True))
