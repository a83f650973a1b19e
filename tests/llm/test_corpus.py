"""Operators that look at many rows at once, against brute force and on hard cases."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with near copies in chains and groups, a common passage, nulls, ties, repeats and clashing columns."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = text(60)
    rows = []
    for i in range(60):
        rows.append((i, text(rng.randint(1, 200)), f"s{i % 5}"))
    base = text(150).split()
    for i in range(60, 120):  # a group of near copies, some at the edge of 0.8
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words), "hot"))
    drift = list(base)
    for i in range(120, 160):  # a chain: each like the one before
        drift[(i * 37) % 150] = rng.choice(vocabulary)
        rows.append((i, " ".join(drift), "hot"))
    for i in range(160, 200):  # different texts that share a passage
        rows.append((i, f"{text(40)} {passage} {text(40)}", None))
    rows += [(200, None, "s1"), (201, "", None), (202, "A b C", "s1"), (203, "a B c", "s2"), (204, "a b c d e", "s2")]
    rows += [(5, rows[5][1], "s0"), (6, "another text for six", "s1"), (None, text(30), None), (None, None, None)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n int, token string").cache()


def _shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _components(rows):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(sets[i]), min(least[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_jaccard_components(spark, docs):
    from millrace.llm.jaccard import jaccard_join

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in jaccard_join(docs).collect()) == _components(rows)
    assert not jaccard_join(docs.limit(0)).collect()


def test_jaccard_on_the_given_documents(spark):
    from millrace.llm.jaccard import jaccard_join

    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in given.collect()]
    assert Counter(tuple(r) for r in jaccard_join(given).collect()) == _components(rows)


def test_jaccard_remainder_is_exact_without_stars(spark, docs, monkeypatch):
    from millrace.llm import jaccard

    monkeypatch.setattr(jaccard, "_stars", lambda orders: orders.limit(0).select(F.col("digest").alias("a"), F.col("digest").alias("b")))
    monkeypatch.setattr(jaccard, "HOT_LEAST", 3)
    monkeypatch.setattr(jaccard, "LIST_ROWS", 5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in jaccard.jaccard_join(docs).collect()) == _components(rows)


def test_components_of_chains_rings_and_stars(spark):
    from millrace.llm.jaccard import components

    name = lambda i: hashlib.md5(str(i).encode()).digest()
    links = [(i, i + 1) for i in range(300)] + [(400 + i, 400 + (i + 1) % 50) for i in range(50)] + [(500, 501 + i) for i in range(90)]
    df = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in links], "a binary, b binary")
    groups = [range(301), range(400, 450), range(500, 591)]
    want = {name(i): min(map(name, g)) for g in groups for i in g}
    assert {bytes(r.node): bytes(r.root) for r in components(df).collect()} == want
    assert not components(df.limit(0)).collect()


def test_mixing_near_targets(spark, docs):
    from millrace.llm.mixing import mix

    def brute(sizes):
        order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
        weight = {s: i % 3 + 1 for i, s in enumerate(order)}
        budget, target, free = sum(sizes.values()), {}, set(order)
        while free:
            level = (budget - sum(target.values())) / sum(weight[s] for s in free)
            dry = {s for s in free if 3 * sizes[s] <= level * weight[s]}
            if not dry:
                return target | {s: level * weight[s] for s in free}
            target |= {s: 3.0 * sizes[s] for s in dry}
            free -= dry
        return target

    found = mix(docs).collect()
    sizes, most = Counter(), Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
        most[r.source] = max(most[r.source], len(WORD.findall(r.text or "")))
    want, taken = brute(sizes), Counter()
    for r in found:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(found) == docs.count()
    assert all(abs(taken[s] - want[s]) <= 2 * most[s] for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    key = lambda rows: sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert key(found) == key(mix(docs.repartition(3)).collect())
    assert not mix(docs.limit(0)).collect()
    assert [r.taken for r in mix(docs.where("text is null")).collect()] == [0, 0]


def test_sharding_balance_and_slots(spark, docs):
    from millrace.llm import sharding

    found = sharding.shard(docs, 7).collect()
    assert len(found) == docs.count()
    loads, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in found:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of_text[r.group].add(r.shard)
        if r.doc_id not in (5, 6, None):
            assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert max(loads.values()) - min(loads.values()) < 0.05 * sum(loads.values()) / 7
    assert not sharding.shard(docs.limit(0)).collect()


def test_sharding_in_levels(spark, docs, monkeypatch):
    from millrace.llm import sharding

    monkeypatch.setattr(sharding, "GROUPS_PER_BIN", 8)
    monkeypatch.setattr(sharding, "PARTS_PER_BIN", 4)
    found = sharding.shard(docs, 4).collect()
    loads = Counter()
    for r in found:
        loads[r.shard] += r.size
    assert len(found) == docs.count() and max(loads.values()) - min(loads.values()) < 0.05 * sum(loads.values()) / 4


def test_difference_is_karmarkar_karp():
    from millrace.llm.sharding import difference

    total, went = difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    assert sorted(total.tolist()) == [14, 16]
    assert [int(sum(x for x, w in zip((8, 7, 6, 5, 4), went[:, 0], strict=True) if w == s)) for s in (0, 1)] == total.tolist()


def _karmarkar_karp(weights, k):
    """Where each of the weights (largest first) goes: partial partitions as sorted lists of (sum, members)."""
    queue = [[(w, [i])] + [(0, [])] * (k - 1) for i, w in enumerate(weights)]
    ids = list(range(len(queue)))
    while len(queue) > 1:
        order = sorted(range(len(queue)), key=lambda j: (min(queue[j])[0] - max(queue[j], key=lambda p: p[0])[0], ids[j]))
        (x, y), rest = (queue[order[0]], queue[order[1]]), sorted(order[2:], key=lambda j: ids[j])
        down = sorted(x, key=lambda p: -p[0])
        up = sorted(y, key=lambda p: p[0])
        made = [(a + b, m + n) for (a, m), (b, n) in zip(down, up, strict=True)]
        queue, ids = [queue[j] for j in rest] + [made], [ids[j] for j in rest] + [max(ids) + 1]
    return queue[0]


def test_shards_equal_a_plain_karmarkar_karp(spark):
    """One bin of groups: the sets of groups that share a shard are those of the plain version."""
    from millrace.llm import sharding

    rng = random.Random(12)
    for n, k in ((5, 2), (60, 4), (200, 40)):
        # distinct sizes, so that ties don't matter
        sizes = rng.sample(range(20, 100_000), n)
        rows = [(f"g{i:03d}", size) for i, size in enumerate(sizes)]
        placed = sharding.place_groups(spark.createDataFrame(rows, "group string, bytes long"), k).collect()
        of = defaultdict(set)
        for r in placed:
            of[r.shard].add(r.group)
        largest = sorted(rows, key=lambda r: -r[1])
        want = _karmarkar_karp([size for _, size in largest], k)
        assert sorted(map(sorted, of.values())) == sorted(sorted(largest[i][0] for i in m) for _, m in want if m)
        loads = sorted(sum(dict(rows)[g] for g in groups) for groups in of.values())
        assert loads == sorted(total for total, m in want if m)


def test_shards_of_very_long_texts(spark):
    from millrace.llm import sharding

    rows = [(i, chr(97 + i % 26) * (2_000_000 if i < 3 else 100 + i)) for i in range(80)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    loads = Counter()
    for r in found:
        loads[r.shard] += r.size
    assert len(found) == 80 and max(loads.values()) < 2_100_000


def test_warc_round_trip(spark, tmp_path):
    from millrace.llm import warc

    rng = random.Random(6)
    body = lambda n: "".join(rng.choices("abc é\x1f\x8b\x08<>", k=n))
    same, short = body(500), "short"
    rows = [(i, f"http://x/{i}\r\nWARC/1.1", body(rng.randint(0, 3000))) for i in range(100)]
    rows += [(i, None, same) for i in range(100, 140)] + [(i, "", short) for i in range(140, 150)]
    rows += [(150, "http://null", None), (None, "http://none", same), (7, "http://seven", same)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    manifest = warc.write(pages.repartition(3), str(tmp_path / "archives"))
    for split in (997, 1 << 20):
        found = warc.read(manifest, split_bytes=split).collect()
        want = Counter()
        for i, _, text in rows:
            raw = (text or "").encode()
            revisit = text == same and i is not None and i > 7
            want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None, None if revisit else (text or ""))] += 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html) for r in found) == want
    # any reader of gzip sees the same records in order
    files = [r.file for r in manifest.collect()]
    assert sum(gzip.open(f).read().count(b"WARC-Record-ID") for f in files) == len(rows)
    assert not warc.read(warc.write(pages.limit(0), str(tmp_path / "none"))).collect()


def test_pipeline_stages(spark):
    import corpus_pipeline as pipe
    from millrace.llm import bpe, quality, secrets

    sf = "/root/testdata/sf0.001"
    docs = pipe.table(spark, sf, "documents")
    kept = {r.doc_id for r in quality.quality(docs).where("rejected_by is null").collect()}
    stage = dict(pipe.STAGES)
    first = stage["quality_rules"](spark, docs, sf)
    assert {r.doc_id for r in first.collect()} == kept and first.columns == docs.columns
    second = stage["near_duplicates"](spark, first, sf)
    want = {c for _, _, c in _components([(r.doc_id, r.text) for r in first.collect()])}
    assert {r.doc_id for r in second.collect()} == want and second.columns == docs.columns
    third = stage["secret_scans"](spark, second, sf)
    assert third.count() == second.count() and third.columns == docs.columns
    assert not secrets.find(third).where("size(base_spans) > 0").collect()
    fourth = stage["mixing"](spark, third, sf)
    assert fourth.columns == docs.columns and max(r["count"] for r in fourth.groupBy("doc_id").count().collect()) <= 3
    rows = pipe.run(spark, sf).collect()
    own = bpe.Tokenizer.load(bpe.default_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    brute = Counter()
    for r in fourth.collect():
        ids = own.encode(r.text)
        brute[(r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids)))] += 1
    assert Counter(tuple(r) for r in rows) == brute
    empty = docs.limit(0)
    for _, f in pipe.STAGES:
        empty = f(spark, empty, sf)
        assert not empty.collect()


def test_pipeline_with_clashing_columns_repeats_and_nulls(spark):
    import corpus_pipeline as pipe

    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(2, 7))) for _ in range(n))
    texts = [prose(60) for _ in range(12)]
    near = texts[0] + " " + prose(2)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(0, texts[0], "s0"), (0, near, "s1"), (50, near, None), (None, texts[1], "s1"), (None, prose(70), None), (3, prose(80), "s2")]
    rows += [(60, "my password = hunter2hunter2 " + prose(40), "s0"), (61, None, "s0"), (62, "", None), (63, prose(30_000), "s1")]
    rows.append(rows[-5])
    clash = ("rejected_by", "_base", "spans", "_doc", "_copy", "_epochs", "_key", "base_spans", "row", "root", "size", "epochs", "_counted", "_times")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    table = spark.createDataFrame([(d, t, "xx", s, len(t or ""), *clash) for d, t, s in rows], schema)
    docs, kept = table, {}
    for name, stage in pipe.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == table.columns
        kept[name] = docs.collect()
        assert all(tuple(r)[5:] == clash for r in kept[name])
    assert Counter((r.doc_id, r.text) for r in kept["quality_rules"]) == Counter((d, t) for d, t, _ in rows if t)
    groups = defaultdict(list)
    for r in kept["quality_rules"]:
        groups[min(t for t in [*texts, r.text] if 100 * len(_shingles(t) & _shingles(r.text)) >= 80 * len(_shingles(t) | _shingles(r.text)))].append(r)
    want = Counter(min(((r.doc_id is None, r.doc_id or 0) for r in g)) for g in groups.values())
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept["near_duplicates"]) == want
    assert len({r.text for r in kept["near_duplicates"]}) == len(kept["near_duplicates"]) == len(groups)
    assert len(kept["secret_scans"]) == len(groups) and not any("hunter2" in r.text for r in kept["secret_scans"])
    assert all(r.n_chars == len(r.text) for r in kept["secret_scans"])
    mixed = Counter(r.text for r in kept["mixing"])
    assert set(mixed) <= {r.text for r in kept["secret_scans"]} and max(mixed.values()) <= 3 and len(mixed) >= len(groups) // 2
    # a stage on its own takes rows without words
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, " \n"), (2, "a b"), (2, "a b")], "doc_id long, text string")
    alone = Counter((r.doc_id, r.text) for r in pipe.near_duplicates(spark, odd, "").collect())
    assert alone == {(1, None): 2, (None, ""): 1, (2, " \n"): 1, (2, "a b"): 1}


def test_warc_of_another_writer(spark, tmp_path, monkeypatch):
    import base64

    from millrace.llm import warc

    def record(kind, block, *more, content="application/http; msgtype=response"):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", "WARC-Date: 2020-01-01T00:00:00Z", *more]
        return "\r\n".join([*head, f"Content-Type: {content}", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    body = "<html>é</html>".encode()
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    records = [
        record("warcinfo", b"software: other\r\n", content="application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: http://x/", content="application/http; msgtype=request"),
        record("response", http + body, "WARC-Target-URI: http://x/", f"WARC-Payload-Digest: {sha1}"),
        record("metadata", b"fetchTimeMs: 3\r\n", content="application/warc-fields"),
        record("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 15\r\n\r\n", "WARC-Target-URI: http://x/a", f"WARC-Payload-Digest: {sha1}", "WARC-Refers-To: <urn:uuid:response-44>"),
        record("response", b"dns answer", "WARC-Target-URI: dns:x", content="text/dns"),
    ]
    one, many = tmp_path / "one.warc.gz", tmp_path / "many.warc.gz"
    one.write_bytes(gzip.compress(b"".join(records)))
    many.write_bytes(b"\0\0".join(gzip.compress(r) for r in records))
    files = spark.createDataFrame([(str(p), p.stat().st_size) for p in (one, many)], "file string, bytes long")
    for split in (100, 1 << 20):
        found = Counter((r.record_type, r.url, r.payload_bytes, r.payload_digest, r.html, r.refers_to_id, r.page_id) for r in warc.read(files, split_bytes=split).collect())
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert found == {
            ("response", "http://x/", 15, sha(body), "<html>é</html>", None, None): 2,
            ("revisit", "http://x/a", 15, None, None, "<urn:uuid:response-44>", None): 2,
            ("response", "dns:x", 10, sha(b"dns answer"), "dns answer", None, None): 2,
        }
    # archives roll over, and a damaged payload is noticed
    monkeypatch.setattr(warc, "ROLL_BYTES", 2000)
    pages = spark.createDataFrame([(i, f"http://x/{i}", "long " * 100_000 if i == 5 else f"{i} " * 300) for i in range(60)], "page_id long, url string, html string")
    manifest = warc.write(pages.coalesce(1), str(tmp_path / "rolled"))
    assert manifest.count() > 3 and {r.page_id for r in warc.read(manifest).collect()} == set(range(60))
    bad = tmp_path / "bad.warc.gz"
    bad.write_bytes(gzip.compress(records[2].replace(b"<html>", b"<HTML>")))
    [r] = warc.read(spark.createDataFrame([(str(bad), bad.stat().st_size)], "file string, bytes long")).collect()
    assert r.fits is False and r.record_type == "response" and r.html == "<HTML>é</html>"


def test_warc_loses_nothing(spark, tmp_path):
    from millrace.llm import warc

    rng = random.Random(21)
    body = lambda n: "".join(rng.choices("abc é\x1f\x8b\x08<>", k=n))
    pages = [(i, f"http://x/{i}", body(rng.randint(50, 2000))) for i in range(60)]
    packed = [warc.member(warc.record(i, u, t.encode(), hashlib.sha256(t.encode()).hexdigest(), None)) for i, u, t in pages]

    def read(name, data, split):
        path = tmp_path / name
        path.write_bytes(data)
        rows = warc.read(spark.createDataFrame([(str(path), len(data))], "file string, bytes long"), split_bytes=split).collect()
        good = {r.page_id: r for r in rows if r.record_type != "error"}
        assert all(good[i].html == t and good[i].fits for i, _, t in pages if i in good)
        return set(good), [r.error.partition(": ")[2] for r in rows if r.record_type == "error"]

    everything = set(range(60))
    offsets = [sum(map(len, packed[:k])) for k in range(61)]
    for split in (701, 1 << 20):
        assert read("whole.warc.gz", b"".join(packed), split) == (everything, [])
        # a damaged header, at the start, in the middle and at the end
        for k in (0, 20, 59):
            hurt = packed[:k] + [b"\x1f\x8a" + packed[k][2:]] + packed[k + 1 :]
            assert read("hurt.warc.gz", b"".join(hurt), split) == (everything - {k}, [f"bytes {offsets[k]} to {offsets[k + 1]} are no record"])
        # damage inside, a cut end, other bytes between members, and a file of nothing else
        inner = bytearray(packed[30])
        inner[-6] ^= 255
        found, faults = read("inner.warc.gz", b"".join([*packed[:30], bytes(inner), *packed[31:]]), split)
        assert found == everything - {30} and len(faults) == 1 and f"record at byte {offsets[30]} is damaged" in faults[0]
        found, faults = read("cut.warc.gz", b"".join(packed)[:-5], split)
        assert found == everything - {59} and len(faults) == 1 and "has no end" in faults[0]
        found, faults = read("between.warc.gz", b"junk".join(packed), split)
        assert found == everything and len(faults) == 59
        assert read("none.warc.gz", b"nothing here" * 100, split) == (set(), ["bytes 0 to 1200 are no record"])
        # without compression
        records = [gzip.decompress(p) for p in packed]
        assert read("plain.warc", b"".join(records), split) == (everything, [])
        found, faults = read("plaincut.warc", b"".join(records)[:-300], split)
        assert found >= everything - {58, 59} and len(faults) == 1
        found, faults = read("plainjunk.warc", b"".join(records[:10]) + b"junk" + b"".join(records[10:]), split)
        assert found == set(range(10)) and len(faults) == 1


def test_warc_chunked_bodies(spark, tmp_path):
    from millrace.llm import warc

    body = "<p>é chunked</p>".encode()
    parts = b"5\r\n" + body[:5] + b"\r\n" + b"%x;x=1\r\n" % (len(body) - 5) + body[5:] + b"\r\n0\r\nTrailer: x\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    rows = []
    for k, (block, told) in enumerate(((parts, body), (parts, parts), (parts, b"other"), (body, body))):
        head = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:x-page:{k}>", f"WARC-Payload-Digest: sha1:{hashlib.sha1(told).hexdigest()}"]
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http + block)}", "", ""]
        rows.append(gzip.compress("\r\n".join(head).encode() + http + block + b"\r\n\r\n"))
    path = tmp_path / "chunked.warc.gz"
    path.write_bytes(b"".join(rows))
    found = warc.read(spark.createDataFrame([(str(path), path.stat().st_size)], "file string, bytes long")).collect()
    assert {r.page_id: (r.html, r.fits) for r in found} == {k: (body.decode(), k != 2) for k in range(4)}


def test_join_uneven(spark, monkeypatch):
    from millrace.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(600)], "k long, v long")
    named = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = Counter(tuple(r) for r in common.join_uneven(rows, named, ["k"], "n").select("k", "v", "n", "top").collect())
    assert got == Counter(tuple(r) for r in rows.join(named, "k").select("k", "v", "n", "top").collect())
