"""What kept jobs from growing with their input alone: each of these failed before."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import html
from millrace.llm import jaccard
from millrace.llm.common import mix64
from millrace.operators import archive, flows, index, links, nodes, refresh, retrieve, store
from millrace.sources import versions, views


@pytest.mark.parametrize("first", [1, 64, 10**9])
def test_shards_answer_without_rows_for_pairs(first):
    """A question over a shard gives its best blocks and no others, also where the rest of its lists isn't read whole."""
    rng = np.random.default_rng(first % 1000)
    n, terms = 400, 60
    lists = [[sorted(rng.choice(terms, size=rng.integers(0, k), replace=False).tolist()) for _ in range(n)] for k in (4, 40)]
    titles = [None if i % 50 == 0 else f"T{i % 7}" for i in range(n)]
    rows = pa.table({"document_id": pa.array(range(n)), "title_order": pa.array(titles), "headers": pa.array(lists[0], pa.list_(pa.int64())), "bodies": pa.array(lists[1], pa.list_(pa.int64()))})
    shard = index._Shard(rows)
    for asked in ([0], [1, 2, 3], list(range(0, 60, 3)), list(range(70)), [99]):
        score = [index.HEADER * len(set(asked) & set(h)) + index.BODY * len(set(asked) & set(b)) for h, b in zip(*lists, strict=True)]
        want = sorted((-s, titles[i] is not None, titles[i] or "", i) for i, s in enumerate(score) if s)[:12]
        places, scores = shard.best(np.array(asked), 12, first)
        assert list(zip((-scores).tolist(), shard.rows["document_id"].take(pa.array(places)).to_pylist(), strict=True)) == [(w[0], w[3]) for w in want]


def test_bitmaps_drop_near_misses_and_no_link(spark):
    """Pairs of a family that are nearly alike enough are dropped before their sets are joined; no link is."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 140).astype(np.uint64)
    sets = []
    for other in (0, 8, 15, 16, 22, 30, 40):
        sets.append(np.concatenate([base[other:], rng.integers(0, 2**63, other).astype(np.uint64)]))
    rows = [(i, j, len(a), jaccard.bitmap(mix64(a)).tolist(), len(b), jaccard.bitmap(mix64(b)).tolist()) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j]
    pairs = spark.createDataFrame(rows, "a int, b int, n_a long, bits_a array<long>, n_b long, bits_b array<long>")
    room = {(r.a, r.b) for r in pairs.where(jaccard._room(*map(F.col, ("n_a", "bits_a", "n_b", "bits_b")))).collect()}
    common = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j, *_ in rows}
    links = {p for p, c in common.items() if 100 * c >= 80 * (280 - c)}
    assert links and links <= room
    assert not any(common[p] < 115 for p in room)


def test_an_archive_has_no_folder_a_document(spark, tmp_path):
    root = str(tmp_path / "archive")
    rows = spark.range(40).select(F.lit("s").alias("source_guid"), F.lit("f").alias("folder_guid"), F.col("id").cast("string").alias("document_guid"), F.lit("é").alias("content"))
    archive.write(rows.coalesce(2), root)
    archive.write(rows.where("id % 4 = 0").withColumn("content", F.lit("new")).coalesce(1), root)
    assert sum(p.is_dir() for p in (tmp_path / "archive").rglob("*")) == 3
    (tmp_path / "archive" / "files" / "container=00000003").mkdir()  # a write that isn't whole
    assert sorted((int(r.document_guid), r.bytes) for r in archive.files(spark, root).collect()) == [(i, 2 if i % 4 else 3) for i in range(40)]


def test_patterns_are_searched_once(spark):
    """The plans name each of the six patterns once for a text, and take texts apart only after a match."""
    sf = "/root/testdata/sf0.001"
    plan = links.q_contact_candidates(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lambda") + plan.count("regexp_extract_all(namedlambda") == 6 == plan.count("regexp_extract_all(")
    rows = spark.createDataFrame([(1, "<p>mail a@b.com or 0212 555 12 34</p><p>none</p>")], "key long, html string")
    texts = nodes.linked_texts(nodes.nodes(rows))
    whole = texts._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter (size(" in line and "regexp_extract_all" in line for line in whole.split("\n"))
    assert [[s.kind for s in r.spans] for r in texts.collect()] == [["email", "phone"]]


def test_few_texts_of_a_batch_are_pythons_at_once():
    sizes = []

    class Texts(list):
        def slice(self, at, n):
            part = pa.array(self[at : at + n], pa.string())
            sizes.append(len(part))
            return part

    texts = [None if i % 7 == 0 else f"<p>{i} &amp;</p>" for i in range(1000)]
    assert html._each(Texts(texts), html.text_of).to_pylist() == [html.text_of(t) for t in texts]
    assert sum(sizes) == 1000 and max(sizes) <= 256
    assert len(html._each(pa.array([], pa.string()), html.text_of)) == 0


def _shuffles(df, column):
    """How many shuffles of ``df``'s plan carry ``column``, by itself or in a struct."""
    spark = df.sparkSession
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo, found = [df.select("*")._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            output = [node.output().apply(i) for i in range(node.output().size())]
            found += node.nodeName() == "Exchange" and any(a.name() == column or f"{column}:" in a.dataType().catalogString() for a in output)
        return found
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_a_refresh_shuffles_staged_texts_once(spark):
    sf = "/root/testdata/sf0.001"
    docs, sources, staged = views.documents(spark, sf), views.sources(spark, sf), views.incoming(spark, sf)
    assert _shuffles(docs, "content") == _shuffles(staged, "content") == _shuffles(retrieve.blocks(docs, sources), "content") == 0
    none = sources.limit(0).select(F.col("id").alias("source_id"), F.col("name").alias("message"))
    after, results = flows.refresh(docs, staged, sources, none, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    assert _shuffles(after, "content") == 1 and _shuffles(results, "content") == 0


def test_a_redownload_shuffles_the_texts_of_a_side_once(spark):
    sf = "/root/testdata/sf0.001"
    docs, staged = views.documents(spark, sf), views.incoming(spark, sf)
    after = store.upsert_by_origin(docs, staged, docs)
    assert _shuffles(after, "content") == 2
    rows = after.where("change = 'inserted'").select("id", "url").collect()
    last = docs.agg(F.max("id")).first()[0]
    assert rows and sorted(r.id for r in rows) == list(range(last + 1, last + 1 + len(rows)))
    # a batch that repeats a new URL gets one number for it, and keeps its own without a table of ids
    twice = staged.unionByName(staged.withColumns({"id": F.col("id") + 20_000_000, "url": F.upper("url")}))
    assert sorted(r.id for r in store.upsert_by_origin(docs, twice, docs).where("change = 'inserted'").collect()) == sorted(r.id for r in rows)
    assert store.upsert_by_origin(docs, staged).where("change = 'inserted' and id >= 10000000").count() == len(rows)


def test_tables_of_a_commit_are_made_of_those_it_wrote(spark, tmp_path):
    tables, made = versions.TableSet(spark, str(tmp_path / "set")), spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return 2 * x

    tables.commit({"a": spark.range(7).select(counted("id").alias("x")), "b": lambda t: t["a"].where("x > 3")})
    assert made.value == 7 and sorted(r.x for r in tables.read()["b"].collect()) == [4, 6, 8, 10, 12]


def test_pages_that_no_state_can_be_told_of_fail_a_refresh(spark, tmp_path):
    """What fails before anything is written fails a refresh as well: all of its sources are told so."""
    sf = "/root/testdata/sf0.001"
    docs, sources = views.documents(spark, sf), views.sources(spark, sf).withColumn("succeeded_at", F.lit(None).cast("timestamp_ntz"))
    tables = versions.TableSet(spark, str(tmp_path / "set"))
    tables.commit({"documents": docs, "sources": sources, "blocks": refresh._blocks})
    broken = views.incoming(spark, sf).withColumn("status_code", F.raise_error(F.lit("no state")).cast("string"))
    none = sources.limit(0).select(F.col("id").alias("source_id"), F.col("name").alias("message"))
    told = refresh.refresh_set(tables, broken, none, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).collect()
    assert {r.state for r in told} == {"failed"} and len(told) == sources.count() and all("no state" in r.message for r in told)
    assert tables.read()["documents"].count() == docs.count()
