"""The cache kept up to date by changes against one built anew."""

from pyspark.sql import functions as F

from millrace.operators import cache
from millrace.sources import views
from millrace.sources.versions import TableSet

SF = "/root/testdata/sf0.001"


def _blocks(store):
    return {(r.document_id, r.block_hash) for r in cache.read(store).collect()}


def test_updates_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "MOST_GENERATIONS", 3)
    docs, sources = views.documents(spark, SF), views.sources(spark, SF)
    store = TableSet(spark, str(tmp_path / "cache"))
    cache.build(store, docs, sources)
    now, folders = docs, []
    for k in (7, 11, 23, 5):
        content = F.when(F.col("id") % k == 0, F.concat("content", F.lit(f" {k}"))).otherwise(F.col("content"))
        later = now.where(F.col("id") % (k * 3) != 1).withColumns({"content": content, "content_hash": F.sha2(content, 256)})
        told = cache.update(store, later, sources, cache.changed(now, later))
        folders.append(told["folders"])
        now = later
        other = TableSet(spark, str(tmp_path / f"whole{k}"))
        cache.build(other, now, sources)
        assert _blocks(store) == _blocks(other) and cache.fingerprint(store) == cache.fingerprint(other)
        assert told["rebuilt"] > 0 and store.current() == told["version"]
    assert cache.FOLDERS in folders
    # nothing changed, or nothing that shows in a block: no new version
    version = store.current()
    assert cache.update(store, now, sources, cache.changed(now, now))["folders"] == 0
    same = now.withColumn("crawled_at", F.col("crawled_at") + F.expr("interval 1 day"))
    assert cache.update(store, same, sources, cache.changed(now, same).limit(3))["rebuilt"] == 0 and store.current() == version


def test_folders_without_a_change_are_not_read(spark, tmp_path):
    docs, sources = views.documents(spark, SF), views.sources(spark, SF)
    store = TableSet(spark, str(tmp_path / "cache"))
    cache.build(store, docs, sources)
    one = docs.where("not is_archived and status_code = 'ok'").select("id").limit(1)
    later = docs.withColumn("content", F.when(F.col("id") == one.first()["id"], "other").otherwise(F.col("content")))
    told = cache.update(store, later, sources, one)
    assert told["folders"] == 1 and told["rebuilt"] == 1
    names = store.files.names(f"{store.root}/{store.tables()['blocks_1']['path']}")
    assert len([n for n in names if n.startswith("bucket=")]) == 1
    [bucket] = [int(n[7:]) for n in names if n.startswith("bucket=")]
    assert all(f"bucket={bucket}/" in f for f in cache.read(store, [bucket]).inputFiles())


def test_entries_and_toggles(spark):
    kind = "cache_key string, content string, fingerprint string, built_at int"
    present = spark.createDataFrame([("a", "x", "f", 1), ("b", "y", "g", 1)], kind)
    new = spark.createDataFrame([("b", "z", "h", 2), ("b", "w", "i", 3), ("c", "v", "j", 1)], kind)
    assert sorted(tuple(r)[:2] for r in cache.upsert_entries(present, new).collect()) == [("a", "x"), ("b", "w"), ("c", "v")]
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, on boolean")
    wanted = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True)], "id int, value boolean")
    assert sorted(r.id for r in cache.toggled(rows, wanted, "on").collect()) == [2, 3]
