"""Streams over files that are there already, run to their end."""

from pyspark.sql import functions as F

from millrace.streaming import status


def _stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).repartition(1).write.mode("append").json(path)
    return spark.readStream.schema(schema).json(path)


def test_latest_status(spark, tmp_path):
    rows = [(i, f"c{i % 2}", "code", "m", i, 3, None) for i in range(6)]
    stream = _stream(spark, rows, status.STATUS, str(tmp_path / "in"))
    query = status.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.channel, r.event_id, r.step) for r in spark.table("latest").collect()} == {("c0", 4, 3), ("c1", 5, 3)}


def test_accumulated_tokens(spark, tmp_path):
    rows = [(1, k, t, ms) for k, (t, ms) in enumerate([("a", 0), ("b", 50), ("c", 150), ("d", 160), (None, 170)])] + [(2, 0, "x", 0)]
    stream = _stream(spark, rows, status.TOKENS, str(tmp_path / "in"))
    query = status.accumulate(stream).writeStream.outputMode("append").format("memory").queryName("texts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.text, r.is_final) for r in spark.table("texts").where("answer_id = 1").collect()]
    assert got == [("a", False), ("abc", False), ("abcd", True)]


def test_scheduled_refresh(spark, tmp_path):
    schema = "timestamp timestamp"
    stream = _stream(spark, [], schema, str(tmp_path / "in"))
    spark.sql("select timestamp'2024-01-01 12:00:00' as timestamp").write.mode("append").json(str(tmp_path / "in"))
    sources = spark.sql(
        "select * from values (1, true, false, timestamp'2024-01-01 11:00:00'), (2, true, false, timestamp'2024-01-01 13:00:00'),"
        " (3, true, false, null), (4, false, false, null) as t(id, is_enabled, is_archived, next_refresh)"
    )
    seen = []
    query = status.scheduled_refresh(
        stream, lambda: sources, lambda due, _: seen.append(sorted(r.id for r in due.collect())), str(tmp_path / "check"), availableNow=True
    )
    query.awaitTermination(120)
    assert seen == [[1, 3]]


def test_provider_lines(spark):
    lines = spark.createDataFrame(
        [('{"message":{"content":"a"}}',), ("broken",), ('{"error":"no"}',)], "value string"
    )
    assert [(r.content, r.error) for r in status.decode_ndjson(lines).collect()] == [("a", None), (None, "no")]
    events = spark.createDataFrame(
        [('data: {"choices":[{"delta":{"content":"x"}}]}',), ("data: [DONE]",), ('data: {"choices":[{"message":{"content":"y"}}]}',), (": ping",)],
        "value string",
    )
    assert [r.content for r in status.decode_sse(events).select(F.col("content")).collect()] == ["x", "y"]


def test_frames_of_chunks_cut_anywhere(spark, tmp_path):
    import random

    from millrace.streaming import framing

    rng = random.Random(2)
    texts = ["one\ntwo\r\n\nthree", "é🙂\r\nçift\n", "", "x" * 500, "\n\r\n", "a\rb\n", "end\r\n"]
    rows = []
    for i, text in enumerate(texts * 4):
        data, cuts = text.encode(), []
        cuts = sorted(rng.sample(range(1, max(2, len(data))), k=min(len(data) // 2, 12))) if len(data) > 1 else []
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        rows += [(f"s{i}", k, bytearray(p) if p else None, k == len(parts) - 1) for k, p in enumerate(parts)]
    rng.shuffle(rows)
    rows += rows[:5]
    at = str(tmp_path / "in")
    for part in (rows[: len(rows) // 3], rows[len(rows) // 3 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]):
        spark.createDataFrame(part, framing.CHUNKS).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(framing.CHUNKS).option("maxFilesPerTrigger", 1).parquet(at)
    query = framing.frames(stream).writeStream.outputMode("append").format("memory").queryName("frames").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {}
    for r in spark.table("frames").collect():
        got.setdefault(r.stream_id, {})[r.line_no] = r.value
    for i, text in enumerate(texts * 4):
        want = [x.removesuffix("\r") for x in text.split("\n")]
        want = want[:-1] if text.endswith("\n") or not text else want
        assert [got.get(f"s{i}", {}).get(k) for k in range(len(want))] == want and len(got.get(f"s{i}", {})) == len(want)


def test_streams_of_a_bucket_are_one_call(spark, tmp_path):
    """Streams that share a group keep apart over batches, ended ones stay ended, and calls don't grow with streams."""
    from millrace.streaming import framing

    n, at = 120, str(tmp_path / "in")
    first = [(f"s{i}", 1, bytearray(b"b\nc"), i % 2 == 0) for i in range(n)]
    second = [(f"s{i}", 0, bytearray(f"{i}".encode()), False) for i in range(n)]
    third = [(f"s{i}", 2, bytearray(b"d\n"), True) for i in range(n)] + [(f"s{i}", 3, bytearray(b"late\n"), True) for i in range(n)]
    for part in (first, second, third):
        spark.createDataFrame(part, framing.CHUNKS).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(framing.CHUNKS).option("maxFilesPerTrigger", 1).parquet(at)
    query = framing.frames(stream, buckets=3).writeStream.outputMode("append").format("memory").queryName("shared").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {}
    for r in spark.table("shared").collect():
        got.setdefault(r.stream_id, []).append((r.line_no, r.value))
    assert {k: sorted(v) for k, v in got.items()} == {f"s{i}": [(0, f"{i}b"), (1, "c" if i % 2 == 0 else "cd")] for i in range(n)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
