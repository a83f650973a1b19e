"""Lines of streams that arrive in chunks cut at any byte."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import views
from ..sources.versions import scratch
from .status import decode_ndjson

CHUNKS = "stream_id string, seq long, data binary, last boolean"
_STATE = (
    "ids array<string>, next_seq array<long>, line_no array<long>, rest array<binary>, "
    "held_of array<int>, held_seq array<long>, held_data array<binary>, held_last array<boolean>"
)
#: Buckets of streams, each of which is one group of the state; a checkpoint keeps to its number.
BUCKETS = 4096


def frames(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The lines of each stream of ``chunks`` (stream_id, seq from 0, data, last): stream_id, line_no from 0, and value.

    A line ends with LF or CRLF, or with its stream, and is decoded when it is
    whole, so no cut, inside a character or between CR and LF, shows in it.
    State holds the bytes of the line that isn't finished, and chunks that came
    before the ones they follow. Repeated chunks count once, null data is
    empty, blank lines are lines; a stream that has ended takes no more.
    Streams of one bucket share a group, as a call of Python costs
    milliseconds: a micro-batch has ``buckets`` calls at most, however many streams.
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, seqs, lines, rests, held_of, *held_lists = state.get if state.exists else ([], [], [], [], [], [], [], [])
        # of each stream: next chunk (-1 where it has ended), next line, bytes of the unfinished line, chunks that came early
        known = {i: [at, line, bytes(rest), {}] for i, at, line, rest in zip(ids, seqs, lines, rests, strict=True)}
        for of, seq, data, last in zip(held_of, *held_lists, strict=True):
            known[ids[of]][3][seq] = (bytes(data), bool(last))
        fresh = {}
        for batch in batches:
            for i, seq, data, last in zip(batch["stream_id"], batch["seq"], batch["data"], batch["last"], strict=True):
                stream = fresh[i] = known.setdefault(i, [0, 0, b"", {}])
                if 0 <= stream[0] <= seq:
                    stream[3].setdefault(int(seq), (bytes(data) if data is not None else b"", bool(last)))
        out = []
        for i, stream in fresh.items():
            at, line, rest, held = stream
            parts, ended = [rest], False
            while at >= 0 and at in held and not ended:
                data, ended = held.pop(at)
                parts.append(data)
                at += 1
            *whole, rest = b"".join(parts).split(b"\n")
            if ended and rest:
                whole, rest = [*whole, rest], b""
            out += [(i, line + k, x.removesuffix(b"\r").decode("utf-8", "replace")) for k, x in enumerate(whole)]
            stream[:] = (-1, line + len(whole), b"", {}) if ended else (at, line + len(whole), rest, held)
        early = [(of, seq, *x) for of, stream in enumerate(known.values()) for seq, x in sorted(stream[3].items())]
        columns = [[s[k] for s in known.values()] for k in range(3)]
        state.update((list(known), *columns, *([x[k] for x in early] for k in range(4))))
        yield pd.DataFrame(out, columns=["stream_id", "line_no", "value"])

    bucket = F.pmod(F.xxhash64("stream_id"), F.lit(buckets)).cast("int")
    return chunks.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(
        step, "stream_id string, line_no long, value string", _STATE, "append", GroupStateTimeout.NoTimeout
    )


#: Characters of a token, and micro-batches that take the chunks, in the query below.
_TOKEN, _BATCHES = 20, 2


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's turns as a provider streams them: a JSON line a token, cut into chunks of a length of their own."""
    turns = views.table(spark, sf_dir, "conversations").where("role = 'assistant' and length(text) > 0")
    tokens = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_TOKEN}}}"), F.lit(0))
    line = lambda t: F.concat(F.to_json(F.struct(F.struct(t.alias("content")).alias("message"))), F.when(F.col("turn") % 2 == 0, "\r\n").otherwise("\n"))
    data = F.array_join(F.transform(tokens, line), "").cast("binary")
    size = (F.lit(11) + F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(50))).cast("int")
    whole = turns.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream_id"), data.alias("whole"), size.alias("size"))
    n = F.ceil(F.octet_length("whole") / F.col("size")).cast("int")
    each = whole.select("stream_id", "whole", "size", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    cut = F.substring("whole", F.col("seq") * F.col("size") + 1, F.col("size"))
    return each.select("stream_id", F.col("seq").cast("long").alias("seq"), cut.alias("data"), (F.col("seq") == F.col("n") - 1).alias("last"))


def q_framed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns put together again from their chunks, which come in several batches and out of order."""
    landed, out, check = (scratch(spark, name) for name in ("chunks", "frames", "frames_check"))
    # as many files as tasks; those of a micro-batch grow with them
    files = max(2 * _BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    _chunked(spark, sf_dir).repartition(files, F.col("seq") % 7, F.xxhash64("stream_id")).write.parquet(landed)
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", -(-files // _BATCHES)).parquet(landed)
    query = frames(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    lines = decode_ndjson(spark.read.schema("stream_id string, line_no long, value string").parquet(out))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "content")))
    text = F.array_join(F.transform(ordered, lambda t: t["content"]), "")
    return lines.groupBy("stream_id").agg(F.count("*").alias("tokens"), F.sha2(text, 256).alias("text_hash"))


QUERIES = {"framed_turns": q_framed_turns}
ORACLES = {
    "framed_turns": f"""
SELECT conv_id || '/' || turn AS stream_id, ceil(length(text) / {_TOKEN}.0)::BIGINT AS tokens, sha256(text) AS text_hash
FROM conversations WHERE role = 'assistant' AND length(text) > 0""",
}
