"""Status feed, token accumulation and scheduled refresh with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.eligibility import is_due

STATUS = "event_id long, channel string, code string, message string, step int, steps int, published_at timestamp"
TOKENS = "answer_id long, seq long, token string, arrived_ms long"


def clamped(events: DataFrame) -> DataFrame:
    """Status events with their step between 0 and the number of steps."""
    return events.withColumn("step", F.least(F.greatest("step", F.lit(0)), F.greatest("steps", F.lit(0))))


def latest_status(events: DataFrame) -> DataFrame:
    """The newest event of each channel; as a stream, run it in update mode."""
    row = F.struct("event_id", "code", "message", "step", "steps", "published_at")
    newest = clamped(events).groupBy("channel").agg(F.max_by(row, F.struct("published_at", "event_id")).alias("_row"))
    return newest.select("channel", "_row.*")


def decode_ndjson(lines: DataFrame, column: str = "value") -> DataFrame:
    """Content of line-delimited JSON from a chat provider; lines that don't decode are left out."""
    schema = "message struct<content: string>, error string, done boolean"
    decoded = lines.withColumn("_j", F.from_json(column, schema))
    return decoded.where("_j.message.content is not null or _j.error is not null").select(
        *lines.columns, F.col("_j.message.content").alias("content"), F.col("_j.error").alias("error")
    )


def decode_sse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Content of ``data:`` lines of server-sent events: the delta, else the message; the end mark is left out."""
    data = F.regexp_extract(column, r"^data:\s*(.*)$", 1)
    choice = "struct<delta: struct<content: string>, message: struct<content: string>>"
    decoded = lines.withColumn("_j", F.when(~data.isin("", "[DONE]"), F.from_json(data, f"choices array<{choice}>")))
    first = F.get("_j.choices", 0)
    content = F.coalesce(first["delta"]["content"], first["message"]["content"])
    return decoded.withColumn("content", content).where("content is not null").drop("_j")


def accumulate(tokens: DataFrame, flush_ms: int = 140) -> DataFrame:
    """Cumulative text of each answer, at most every ``flush_ms`` of arrival time, and whole at its last token.

    A token that is null ends an answer. State holds an answer's text so far, no
    more; tokens of a micro-batch are put in order of ``seq``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, flushed, sent = state.get if state.exists else ("", -flush_ms, "")
        rows = pd.concat(list(batches)).sort_values("seq")
        out, ended = [], False
        for token, at in zip(rows["token"], rows["arrived_ms"], strict=True):
            ended = token is None
            text += token or ""
            if (ended and text != sent) or (not ended and at - flushed >= flush_ms):
                out.append((key[0], text, ended))
                flushed, sent = int(at), text
        if ended:
            state.remove()
        else:
            state.update((text, flushed, sent))
        yield pd.DataFrame(out, columns=["answer_id", "text", "is_final"])

    return tokens.groupBy("answer_id").applyInPandasWithState(
        step,
        "answer_id long, text string, is_final boolean",
        "text string, flushed_ms long, sent string",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def scheduled_refresh(
    ticks: DataFrame, sources: Callable[[], DataFrame], refresh: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """For each batch of ``ticks`` (a stream with a column timestamp): refresh the sources due by its newest tick."""

    def run(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max("timestamp").alias("now"))
        due = sources().where("is_enabled and not is_archived").crossJoin(F.broadcast(now))  # one row
        refresh(due.where(is_due(F.col("next_refresh").cast("timestamp"), F.col("now"))).drop("now"), batch_id)

    return (
        ticks.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )
