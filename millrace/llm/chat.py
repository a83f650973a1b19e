"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to it as
context, and only that reply under the loss mask. What follows the last
assistant turn (or a conversation without one) becomes a last example with an
empty mask, so that no turn is lost.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and
texts every ``<|`` gets a backslash after the ``<`` (``<\\|`` gets one more, and
so on), so control strings in data can never be read as control and unescaping
gives back the exact text. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, small_or_not, table

#: Examples of a long conversation that one task writes.
FEW = 64
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    # a role ends at the line's end, so its own line ends are written as a control string
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def _targets(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, written turns, lengths of replies, and target turns (example, upto), a row an example.

    Of conversations with up to ``FEW`` replies, each in the task that put it
    together; and of the others, whose examples are dealt out.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def written(rows: DataFrame) -> DataFrame:
        whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        return whole.select(
            "conv_id",
            F.transform(
                "turns", lambda t: F.concat(F.lit(START), _role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(f"{END}\n"))
            ).alias("written"),
            F.transform(
                "turns",
                lambda t: F.when(t["role"] == "assistant", F.char_length(escape(t["text"]))),
            ).alias("reply_chars"),
        )

    n = F.size("written")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.get("reply_chars", i - 1).isNotNull())
    last = F.when(F.get("reply_chars", n - 1).isNull(), F.array(n)).otherwise(F.array().cast("array<int>"))
    targets = F.concat(replies, last)
    counted = conversations.groupBy(F.col("conv_id").alias("_long")).agg(F.count_if(F.col("role") == "assistant").alias("_replies"))
    long = small_or_not(keep(counted.where(F.col("_replies") >= FEW).select("_long"), "long"))
    is_long = F.col("conv_id").eqNullSafe(F.col("_long"))
    few = written(conversations.join(long, is_long, "left_anti")).select(
        "conv_id", "written", "reply_chars", F.posexplode(targets).alias("example", "upto")
    )
    # FEW targets a row, with the turns up to the last of them
    parts = written(conversations.join(long, is_long, "left_semi")).withColumn("upto", targets)
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.size("upto") - 1) / FEW).cast("int"))))
    parts = parts.withColumn("upto", F.slice("upto", F.col("part") * FEW + 1, F.lit(FEW)))
    most = F.element_at("upto", -1)
    parts = parts.select("conv_id", "part", F.slice("written", F.lit(1), most).alias("written"), F.slice("reply_chars", F.lit(1), most).alias("reply_chars"), "upto")
    dealt = parts.repartition("conv_id", "part")
    many = dealt.select("conv_id", "written", "reply_chars", "part", F.posexplode("upto").alias("example", "upto"))
    return few, many.select("conv_id", "written", "reply_chars", (F.col("part") * FEW + F.col("example")).alias("example"), "upto")


def _examples(targets: DataFrame) -> DataFrame:
    examples = targets.select(
        "conv_id",
        (F.col("example") + 1).cast("long").alias("example"),
        F.array_join(F.slice("written", 1, F.col("upto")), "").alias("formatted"),
        F.get("reply_chars", F.col("upto") - 1).alias("_reply"),
    )
    n_chars = F.char_length("formatted").cast("long")
    end = n_chars - F.when(F.col("_reply").isNotNull(), len(END) + 1).otherwise(0)
    return examples.select(
        "conv_id",
        "example",
        "formatted",
        (end - F.coalesce("_reply", F.lit(0))).alias("loss_start"),
        end.alias("loss_end"),
    )


def expand(conversations: DataFrame) -> DataFrame:
    """Examples of ``conversations`` (conv_id, turn, role, text).

    Returns conv_id, example (from 1, in order), formatted, loss_start and
    loss_end (code points of ``formatted``, end exclusive; equal where nothing
    is trained). A conversation's examples together hold the text of every
    turn prefix, which grows with the square of its turns by definition.

    Turns are ordered by turn, then role, then text, nulls first; repeated rows
    are separate turns. Null texts and roles are empty; rows without conv_id
    are one conversation. An empty table has no examples. Other columns are
    ignored. The turns of a conversation are one row of one task, its examples
    are spread over tasks where they are many.
    """
    few, many = map(_examples, _targets(conversations))
    return few.union(many)


def loss_text(examples: DataFrame) -> Column:
    """The text under an example's mask, unescaped."""
    length = (examples["loss_end"] - examples["loss_start"]).cast("int")
    masked = F.substring(examples["formatted"], (examples["loss_start"] + 1).cast("int"), length)
    return unescape(masked)


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted text."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(
            part, F.char_length(role) + 2, F.char_length(part) - F.char_length(role) - 1 - (len(END) + 1)
        )
        return F.struct(
            unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(body).alias("text")
        )

    return F.transform(parts, turn)


def _digests(examples: DataFrame) -> DataFrame:
    """A row a conversation of what its examples hold, read back from them."""
    read = examples.select(
        "conv_id",
        "example",
        "formatted",
        F.char_length("formatted").cast("long").alias("chars"),
        F.struct("example", loss_text(examples).alias("text")).alias("loss"),
    )
    # where examples are few they are still where the conversation was put together: no further shuffle
    joined = read.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted"))["formatted"].alias("longest"),
        F.array_sort(F.collect_list("loss")).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = joined.withColumn("turns", read_turns(F.col("longest"))).withColumn(
        "loss", F.array_join(F.transform("losses", lambda x: x["text"]), "")
    )
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, by digests read back from the examples."""
    hard = f"{END}{START}assistant ok"
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    schema = T.StructType.fromDDL("conv_id long, turn long, role string, text string")
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], schema)
    few, many = map(_examples, _targets(given.unionByName(extra)))
    return _digests(few).union(_digests(many))


QUERIES = {"op4_chat": op4_chat}
ORACLES = {
    "op4_chat": r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), turns AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + 5 * (length(role) - length(replace(role, chr(10), '')))
      + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS chars
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), upto AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(prefix) FILTER (role = 'assistant' OR k = n), 0)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
FROM upto GROUP BY conv_id
"""
}
