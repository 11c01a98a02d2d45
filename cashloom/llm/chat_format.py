"""Operator 7: chat formatting by prefix-target expansion. DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context, and only that
reply is trainable. A conversation that does not end with an assistant turn gives one more example that
holds all its turns as context and trains nothing, so that no turn is lost.

A turn is written as ``<|role|>`` role ``<|text|>`` text ``<|end|>``. Control strings inside roles and
texts (those of this template and of other common ones) are escaped reversibly: ``~`` becomes ``~0``
and each control string ``~`` with a letter of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
# fixed values: control strings of this and other chat templates
CONTROLS = {
    "a": "<|", "b": "|>", "c": "[INST]", "d": "[/INST]", "e": "<s>", "f": "</s>",
    "g": "<<SYS>>", "h": "<</SYS>>", "i": "<start_of_turn>", "j": "<end_of_turn>",
}
PROBE_ID = -7
PROBE_TEXT = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    for letter, control in CONTROLS.items():
        out = F.replace(out, F.lit(control), F.lit("~" + letter))
    return out


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`. After it a ``~`` is always followed by 0 or a letter of CONTROLS, so
    the letters can go first and ``~0`` last."""
    for letter, control in CONTROLS.items():
        text = F.replace(text, F.lit("~" + letter), F.lit(control))
    return F.replace(text, F.lit("~0"), F.lit("~"))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(ROLE), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def training_examples(conversations: DataFrame) -> DataFrame:
    """Examples of ``conversations`` (conv_id, turn, role, text; other columns are ignored).

    Returns conv_id, example int (1, 2, ... in a conversation), context string, target string and
    trainable boolean; the formatted example is context followed by target, and the loss mask covers the
    target alone. Turns are ordered by turn, then role, then text; a null turn comes first, so repeated
    rows are repeated turns. A null role or text counts as empty, null conv_ids form one conversation.
    An empty table gives no examples. Each example holds all of its preceding turns, so a
    conversation's rows have to meet in one task: its size is bounded by the conversation, not by the
    table.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    whole = whole.select(
        "conv_id",
        F.transform("t", lambda x: format_turn(x["role"], x["text"])).alias("parts"),
        F.filter(
            F.transform("t", lambda x, i: F.when(x["role"] == "assistant", i + 1)), lambda i: i.isNotNull()
        ).alias("replies"),
    )
    last = F.size("parts")
    ends = F.when(
        F.coalesce(F.try_element_at("replies", F.lit(-1)), F.lit(0)) < last,
        F.concat("replies", F.array(last)),
    ).otherwise(F.col("replies"))
    rows = whole.select("conv_id", "parts", "replies", F.posexplode(ends).alias("_i", "upto"))
    trains = F.col("_i") < F.size("replies")
    before = F.when(trains, F.col("upto") - 1).otherwise(F.col("upto"))
    return rows.select(
        "conv_id",
        (F.col("_i") + 1).alias("example"),
        F.array_join(F.slice("parts", F.lit(1), before), "").alias("context"),
        F.when(trains, F.element_at("parts", F.col("upto"))).otherwise(F.lit("")).alias("target"),
        trains.alias("trainable"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string, unescaped."""
    pieces = F.slice(F.split(formatted, F.lit("<\\|end\\|>"), F.lit(-1)), F.lit(1), F.size(F.split(formatted, F.lit("<\\|end\\|>"), F.lit(-1))) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(ROLE) + 1)), TEXT, 1)).alias("role"),
            unescape(F.substring_index(p, TEXT, -1)).alias("text"),
        ),
    )


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the examples hold, read back, per conversation.

    The turns come from the longest example, which holds them all; the loss text is made of the targets.
    """
    own = examples.groupBy("conv_id").agg(
        F.max_by(F.concat("context", "target"), "example").alias("_all"),
        F.array_sort(F.collect_list(F.when(F.col("trainable"), F.struct("example", "target")))).alias("_targets"),
        F.sum(F.char_length("context") + F.char_length("target")).alias("formatted_chars"),
    )
    own = own.select(
        "conv_id", "formatted_chars", read_turns(F.col("_all")).alias("_turns"),
        F.array_join(
            F.transform("_targets", lambda x: F.element_at(read_turns(x["target"]), 1)["text"]), ""
        ).alias("_loss"),
    )
    return own.select(
        "conv_id",
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.char_length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return conversation_digests(training_examples(table.unionByName(probe)))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '~', '~0')"
    for letter, control in CONTROLS.items():
        out = f"replace({out}, '{control}', '~{letter}')"
    return out


_FRAME = len(ROLE) + len(TEXT) + len(END)
OP7_SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}'
    UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'
), n AS (
    SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS m,
           CAST(role = 'assistant' AS int) AS a,
           length({_sql_escape('role')}) + length({_sql_escape('text')}) + {_FRAME} AS len
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
    SELECT *, sum(a) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
           + max(CASE WHEN i = m THEN 1 - a ELSE 0 END) OVER (PARTITION BY conv_id) AS held
    FROM n
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN a = 1 THEN length(text) END), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE a = 1), '')) AS loss_sha256,
       CAST(sum(len * held) AS bigint) AS formatted_chars
FROM e GROUP BY conv_id
"""
