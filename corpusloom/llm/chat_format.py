"""Chat text from turns, with Spark expressions only.

``[INST]role[/INST]text</s>`` is a block; adjacent turns of one role share a block, their texts divided by ``[SEP]``.
These four control strings are made harmless inside roles and texts by an escape character after their first sign, and
the escape character itself is doubled, so that every turn can be read back.  The text is kept as segments with a mask:
texts of assistant turns carry the loss, everything else does not.

Inputs: null texts and null roles count as empty; null turns come first; equal turn numbers are ordered by role, then
text; rows with a null conversation id form one conversation; an empty table gives no rows; other columns are ignored.
One conversation is one row, so its turns meet in one task and its text must fit a cell (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, NEXT, CLOSE = "[INST]", "[/INST]", "[SEP]", "</s>"
ESCAPE = "␛"
_CONTROL = r"(\[)(INST\]|/INST\]|SEP\])|(<)(/s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, ESCAPE, ESCAPE * 2), _CONTROL, f"$1$3{ESCAPE}$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and segments (array of text, loss) whose texts make up ``formatted``.

    ``turns`` has conv_id, turn, role, text.
    """
    blank = F.lit("")
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    collected = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    roles = F.col("turns.role")
    count = F.size("turns")
    # Beside each turn the roles before and after it: where they differ a block begins or ends.
    beside = collected.select(
        "conv_id",
        F.arrays_zip(
            roles.alias("role"),
            F.col("turns.text").alias("text"),
            F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, F.lit(1), count - 1)).alias("before"),
            F.slice(roles, F.lit(2), count - 1).alias("after"),
        ).alias("turns"),
    )

    def pieces(turn: Column) -> Column:
        first, last = ~turn["role"].eqNullSafe(turn["before"]), ~turn["role"].eqNullSafe(turn["after"])
        head = F.when(first, F.concat(F.lit(OPEN), escape(turn["role"]), F.lit(BODY))).otherwise(F.lit(NEXT))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), (turn["role"] == loss_role).alias("loss")),
            F.struct(F.when(last, F.lit(CLOSE)).otherwise(blank).alias("text"), F.lit(False).alias("loss")),
        )

    cut = beside.select("conv_id", F.filter(F.flatten(F.transform("turns", pieces)), lambda s: s["loss"] | (s["text"] != "")).alias("segments"))
    return cut.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_conversations(formatted: DataFrame) -> DataFrame:
    """``formatted`` with the column turns (array of role, text), recovered from the formatted text alone."""

    def block(text: Column) -> Column:
        rest = F.substr(text, F.lit(len(OPEN) + 1))
        role = F.regexp_extract(rest, r"(?s)^(.*?)\[/INST\]", 1)
        return F.struct(role.alias("role"), F.split(F.substr(rest, F.length(role) + F.lit(len(BODY) + 1)), r"\[SEP\]").alias("texts"))

    blocks = F.transform(F.filter(F.split("formatted", CLOSE), lambda text: text != ""), block)
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda text: F.struct(unescape(b["role"]).alias("role"), unescape(text).alias("text")))))
    return formatted.withColumn("turns", turns)


def conversation_digest(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: turns and loss as read back from the output."""
    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    kept = format_conversations(turns).select("conv_id", "formatted", F.array_join(learnt, "").alias("learnt"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_conversations(kept).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(spoken, "utf-8"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learnt", "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SAMPLE = "</s>[INST] ok [/INST]"


def with_sample(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts are made of control strings."""
    two = turns.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE).alias("text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(two)


SQL = rf"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '{SAMPLE}' FROM (SELECT unnest([0, 1]) AS i)),
e AS (SELECT *, length(regexp_replace(replace(text, '{ESCAPE}', '{ESCAPE * 2}'), '([<\[])(/s>|INST\]|/INST\]|SEP\])', '\1{ESCAPE}\2', 'g')) AS text_chars,
  length(regexp_replace(replace(role, '{ESCAPE}', '{ESCAPE * 2}'), '([<\[])(/s>|INST\]|/INST\]|SEP\])', '\1{ESCAPE}\2', 'g')) AS role_chars,
  coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), true) AS opens FROM a)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN opens THEN {len(OPEN) + len(BODY) + len(CLOSE)} + role_chars ELSE {len(NEXT)} END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
