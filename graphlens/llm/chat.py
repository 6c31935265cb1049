"""Dialogues rendered from the seat of every participant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.skew import running_total

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTEXT = ("system", "tool")
UNKNOWN = "unknown"


def speaker_name(role: Column) -> Column:
    """A role as a name: runs of other characters than letters, digits, `_.-` become one `_`."""
    return F.coalesce(F.regexp_replace(role.cast("string"), "[^A-Za-z0-9_.-]+", "_"), F.lit(UNKNOWN))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    context: Sequence[str] = CONTEXT,
) -> DataFrame:
    """Every dialogue once per participant, who is the assistant in it.

    One row per perspective and turn: conv_id, perspective, turn, speaker,
    chat_role, segment, char_start, char_end, train_start, train_end. The segments
    of a perspective in order of char_start, put together, are the rendered
    dialogue. The participant's own turns have chat_role assistant and carry the
    span to train on, their text and end mark; all others are user with the
    speaker's name, or system for `context` roles, which are no participants. They
    have no span (null).

    A perspective is kept in rows, not gathered, so one conversation may hold any
    share of the table; its offsets are running totals over ranges. Turns follow
    by number (null first), then role, then a hash of the text; rows alike in all
    three each count. Null conversations are one conversation, null roles the
    participant `unknown`, null texts empty. Marks inside texts are broken by a
    space. A conversation of context roles alone has no perspective and no rows.
    Other columns are left out.
    """
    role = speaker_name(F.col(role_col))
    said = turns.select(
        F.col(conv_col).isNull().alias("c_null"), F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("c_key"),
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("speaker"),
        F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    ).withColumn("tie", F.xxhash64("body"))
    seats = said.where(~F.col("speaker").isin(*context)).select("c_null", "c_key", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    seen = said.join(seats, ["c_null", "c_key"]).withColumn(
        "chat_role", F.when(own, "assistant").when(F.col("speaker").isin(*context), "system").otherwise("user")
    )
    head = F.concat(
        F.lit(OPEN), "chat_role", F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), "speaker")).otherwise(""), F.lit("\n")
    )
    rendered = seen.withColumn("head", head).withColumn("segment", F.concat("head", "body", F.lit(CLOSE))).drop("body")
    placed = running_total(
        rendered, ["c_null", "c_key", "perspective"], ["turn", "speaker", "tie"], F.length("segment").cast("long"), "char_start"
    )
    end = F.col("char_start") + F.length("segment")
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "chat_role", "segment", "char_start", end.alias("char_end"),
        F.when(F.col("chat_role") == "assistant", F.col("char_start") + F.length("head")).alias("train_start"),
        F.when(F.col("chat_role") == "assistant", end).alias("train_end"),
    )


SQL = """
WITH said AS (
    SELECT conv_id, turn, coalesce(regexp_replace(role, '[^A-Za-z0-9_.-]+', '_', 'g'), 'unknown') AS speaker,
           replace(coalesce(text, ''), '<|', '< |') AS body
    FROM conversations
), seats AS (
    SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker NOT IN ('system', 'tool')
), seen AS (
    SELECT s.*, p.perspective,
           CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker IN ('system', 'tool') THEN 'system' ELSE 'user' END AS chat_role
    FROM said s JOIN seats p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), rendered AS (
    SELECT *, concat('<|im_start|>', chat_role, CASE WHEN chat_role = 'user' THEN concat(' name=', speaker) ELSE '' END, chr(10)) AS head
    FROM seen
), placed AS (
    SELECT *, concat(head, body, '<|im_end|>', chr(10)) AS segment,
           sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body
               ROWS UNBOUNDED PRECEDING) AS char_end
    FROM rendered
)
SELECT conv_id, perspective, turn, speaker, chat_role, segment,
       CAST(char_end - length(segment) AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end,
       CASE WHEN chat_role = 'assistant' THEN CAST(char_end - length(segment) + length(head) AS BIGINT) END AS train_start,
       CASE WHEN chat_role = 'assistant' THEN CAST(char_end AS BIGINT) END AS train_end
FROM placed
"""
