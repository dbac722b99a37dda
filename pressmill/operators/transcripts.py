"""Conversations: questions with their answers, and where they end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.functions.text import strip

# What a user types to leave.
EXIT_COMMANDS = ["/bye", "bye", "exit", "quit"]
TURNS_PER_BLOCK = 4096


def with_next_turn(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block_size: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """Add role, turn and text of the turn that follows each one.

    Turns are numbered from 0. A conversation is cut into blocks of turn
    numbers, so one that holds a large part of the table is many groups; the
    first turn of a block is handed to the last turn of the block before it.
    What is handed over comes from turns beyond the first block only, a filter
    the scan can use, and is nothing at all for conversations of common length.
    """
    blocked = turns.withColumn("_block", F.floor(F.col(turn) / block_size))
    here = F.struct(
        F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    by_block = Window.partitionBy(conv_id).orderBy("_block")
    before = (
        blocked.select(conv_id, "_block")
        .distinct()
        .withColumn("_before", F.lag("_block").over(by_block))
        .filter(F.col("_before").isNotNull())
    )
    handed = (
        blocked.filter(F.col(turn) >= block_size)
        .groupBy(conv_id, "_block")
        .agg(F.min(here).alias("_after"))
        .join(before, [conv_id, "_block"])
        .select(conv_id, F.col("_before").alias("_block"), "_after")
    )
    order = Window.partitionBy(conv_id, "_block").orderBy(turn)
    return (
        blocked.withColumn("_next", F.lead(here).over(order))
        .join(handed, [conv_id, "_block"], "left")
        .withColumn("_next", F.coalesce("_next", "_after"))
        .select(
            *turns.columns,
            F.col("_next.turn").alias("next_turn"),
            F.col("_next.role").alias("next_role"),
            F.col("_next.text").alias("next_text"),
        )
    )


def question_answers(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block_size: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """Each user turn with the assistant turn right after it, NULL when there is none."""
    answered = F.col("next_role") == "assistant"
    return (
        with_next_turn(turns, conv_id, turn, role, text, block_size)
        .filter(F.col(role) == "user")
        .select(
            conv_id,
            F.col(turn).alias("question_turn"),
            F.col(text).alias("question"),
            F.when(answered, F.col("next_turn")).alias("answer_turn"),
            F.when(answered, F.col("next_text")).alias("answer"),
        )
    )


def until_exit(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    commands: list[str] = EXIT_COMMANDS,
) -> DataFrame:
    """Turns before the first exit command of their conversation.

    Only the exits are grouped, one row per conversation that has any; the
    turns stay on the side that adaptive execution may split.
    """
    leaves = (F.col(role) == "user") & F.lower(strip(F.col(text))).isin(*commands)
    exits = turns.filter(leaves).groupBy(conv_id).agg(F.min(turn).alias("_exit"))
    return (
        turns.join(exits, conv_id, "left")
        .filter(F.col("_exit").isNull() | (F.col(turn) < F.col("_exit")))
        .drop("_exit")
    )
