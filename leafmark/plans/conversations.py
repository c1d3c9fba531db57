"""Conversations and their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.functions import rules as R


def open_conversations(questions: DataFrame, now=None) -> DataFrame:
    """New conversations ``(conversation_id, title, created_at, updated_at)`` named after a question."""
    stamp = F.unix_millis(F.current_timestamp()) if now is None else now
    return questions.select(
        "conversation_id",
        X.conversation_title(F.col("question")).alias("title"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, turn, role, text)`` rows as conversations and messages.

    The title is the first user turn; the turn number stands in for the time. Both aggregates combine
    before the shuffle, so one long conversation does not fill a task.
    """
    messages = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.col("conv_id").alias("conversation_id"),
        "role",
        F.col("text").alias("content"),
        F.lit("complete").alias("status"),
        F.col("turn").alias("created_at"),
    )
    asked = F.when(F.col("role") == "user", F.col("turn"))
    conversations = turns.groupBy(F.col("conv_id").alias("conversation_id")).agg(
        F.coalesce(F.min_by(X.conversation_title(F.col("text")), asked), F.lit(R.DEFAULT_TITLE)).alias("title"),
        F.min("turn").alias("created_at"),
        F.max("turn").alias("updated_at"),
    )
    return conversations, messages


def list_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("conversation_id").agg(F.count("message_id").alias("n"))
    return (
        conversations.join(counts, "conversation_id", "left")
        .select(*conversations.columns, F.coalesce("n", F.lit(0)).cast("long").alias("message_count"))
        .orderBy(F.desc("updated_at"), "conversation_id")
    )


def conversation_messages(messages: DataFrame, conversation_id=None) -> DataFrame:
    rows = messages if conversation_id is None else messages.where(F.col("conversation_id") == conversation_id)
    return rows.orderBy("conversation_id", "created_at", "message_id")


def delete(conversations: DataFrame, messages: DataFrame, conversation_id) -> tuple[DataFrame, DataFrame]:
    keep = F.col("conversation_id") != F.lit(conversation_id)
    return conversations.where(keep), messages.where(keep)
