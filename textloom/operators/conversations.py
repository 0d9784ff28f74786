"""Conversations: a store of messages ``conv_id, turn, role, text, ts``, its titles, and what is deleted from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import fixed
from textloom.sources.files import load_rows, save_rows

MESSAGES = "conv_id bigint, turn bigint, role string, text string, ts timestamp"


def add_messages(messages: DataFrame, path: str) -> None:
    """Messages appended to the store; a conversation is there from its first message on."""
    save_rows(messages.select("conv_id", "turn", "role", "text", F.col("ts").cast("timestamp").alias("ts")), path)


def load_messages(spark: SparkSession, path: str) -> DataFrame:
    return load_rows(spark, path, MESSAGES)


def conversations(messages: DataFrame) -> DataFrame:
    """``conv_id, title, created_at, updated_at, n_messages``; the title is the beginning of the first user message."""
    asked = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    said = F.coalesce(F.when(F.count_if(F.col("role") == "user") > 0, F.coalesce(asked, F.lit(""))), F.lit(fixed.NEW_TITLE))
    short = F.substring(said, 1, fixed.TITLE_CHARS)
    title = F.when(F.length(said) > fixed.TITLE_CHARS, F.concat(short, F.lit("…"))).otherwise(said)
    return messages.groupBy("conv_id").agg(title.alias("title"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("n_messages"))


def recent(messages: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` conversations updated last, the latest first."""
    return conversations(messages).orderBy(F.desc("updated_at"), "conv_id").limit(k)


def messages_of(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("conv_id"), "conv_id", "left_semi")


def without(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left after the conversations of ``ids`` are deleted."""
    return messages.join(ids.select("conv_id"), "conv_id", "left_anti")
