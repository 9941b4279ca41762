"""Chat history: turns, the last of them, and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def turns_of(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, user, assistant): each user message with the answer that follows it at once, or ''."""
    w = Window.partitionBy(conv).orderBy(turn)
    rows = messages.where(F.col("role").isin("user", "assistant")).withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    answer = F.when(F.col("next_role") == "assistant", F.coalesce("next_text", F.lit(""))).otherwise("")
    return rows.where("role = 'user'").select(conv, turn, strip(F.coalesce("text", F.lit(""))).alias("user"), strip(answer).alias("assistant"))


def last_turns(turns: DataFrame, limit: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``limit`` turns of each conversation; none for a limit of 0 or less."""
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(0, limit)).drop("_n")


def messages_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, seq, role, content): both sides of each turn in order, blank ones left out."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.lit("human").alias("role"), F.col("user").alias("content")), F.struct(F.lit(1).alias("side"), F.lit("ai").alias("role"), F.col("assistant").alias("content")))
    rows = turns.select(conv, turn, F.inline(sides)).where("content <> ''")
    return rows.select(conv, F.row_number().over(Window.partitionBy(conv).orderBy(turn, "side")).cast("long").alias("seq"), "role", "content")


def turn_count(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    return messages.groupBy(conv).agg(F.floor(F.count("*") / 2).cast("long").alias("n_turns"))
