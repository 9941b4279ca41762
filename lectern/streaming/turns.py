"""Turns of conversations from a stream of messages that come in any order.

Each conversation has a keyed state: the messages that cannot be paired yet. The
watermark says up to which event time no message can come any more. Up to there messages are
in their final order, and a user's message is a turn as soon as the one after it is final too; the last
one of a conversation is a turn without an answer when nothing has come for ``gap``. What is emitted leaves the state, so
it holds the open end of a conversation only. Messages that come behind the watermark are dropped by Spark and
counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import strip

STATE = "at array<bigint>, turn array<bigint>, role array<string>, text array<string>"


def settled(messages: list[tuple], watermark: int, gap: int) -> tuple[list[tuple], list[tuple], int | None]:
    """Turns (turn, user, assistant) that are final, the messages (time, turn, role, text) to be kept, and the time at which more can be said."""
    messages = sorted(messages, key=lambda m: m[:2])
    final = sum(m[0] <= watermark for m in messages)
    turns, i = [], 0
    while i < final:
        at, turn, role, text = messages[i]
        if role == "user":
            if i + 1 < final:
                after = messages[i + 1]
                turns.append((turn, text, after[3] if after[2] == "assistant" else ""))
            elif i + 1 == len(messages) and at + gap <= watermark:
                turns.append((turn, text, ""))
            else:
                break
        i += 1
    left = messages[i:]
    if not left:
        return turns, left, None
    return turns, left, left[final - i][0] if len(left) > final - i else left[0][0] + gap


def turn_stream(messages: DataFrame, delay: str = "10 minutes", gap_seconds: int = 1800, conv: str = "conv_id", turn: str = "turn", at: str = "at") -> DataFrame:
    """(conv, turn, user, assistant) of a stream (conv, turn, role, text, at): the turns of ``history.turns_of``, each as soon as it is final.

    ``delay`` is how far messages may come out of order. Null texts are empty; messages of other roles, and those without a conversation or a time, are left out.
    """
    kinds = {c: messages.schema[c].dataType.simpleString() for c in (conv, turn)}
    gap = gap_seconds * 1000

    def pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            held += zip(frame["at"].astype("int64").tolist(), frame["turn"].tolist(), frame["role"].tolist(), frame["text"].tolist(), strict=True)
        watermark = state.getCurrentWatermarkMs()
        turns, left, wake = settled(held, watermark, gap)
        if left:
            state.update(tuple(list(c) for c in zip(*left, strict=True)))
            state.setTimeoutTimestamp(max(wake, watermark + 1))
        elif state.exists:
            state.remove()
        if turns:
            yield pd.DataFrame({"conv": [key[0]] * len(turns), "turn": [t[0] for t in turns], "user": [t[1] for t in turns], "assistant": [t[2] for t in turns]})

    rows = messages.where(F.col("role").isin("user", "assistant") & F.col(conv).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"), F.unix_millis(at).alias("at"), F.col(at).alias("_event"))
    found = rows.groupBy("conv").applyInPandasWithState(pair, f"conv {kinds[conv]}, turn long, user string, assistant string", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("conv").alias(conv), F.col("turn").cast(kinds[turn]).alias(turn), strip("user").alias("user"), strip("assistant").alias("assistant"))
