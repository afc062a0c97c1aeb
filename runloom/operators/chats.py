"""Chats: one row per turn, or nested arrays of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Speaker names of the nested "from/value" form.
SPEAKERS = {"user": "human", "assistant": "gpt", "system": "system"}


def _first_text(role: str) -> Column:
    wanted = (F.col("role") == role) & (F.col("text") != "")
    first = F.min_by(F.when(wanted, F.col("text")), F.when(wanted, F.col("turn")))
    return F.coalesce(first, F.lit(""))


def flatten_first_turns(
    turns: DataFrame,
    key: str = "conv_id",
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """First non-empty text per role and chat, empty if there is none.

    ``columns`` names the result column of each role. The aggregate keeps one
    text per role before the shuffle, so a chat of any length stays small.
    """
    columns = columns or {"user": "instruction", "assistant": "response"}
    return turns.groupBy(key).agg(*[_first_text(r).alias(name) for r, name in columns.items()])


def flatten_messages(
    chats: DataFrame,
    messages: str = "messages",
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """The same for a nested ``ARRAY<STRUCT<role, content>>`` column, row by row."""
    columns = columns or {"user": "instruction", "assistant": "response"}

    def first(role: str) -> Column:
        spoken = F.filter(messages, lambda m: (m["role"] == role) & (m["content"] != ""))
        return F.coalesce(F.get(spoken, F.lit(0))["content"], F.lit(""))

    return chats.withColumns({name: first(role) for role, name in columns.items()}).drop(messages)


def filter_complete_pairs(
    pairs: DataFrame, instruction: str = "instruction", response: str = "response"
) -> DataFrame:
    """Drop chats that lack either side."""
    return pairs.filter((F.col(instruction) != "") & (F.col(response) != ""))


def group_chat(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turn rows to the nested "from/value" array, one row per chat whatever its turn numbers."""
    speaker = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    entry = F.struct(
        "turn",
        F.coalesce(speaker[F.col("role")], F.col("role")).alias("from"),
        F.col("text").alias("value"),
    )
    return (
        turns.groupBy(key)
        .agg(F.array_sort(F.collect_list(entry)).alias("_turns"))
        .select(
            key,
            F.transform(
                "_turns", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))
            ).alias("conversations"),
        )
    )
