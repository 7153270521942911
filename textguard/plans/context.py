"""The context that goes to the language model with each user turn.

A context is the conversation's stored messages in order of time (masked text where there is one, role in lower case), then
the current masked turn. Written out per turn it would grow with the square of a conversation, so it is stored once: the
entries of a conversation with their positions, and for every user turn the length of its history. ``expand_contexts``
writes out the contexts of the turns it is given.

Defined results: turns are ordered by number, unique within a conversation; a null content is an entry with a null content;
an empty table has no entries; a conversation of assistant messages only has entries and no turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.ordered import DEFAULT_BLOCK, blocked_running_sum


def context_entries(messages: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """(conversation_id, position, turn, role, content): every stored message once, positions from 1."""
    masked = F.col("masked_content")
    m = messages.select("conversation_id", "turn", F.lower("role").alias("role"),
                        F.coalesce(F.when(masked != "", masked), F.col("content")).alias("content"), F.lit(1).alias("_one"))
    m = blocked_running_sum(m, "conversation_id", "turn", "_one", "position", block)
    return m.select("conversation_id", F.col("position").cast("bigint").alias("position"), "turn", "role", "content")


def context_lengths(entries: DataFrame, duplicate_current: bool = False) -> DataFrame:
    """(conversation_id, turn, history): for every user turn how many entries stand before the appended current one.

    The current turn is stored before the history is read; ``duplicate_current`` keeps it there, so that it comes twice."""
    own = 0 if duplicate_current else 1
    return entries.where(F.col("role") == "user").select("conversation_id", "turn", (F.col("position") - own).alias("history"))


def expand_contexts(entries: DataFrame, lengths: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """(conversation_id, turn, position, role, content): the whole contexts of the turns in ``lengths``. History is joined in blocks
    of positions, so a long conversation's entries meet their turn in many tasks."""
    blocked = entries.select("conversation_id", "position", "role", "content", F.floor((F.col("position") - 1) / block).alias("_blk"))
    wanted = lengths.where(F.col("history") > 0).select(
        "conversation_id", "turn", "history", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("history") - 1) / block))).alias("_blk"))
    history = (blocked.join(wanted, ["conversation_id", "_blk"]).where(F.col("position") <= F.col("history"))
               .select("conversation_id", "turn", "position", "role", "content"))
    current = entries.drop("position").join(lengths, ["conversation_id", "turn"]).select(
        "conversation_id", "turn", (F.col("history") + 1).alias("position"), F.lit("user").alias("role"), "content")
    return history.unionByName(current)
