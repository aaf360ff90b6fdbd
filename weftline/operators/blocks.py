"""Conversations as ordered messages: turn blocks, replies, transcripts.

Messages have conversation_id, ordinal, role and content. Windows partition by conversation, so one shuffle on
conversation_id serves every operator here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from weftline.functions.text import transcript

def _in_order() -> WindowSpec:
    return W.partitionBy("conversation_id").orderBy("ordinal")


def with_blocks(messages: DataFrame, first_only: bool = False) -> DataFrame:
    """Adds block: a user message opens the next; system messages and what precedes the first user are dropped."""
    talk = messages.where("role <> 'system'")
    talk = talk.withColumn("block", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(_in_order())).where("block >= 1")
    return talk.where("block = 1") if first_only else talk


def closing_replies(messages: DataFrame, last: bool = True) -> DataFrame:
    """Rows (conversation_id, reply): the last (or first) assistant message of each conversation that has one."""
    pick = F.max_by if last else F.min_by
    assistant = F.col("role") == "assistant"
    return messages.where(assistant).groupBy("conversation_id").agg(pick("content", "ordinal").alias("reply"))


def openings(messages: DataFrame) -> DataFrame:
    """Rows (conversation_id, system_text, user_text): the first message of either role, null where there is none."""
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.col("ordinal")))
    return messages.groupBy("conversation_id").agg(first("system").alias("system_text"), first("user").alias("user_text"))


def numbered_replies(messages: DataFrame) -> DataFrame:
    """Assistant messages by block: the first is turn.assistant, later ones turn.followup."""
    place = F.row_number().over(W.partitionBy("conversation_id", "block").orderBy("ordinal"))
    replies = with_blocks(messages).where("role = 'assistant'").withColumn("place", place)
    return replies.withColumn("event", F.when(F.col("place") == 1, "turn.assistant").otherwise("turn.followup"))


def transcripts(messages: DataFrame, last: int | None = None) -> DataFrame:
    """Rows (conversation_id, transcript), of all messages or of the last few."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "role", "content")))
    if last is not None:
        ordered = F.slice(ordered, F.greatest(F.lit(1), F.size(ordered) - last + 1), F.lit(last))
    return messages.groupBy("conversation_id").agg(transcript(ordered).alias("transcript"))


def prefix_sizes(messages: DataFrame) -> DataFrame:
    """For each block: messages and characters of the conversation up to its end; what a judge of that turn reads."""
    blocks = with_blocks(messages).groupBy("conversation_id", "block").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"))
    running = W.partitionBy("conversation_id").orderBy("block")
    return blocks.select("conversation_id", "block", F.sum("n").over(running).alias("messages_so_far"), F.sum("chars").over(running).alias("chars_so_far"))


def trim_to_reply(messages: DataFrame, roles: tuple[str, ...] = ("system", "user", "assistant")) -> DataFrame:
    """Messages of the listed roles up to the last assistant message; conversations without one disappear."""
    last = F.max(F.when(F.col("role") == "assistant", F.col("ordinal"))).over(W.partitionBy("conversation_id"))
    return messages.where(F.col("role").isin(*roles)).withColumn("last_reply", last).where("ordinal <= last_reply").drop("last_reply")


def budgeted(snippets: DataFrame, limit: int = 40_000, each: int = 4_000, separator: int = 7) -> DataFrame:
    """Per group, snippets in order while their running length fits; the first always stays, all after an overflow go.

    Snippets have group, place and text. Rows (group, kept, omitted, text).
    """
    cut = snippets.withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, each))
    order = W.partitionBy("group").orderBy("place")
    cut = cut.withColumn("total", F.sum(F.length("text") + separator).over(order) - separator).withColumn("first", F.row_number().over(order) == 1)
    fits = (F.col("total") <= limit) | F.col("first")
    kept = F.array_sort(F.collect_list(F.when(fits, F.struct("place", "text"))))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n\n---\n\n")
    return cut.groupBy("group").agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("omitted"), text.alias("text"))
