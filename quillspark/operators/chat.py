"""Chat records: arrays of messages, their conversion and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_TOKENS, MAX_TOKENS = 10, 500


def collect_messages(df: DataFrame, key: str = "conv_id", order: str = "turn", *extra: str) -> DataFrame:
    """One row a conversation with its ordered messages (turn, role, content)."""
    fields = F.struct(F.col(order).alias("turn"), "role", F.col("text").alias("content"), *extra)
    return df.groupBy(key).agg(F.sort_array(F.collect_list(fields)).alias("messages"))


def visible(messages: str = "messages", roles: tuple = ("user", "assistant")) -> Column:
    """Messages of the roles that have content (PRJ08, PRJ09)."""
    return F.filter(messages, lambda m: m.role.isin(*roles) & (F.coalesce(m.content, F.lit("")) != ""))


def length_ok(messages: str = "messages", low: int = MIN_TOKENS, high: int = MAX_TOKENS) -> Column:
    """Every visible response within the bounds, and at least one (FLT02)."""
    replies = visible(messages, ("assistant",))
    return (F.size(replies) > 0) & F.forall(replies, lambda m: T.token_estimate(m.content).between(low, high))


def with_system(messages: str, prompt: Column) -> Column:
    """The system prompt, then the messages (PRJ05)."""
    head = F.struct(F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), prompt.alias("content"))
    return F.concat(F.array(head), F.transform(messages, lambda m: F.struct(m.turn.alias("turn"), m.role.alias("role"), m.content.alias("content"))))


def preamble(summary: Column, memory: Column) -> Column:
    """The context block, without its empty parts (PRJ11)."""
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{title}]\n"), c))
    return F.concat_ws("\n\n", part("User", summary), part("Memory", memory))


def prepend_context(messages: str, context: Column) -> Column:
    """Context before the content of the first user message alone (PRJ10)."""
    at = F.array_position(F.transform(messages, lambda m: m.role), "user") - 1
    return F.transform(
        messages,
        lambda m, i: F.struct(
            m.turn.alias("turn"), m.role.alias("role"),
            F.when((i == at) & (context != ""), F.concat(context, F.lit("\n\n"), m.content)).otherwise(m.content).alias("content"),
        ),
    )


def render(messages: Column, limit: int = 200) -> Column:
    """Messages as text for a judge; tool results are cut (PRJ12, PRJ13)."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), m.role, F.lit("] "), F.when(m.role == "tool", T.truncate(m.content, limit)).otherwise(m.content))), "\n")


def converted(messages: str) -> Column:
    """Training form: thinking becomes reasoning_content if not empty, tool rows lose their name (PRJ06)."""
    return F.transform(
        messages,
        lambda m: F.struct(
            m.role.alias("role"), m.content.alias("content"),
            F.when((m.role == "assistant") & (m.thinking != ""), m.thinking).alias("reasoning_content"),
            F.when(m.role != "tool", m["name"]).alias("name"),
        ),
    )


def chat_template(messages: Column) -> Column:
    """ChatML text of the messages (UDF12)."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m.role, F.lit("\n"), m.content, F.lit("<|im_end|>"))), "\n")


def overall_pass(character: Column, thinking: Column, language_ok: Column, tool: Column, length: Column) -> Column:
    """The quality filter: scores of 3 and up, consistent language, no tool failure, length (FLT03); missing keys fail."""
    return (
        (F.coalesce(character, F.lit(0.0)) >= 3) & (F.coalesce(thinking, F.lit(0.0)) >= 3) & F.coalesce(language_ok, F.lit(False))
        & (F.when(tool.isin("pass", "fail"), tool).otherwise(F.lit("na")) != "fail") & F.coalesce(length, F.lit(False))
    )
