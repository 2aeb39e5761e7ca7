"""Record preparation: raw corpora to ``prompt`` / ``chosen`` pairs, and projection to fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.text import required, templated

# Turns of a conversation in a range of pairs that one task builds.
SPREAD_TURNS = 512


def nest_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, messages): the turns of each conversation in the order of ``turn``.

    ``messages`` is ``array<struct<role, content>>``, the shape conversation corpora are stored in.
    A conversation is one row by definition: its last prompt repeats all of it. Turns without a
    conversation are an error, as they would all be one.
    """
    turns = turns.withColumn(conv, required(F.col(conv), conv))
    entry = F.struct(F.col(turn), F.col(role).alias("role"), F.col(text).alias("content"))
    ordered = F.array_sort(F.collect_list(entry))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return turns.groupBy(conv).agg(messages.alias("messages"))


def conversation_pairs(
    conversations: DataFrame, messages: str = "messages", spread_turns: int = SPREAD_TURNS
) -> DataFrame:
    """One pair per answer: (other columns, turn, prompt, chosen).

    Turns 1, 3, 5, … by position are the answers, whatever their role, and all turns before one
    are its prompt. Conversations of fewer than two turns give nothing.

    The prompts of a conversation grow with the square of its length. Conversations of more than
    ``spread_turns`` turns are therefore cut into ranges of pairs, which are dealt out evenly before any
    text is joined. All others, equal or not, are worked on where they are read.
    """
    others = [c for c in conversations.columns if c != messages]
    turns = F.transform(
        messages, lambda m: templated(required(m["role"], "role"), required(m["content"], "content"))
    )
    step = spread_turns + spread_turns % 2
    size = F.size(messages)
    short = conversations.where((size >= 2) & (size <= step + 1))
    short = short.select(*others, F.lit(1).alias("__from"), turns.alias("__turns"))
    # A fixed number of partitions: a range can be small and its work not, and adaptive execution would
    # put ranges together again by size.
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = F.explode(F.sequence(F.lit(1), size - 1, F.lit(step)))
    long = (
        conversations.where(size > step + 1)
        .select(*others, turns.alias("__all"), starts.alias("__from"))
        .select(*others, "__from", F.slice("__all", F.lit(1), F.col("__from") + step).alias("__turns"))
        .repartition(partitions)
    )
    ranges = short.unionAll(long)
    numbers = F.explode(F.sequence(F.col("__from"), F.size("__turns") - 1, F.lit(2)))
    return ranges.select(*others, "__turns", numbers.alias("turn")).select(
        *others,
        "turn",
        F.array_join(F.slice("__turns", F.lit(1), F.col("turn")), "").alias("prompt"),
        F.element_at("__turns", F.col("turn") + 1).alias("chosen"),
    )


def _pair(df: DataFrame, prompt: Column, chosen: Column, keep: Sequence[str]) -> DataFrame:
    return df.select(
        *keep, templated("user", prompt).alias("prompt"), templated("assistant", chosen).alias("chosen")
    )


def reasoning_pairs(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(source, rationale, target): the answer is the rationale directly followed by the target."""
    answer = F.concat(required(F.col("rationale"), "rationale"), required(F.col("target"), "target"))
    return _pair(df, required(F.col("source"), "source"), answer, keep)


def question_pairs(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(question, answer)."""
    return _pair(
        df, required(F.col("question"), "question"), required(F.col("answer"), "answer"), keep
    )


def instruction_pairs(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(instruction, context, response): the prompt is the instruction directly followed by context."""
    prompt = F.concat(
        required(F.col("instruction"), "instruction"), required(F.col("context"), "context")
    )
    return _pair(df, prompt, required(F.col("response"), "response"), keep)


def project_fields(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ("seq_id",)) -> DataFrame:
    """The fields of a spec in their order; extra columns go, a missing value aborts the job."""
    absent = [f for f in fields if f not in df.columns]
    if absent:
        raise ValueError(f"fields {absent} are not in the data: {df.columns}")
    return df.select(*keep, *(required(F.col(f), f).alias(f) for f in fields))
