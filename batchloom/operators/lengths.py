"""Lengths of tokenized records, the only thing planning reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.operators.ordinal import ID_BITS, with_ordinal


def field_length(df: DataFrame, field: str) -> Column:
    """Tokens of one field, from its stored length column if the table has one."""
    stored = f"{field}_len"
    return F.col(stored) if stored in df.columns else F.size(F.col(field))


def token_fields(tokens: DataFrame) -> list[str]:
    """The columns of a tokenized table that hold ids."""
    return [name for name, kind in tokens.dtypes if kind.startswith("array<")]


def record_length(df: DataFrame, fields: Sequence[str] | None = None) -> Column:
    """Tokens of a record over ``fields`` (default: all of them)."""
    if fields is None and "total_len" in df.columns:
        return F.col("total_len")
    total = F.lit(0)
    for field in fields or token_fields(df):
        total = total + field_length(df, field)
    return total


def lengths_of(
    tokens: DataFrame,
    key: str | None = None,
    fields: Sequence[str] | None = None,
    function: Column | None = None,
) -> DataFrame:
    """(seq_id, len, row_len) for the planners.

    ``len`` is what the plan is made by: the whole record, the field ``key``, or any integer
    ``function`` of the record. Only length columns are read where the table stores them.
    """
    row = record_length(tokens, fields)
    if function is not None:
        planned = function
    else:
        planned = field_length(tokens, key) if key else row
    if key is None and function is None:
        return tokens.select("seq_id", row.cast("int").alias("len"))
    return tokens.select(
        "seq_id", planned.cast("int").alias("len"), row.cast("int").alias("row_len")
    )


def sort_by_length(lengths: DataFrame, id_bits: int = ID_BITS) -> DataFrame:
    """(seq_id, len, rank): stable ascending order of length, as 0-based positions."""
    return with_ordinal(lengths.select("seq_id", "len"), key="len", seq="seq_id", out="rank", id_bits=id_bits)
