"""Column expressions on token arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_tokens() -> Column:
    return F.array().cast("array<int>")


def head(ids: Column, n: Column | int) -> Column:
    """The first ``n`` entries (all of them if there are fewer)."""
    return F.slice(ids, F.lit(1), F.greatest(F.lit(n), F.lit(0)).cast("int"))


def tail(ids: Column, n: Column | int) -> Column:
    """The last ``n`` entries (all of them if there are fewer)."""
    keep = F.greatest(F.lit(n), F.lit(0))
    start = F.greatest(F.size(ids) - keep, F.lit(0)) + 1
    return F.slice(ids, start.cast("int"), keep.cast("int"))


def truncate(ids: Column, n: Column | int | None, side: str) -> Column:
    """Cut to ``n`` entries: ``left`` keeps the end, ``right`` the start, ``none`` everything.

    A limit that is None or 0 does not cut, as in a tokenizer call without a maximum.
    """
    if side not in ("left", "right", "none"):
        raise ValueError(f"unknown truncation side {side!r}")
    if side == "none" or n is None or (isinstance(n, int) and n == 0):
        return ids
    return tail(ids, n) if side == "left" else head(ids, n)


def total_size(fields: Sequence[str]) -> Column:
    """Tokens of a record over all its fields."""
    return reduce(lambda a, b: a + b, [F.size(F.col(f)) for f in fields])


def fill_like(ids: Column, value: int) -> Column:
    """An array as long as ``ids``, of one value."""
    return F.array_repeat(F.lit(value).cast("int"), F.size(ids))


def pad(ids: Column, width: Column, value: Column, side: str) -> Column:
    """``ids`` filled up with ``value`` to ``width`` entries on one side."""
    if side not in ("left", "right"):
        raise ValueError(f"unknown padding side {side!r}")
    filler = F.array_repeat(value, F.greatest(width - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(filler, ids) if side == "left" else F.concat(ids, filler)
