"""Exact positions in a global order, without sorting the data in one place.

A list index (``records[i]``) is the backbone of batch planning, and Spark has none. A window
without partitions would give it, but moves every record through one task. Here the position is a
sum of exclusive prefix sums over a fixed hierarchy of the order ``(key, seq)``::

    key                    records with a smaller key              (one row per distinct key)
    key, seq >> 54         earlier ranges of the same key          (at most 2^9 of them)
    key, seq >> 36         earlier super-blocks of the same range  (at most 2^18 of them)
    key, seq >> 18         earlier blocks of the same super-block  (at most 2^18 of them)
    key, seq               earlier records of the same block       (at most 2^18 of them)

Every window partition is bounded by the id arithmetic and not by the data, for any ids: a key that holds a
third of all records (typically the maximum length, after truncation) is spread over its blocks like any
other, whether its ids are counters or hashes. Ids that are known to be small need fewer levels (``id_bits``).
Only aggregates of blocks travel upwards, only their offsets travel back, and every join is
on a key that is unique on the aggregate side and bounded on the other.

A group of rows is named by its first id at every level, so that the level tables all have the
columns ``(key, first, n)`` and the two readers of a level (its prefix sums, the next level's totals)
ask for the same columns. Spark then plans one exchange per level and the input is read once. Carried
columns would break that, as only one reader needs them, so the totals keep a digest of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of an id that a level takes, and all bits that an id has.
BLOCK_BITS, ID_BITS = 18, 63


def _sum_before(value: str, *, partition: Sequence[str], order: Sequence[str]) -> str:
    by = f"PARTITION BY {', '.join(partition)}" if partition else ""
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"coalesce(sum({value}) OVER ({by} ORDER BY {', '.join(order)} {frame}), 0L)"


def never_null(column: str) -> str:
    """``column`` as BIGINT, or an error where it is null. Spark also learns that it cannot be null,
    and infers no filters that would tell two readers of one exchange apart."""
    return f"coalesce(cast({column} AS bigint), cast(raise_error('{column} is null') AS bigint), 0L)"


def with_ordinal(
    df: DataFrame,
    *,
    seq: str,
    key: str | None = None,
    weight: Column | None = None,
    carry: Sequence[str] = (),
    out: str = "ordinal",
    per_key: Callable[[DataFrame], DataFrame] | None = None,
    block_bits: int = BLOCK_BITS,
    id_bits: int = ID_BITS,
) -> DataFrame:
    """Add ``out``, the sum of ``weight`` over all rows before a row in the order ``(key, seq)``.

    With the default weight 1 this is the 0-based position. ``seq`` is a unique non-negative BIGINT;
    ``key`` an integer column, or None for the order of ``seq`` alone. ``carry`` names columns that
    are kept; everything else is dropped.

    ``per_key`` may extend the key table ``(key, n, base)`` (rows, first position) with columns
    that then arrive on every record; it needs a ``key``.

    ``id_bits`` says that all ids are below ``2^id_bits``; a larger one is an error. Counters of up to 36 bits
    take a single level.
    """
    keys = [key] if key else []
    levels = max(1, -(-id_bits // BLOCK_BITS) - 1)
    first = never_null(seq)
    if id_bits < ID_BITS:
        beyond = f"cast(raise_error('{seq} has more than {id_bits} bits') AS bigint)"
        first = f"if({first} < {1 << id_bits}L, {first}, coalesce({beyond}, 0L))"
    if weight is not None:
        df = df.withColumn("__weight", weight)
    records = df.selectExpr(
        *[f"{never_null(k)} AS {k}" for k in keys],
        f"{first} AS __first",
        *carry,
        f"{'1L' if weight is None else 'cast(__weight AS bigint)'} AS __n",
    )
    digest = f"xxhash64({', '.join(carry)})" if carry else "0L"
    widths = [block_bits * (i + 1) for i in range(levels)]
    level, before = _level(records, keys, widths[0], carry=carry, digest=digest)
    befores = [before]
    for bits in widths[1:]:
        level, before = _level(level, keys, bits)
        befores.append(before)

    kept: list[str] = []
    order = ["__first", "__digest"]
    if key:
        level, before = _level(level, keys, None)
        befores.append(before)
        table = level.selectExpr(
            key, "__n AS n", f"{_sum_before('__n', partition=[], order=[key, *order])} AS base"
        )
        if per_key:
            table = per_key(table)
            kept = [c for c in table.columns if c not in (key, "n", "base")]
        offsets = table.selectExpr(key, "base AS __base", *kept)
    else:
        # One row per group of the last level is left: 2^18 at most.
        group = f"shiftright(__first, {widths.pop()})"
        base = _sum_before("__n", partition=[], order=order)
        offsets = level.selectExpr(f"{group} AS __group", f"{base} AS __base")

    while befores:
        before = befores.pop()
        on = [c for c in offsets.columns if c in keys or c == "__group"]
        if befores:
            rest = [f"shiftright(__first, {widths.pop()}) AS __group"]
        else:
            rest = [f"__first AS {seq}", *carry]
        offsets = before.join(offsets, on).selectExpr(
            *keys, *rest, f"__base + __before AS {'__base' if befores else out}", *kept
        )
    return offsets


def _level(
    rows: DataFrame,
    keys: list[str],
    bits: int | None,
    carry: Sequence[str] = (),
    digest: str = "__digest",
) -> tuple[DataFrame, DataFrame]:
    """(totals per group, rows with the sum before each inside its group) of one level.

    Groups are ``first >> bits``, or the whole key where ``bits`` is None.
    """
    by = list(keys)
    if bits is not None:
        rows = rows.selectExpr("*", f"shiftright(__first, {bits}) AS __group")
        by.append("__group")
    spread = rows.repartition(*by)
    totals = spread.groupBy(*by).agg(
        F.expr("coalesce(min(__first), 0L) AS __first"),
        F.expr(f"max({digest}) AS __digest"),
        F.expr("sum(__n) AS __n"),
    )
    order = ["__first"] if carry or "__digest" not in rows.columns else ["__first", "__digest"]
    before = spread.selectExpr(
        *by, "__first", *carry, f"{_sum_before('__n', partition=by, order=order)} AS __before"
    )
    return totals.drop("__group"), before


def random_ordinal(
    df: DataFrame, *, seq: str, seed: int, carry: Sequence[str] = (), out: str = "ordinal"
) -> DataFrame:
    """Add ``out``, the 0-based position in a seeded pseudo-random order.

    The order is that of the text ``md5(seed:seq)``, which any engine can reproduce. The first 16
    bits are the buckets, so buckets are even whatever the ids look like, and one pass of bucket
    totals gives the offsets.
    """
    hashed = df.selectExpr(f"{never_null(seq)} AS {seq}", *carry).selectExpr(
        "*", f"coalesce(md5(concat('{int(seed)}:', {seq})), '') AS __hash"
    )
    rows = hashed.selectExpr("*", "substring(__hash, 1, 4) AS __bucket").repartition("__bucket")
    sizes = rows.groupBy("__bucket").agg(
        F.expr("count(1) AS __n"),
        F.expr(f"max(xxhash64({', '.join([seq, '__hash', *carry])})) AS __digest"),
    )
    offset = _sum_before("__n", partition=[], order=["__bucket", "__digest"])
    offsets = sizes.selectExpr("__bucket", f"{offset} AS __off")
    inner = f"row_number() OVER (PARTITION BY __bucket ORDER BY __hash, {seq}) - 1"
    ranked = rows.selectExpr("*", f"{inner} AS __in")
    return ranked.join(offsets, "__bucket").selectExpr(
        seq, *carry, f"cast(__off + __in AS bigint) AS {out}"
    )
