"""Capacity probing: batches of many shapes around a token count, to find what a device holds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.operators.ordinal import with_ordinal

# The unit probe lengths are powers of two of, and the range of filler ids.
LENGTH_UNIT = 20
FILLER_IDS = 100


def probe_lengths(min_len: int = 20, max_len: int = 5120) -> list[int]:
    """Probe lengths, ``20 * 2^i`` for i from ⌊log2 min⌋ to ⌊log2 max⌋."""
    if not 1 <= min_len <= max_len:
        raise ValueError("probe lengths need 1 <= min_len <= max_len")
    low, high = math.floor(math.log2(min_len)), math.floor(math.log2(max_len))
    return [LENGTH_UNIT * 2**i for i in range(low, high + 1)]


def probe_grid(
    ranges: DataFrame, step: int = 1000, min_len: int = 20, max_len: int = 5120
) -> DataFrame:
    """Probe batches for every row of ``ranges(start, end)``.

    For each token count from ``start`` below ``end`` and each probe length, a batch has one record
    more than go into the count; it is kept if its tokens lie between ``start`` and ``end``. The
    result is (other columns, target, seq_len, n_records, param_count).
    """
    if step < 1:
        raise ValueError("step must be at least 1")
    others = [c for c in ranges.columns if c not in ("start", "end")]
    lengths = F.array(*[F.lit(n).cast("bigint") for n in probe_lengths(min_len, max_len)])
    counts = F.sequence(
        F.col("start").cast("bigint"), F.col("end").cast("bigint") - 1, F.lit(step).cast("bigint")
    )
    grid = (
        ranges.where(F.col("end") > F.col("start"))
        .select(*others, "start", "end", F.explode(counts).alias("target"))
        .select("*", F.explode(lengths).alias("seq_len"))
        .withColumn("n_records", F.expr("target div seq_len + 1"))
        .withColumn("param_count", F.col("n_records") * F.col("seq_len"))
    )
    kept = grid.where(F.col("param_count").between(F.col("start"), F.col("end")))
    return kept.select(*others, "target", "seq_len", "n_records", "param_count")


def order_probes(grid: DataFrame) -> DataFrame:
    """``plan_pos`` by token count; ties by target, then by length, as they are made."""
    packed = F.col("target") * F.lit(1 << 26) + F.col("seq_len")
    fits = (F.col("seq_len") < (1 << 26)) & (F.col("target") < (1 << 37))
    beyond = F.raise_error(F.lit("probes take lengths below 2^26 and targets below 2^37")).cast("bigint")
    made = grid.withColumn("__seq", F.when(fits, packed).otherwise(beyond))
    out = with_ordinal(
        made,
        key="param_count",
        seq="__seq",
        carry=["target", "seq_len", "n_records"],
        out="plan_pos",
    )
    return out.select("plan_pos", "target", "seq_len", "n_records", "param_count")


def probe_rows(grid: DataFrame, seed: int = 0) -> DataFrame:
    """The records of the probe batches, filled with seeded ids below 100."""
    rows = grid.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_records") - 1)))
    ids = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("seq_len") - 1),
        lambda i: F.pmod(
            F.xxhash64(F.lit(seed), F.col("target"), F.col("seq_len"), F.col("pos"), i), F.lit(FILLER_IDS)
        ).cast("int"),
    )
    return rows.withColumn("profile_content", ids)


def probe_summary(grid: DataFrame) -> DataFrame:
    """The grid with ``summary``: ``param_count: records * length`` of each batch."""
    return grid.withColumn(
        "summary", F.format_string("%6d: %4d * %4d", "param_count", "n_records", "seq_len")
    )
