"""Numbers about tokenized sets and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.arrays import head, tail
from batchloom.operators.collate import chunked
from batchloom.operators.lengths import record_length, token_fields
from batchloom.plans.policies import BatchPlan


def token_total(tokens: DataFrame, length: Column | None = None) -> DataFrame:
    """One row: tokens over all fields, also in thousands, millions and billions (2 decimals)."""
    total = F.sum(record_length(tokens) if length is None else length).cast("bigint")
    out = tokens.agg(F.coalesce(total, F.lit(0).cast("bigint")).alias("total_tokens"))
    units = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
    return out.withColumns(
        {name: F.round(F.col("total_tokens") / F.lit(size), 2) for name, size in units.items()}
    )


def dataset_profile(lengths: DataFrame, dataset: str) -> DataFrame:
    """Per dataset: tokens, records and the longest record."""
    return lengths.groupBy(dataset).agg(
        F.sum("len").cast("bigint").alias("token_count"),
        F.count(F.lit(1)).alias("record_count"),
        F.max("len").cast("bigint").alias("max_token_length"),
    )


def plan_stats(batches: DataFrame) -> DataFrame:
    return batches.agg(F.count(F.lit(1)).alias("plan_item_count"))


def capacity_stats(batches: DataFrame) -> DataFrame:
    """Batches, and the largest padded size, record count and record length among them."""
    zero = F.lit(0).cast("bigint")
    return batches.agg(
        F.count(F.lit(1)).alias("plan_item_count"),
        F.coalesce(F.max("padded_tokens").cast("bigint"), zero).alias("max_padded_tokens"),
        F.coalesce(F.max("n_records"), zero).alias("max_records"),
        F.coalesce(F.max("max_len").cast("bigint"), zero).alias("max_record_length"),
    )


def difference_stats(batches: DataFrame) -> DataFrame:
    """Batches, and the largest and smallest length difference inside one (null without batches)."""
    difference = F.col("max_len") - F.col("min_len")
    return batches.agg(
        F.count(F.lit(1)).alias("plan_item_count"),
        F.max(difference).cast("bigint").alias("max_length_difference"),
        F.min(difference).cast("bigint").alias("min_length_difference"),
    )


def batch_measures(batches: DataFrame) -> DataFrame:
    """Per batch: records, records times longest, length difference."""
    return batches.select(
        "batch_id",
        "n_records",
        (F.col("n_records") * F.col("max_len")).alias("padded_tokens"),
        (F.col("max_len") - F.col("min_len")).cast("bigint").alias("length_difference"),
    )


def padding_summary(plans: dict[str, BatchPlan], pad_to: int | None = None) -> DataFrame:
    """Per plan: batches, real tokens, padded tokens and the wasted share.

    ``pad_to`` pads every row to that length instead of the longest row of its batch.
    """
    parts = []
    for name, plan in plans.items():
        padded = F.col("padded_tokens") if pad_to is None else F.col("n_records") * F.lit(pad_to)
        parts.append(
            plan.batches.agg(
                F.count(F.lit(1)).alias("batches"),
                F.sum("tokens").cast("bigint").alias("real_tokens"),
                F.sum(padded).cast("bigint").alias("padded_tokens"),
            ).select(F.lit(name).alias("plan"), "*")
        )
    report = reduce(DataFrame.unionByName, parts)
    return report.withColumn(
        "waste_ratio", F.round(1 - F.try_divide("real_tokens", "padded_tokens"), 6)
    )


def preview(tokens: DataFrame, plan: BatchPlan, edge: int = 5) -> DataFrame:
    """Per record and field: place in the plan (``plan_pos``, ``pos``), size, first and last ``edge`` ids."""
    fields = token_fields(tokens)
    ids = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("ids")) for f in fields])
    )
    positions = plan.batches.select("batch_id", "plan_pos")
    placed = plan.assignment.select("seq_id", "chunk", "batch_id", "pos").join(positions, "batch_id")
    tokens, on = chunked(tokens, plan)
    edges = tokens.select(*on, ids.alias("__f")).where(F.col("__f.ids").isNotNull())
    shown = edges.select(
        *on,
        F.col("__f.field").alias("field"),
        F.size("__f.ids").alias("size"),
        head(F.col("__f.ids"), edge).alias("first_ids"),
        tail(F.col("__f.ids"), edge).alias("last_ids"),
    )
    return shown.join(placed, on).select(
        "plan_pos", "batch_id", "pos", "field", "seq_id", "chunk", "size", "first_ids", "last_ids"
    )


def plan_item(plan: BatchPlan, position: int) -> DataFrame:
    """The rows of the batch at ``position`` of the plan; negative ones count from the end."""
    return plan.item(position)
