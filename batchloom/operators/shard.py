"""Placing planned batches on training ranks and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.operators.collate import join_batches
from batchloom.plans.policies import BatchPlan, order_batches
from batchloom.spec import PRETRAIN_FIELDS, SFT_FIELDS, DatasetSpec

# Task names of job configurations.
TASKS = ("sft", "pt")


def task_fields(task: str, spec: DatasetSpec | None = None) -> tuple[list[str], list[str]]:
    """(fields to collate, fields without loss): from a spec if there is one, else by task."""
    if spec is not None:
        return list(spec.field_names), list(spec.loss_masked_field_names)
    if task == "sft":
        return list(SFT_FIELDS), [SFT_FIELDS[0]]
    if task == "pt":
        return list(PRETRAIN_FIELDS), []
    raise ValueError(f"unknown task {task!r}, use one of {TASKS}")


def accumulation_steps(global_batch: int, batch_per_device: int, world_size: int) -> int:
    """Micro-steps per optimizer step. The global batch must divide exactly."""
    per_step = batch_per_device * world_size
    if min(global_batch, batch_per_device, world_size) < 1 or global_batch % per_step:
        raise ValueError(f"global batch {global_batch} is not a multiple of {per_step}")
    return global_batch // per_step


def shard_batches(
    batches: DataFrame, world_size: int, accumulation: int = 1, shuffle: bool = False, seed: int = 0
) -> DataFrame:
    """The batch table with (rank, micro_step, optimizer_step), one row per delivery.

    Positions are dealt to the ranks in turn. If they do not come out even, the first batches are
    delivered again until every rank has as many as the others. ``shuffle`` deals in a seeded order
    that is the same for every epoch.
    """
    if world_size < 1 or accumulation < 1:
        raise ValueError("world_size and accumulation must be at least 1")
    if shuffle:
        batches = order_batches(batches, "random", seed)
    # The number of batches is one number, read by a scalar subquery and not joined.
    count = batches.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = batches.withColumn("__n", count)
    total = F.expr(f"(__n + {world_size - 1}) div {world_size} * {world_size}")
    dealt = counted.withColumn(
        "__at", F.explode(F.sequence(F.col("plan_pos"), total - 1, F.col("__n")))
    )
    return dealt.select(
        *batches.columns,
        (F.col("__at") % world_size).cast("int").alias("rank"),
        F.expr(f"__at div {world_size}").alias("micro_step"),
        F.expr(f"__at div {world_size} div {accumulation}").alias("optimizer_step"),
    )


def step_layout(
    batches: DataFrame, world_size: int, accumulation: int = 1, epochs: int = 1
) -> DataFrame:
    """One row: batches, batches per rank, optimizer steps per epoch and in all."""
    counted = batches.agg(F.count(F.lit(1)).alias("n_batches"))
    per_rank = F.expr(f"(n_batches + {world_size - 1}) div {world_size}")
    steps = F.expr(f"(n_per_rank + {accumulation - 1}) div {accumulation}")
    return (
        counted.withColumn("n_per_rank", per_rank)
        .withColumn("steps_per_epoch", steps)
        .withColumn("total_steps", F.col("steps_per_epoch") * epochs)
    )


def with_loss_weight(batches: DataFrame, batch_per_device: int) -> DataFrame:
    """``loss_weight``: the real batch size in units of the configured one."""
    return batches.withColumn("loss_weight", F.col("n_records") / F.lit(batch_per_device))


def place_rows(plan: BatchPlan, shards: DataFrame) -> DataFrame:
    """The assignment with pad widths, ranks and steps, to collate rows where they are delivered.

    A batch that is delivered twice is placed twice.
    """
    return join_batches(plan.assignment, shards, ["rank", "micro_step", "optimizer_step"])
