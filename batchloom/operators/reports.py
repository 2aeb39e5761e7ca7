"""Metrics of training runs: steps over ranks, devices, scalar logs and comparisons.

A rate over no time at all and a share of nothing are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags of a scalar log.
TFLOPS_TAG = "tflops (mean)"
TIME_TAG = "time (mean)"
USED_SUFFIX = "_used"
FREE_SUFFIX = "_free"

# Fixed value: extra work when activations are computed again.
RECOMPUTE_FACTOR = 4 / 3


def throughput(
    base_tflop: float, batch_size: Column, seq_len: Column, step_time: Column, recompute: bool = False
) -> Column:
    """TFLOPS of a step; ``base_tflop`` is the work for one token."""
    base = base_tflop * (RECOMPUTE_FACTOR if recompute else 1.0)
    return F.try_divide(F.lit(base) * batch_size * seq_len, step_time)


def step_metrics(log: DataFrame, batch_per_device: int) -> DataFrame:
    """Per (epoch, step) over the ranks: batch size, loss per configured batch, time, records per
    second and TFLOPS."""
    return (
        log.groupBy("epoch", "step")
        .agg(
            F.sum("batch_size").cast("bigint").alias("batch_size"),
            F.sum("normalized_loss").alias("__loss"),
            F.avg("step_time").alias("mean_time"),
            F.avg("tflops").alias("mean_tflops"),
        )
        .select(
            "epoch",
            "step",
            "batch_size",
            (F.try_divide("__loss", "batch_size") * batch_per_device).alias("loss"),
            "mean_time",
            F.try_divide("batch_size", "mean_time").alias("records_per_second"),
            "mean_tflops",
        )
    )


def with_global_step(log: DataFrame, micro_steps_per_epoch: int) -> DataFrame:
    """``global_step``: micro-steps counted through all epochs, so that no two share a number."""
    return log.withColumn(
        "global_step", F.col("epoch").cast("bigint") * micro_steps_per_epoch + F.col("step")
    )


def memory_utilisation(samples: DataFrame, by: str) -> DataFrame:
    """Used share of the memory of all devices, per ``by`` (a time or a step)."""
    return samples.groupBy(by).agg(
        F.sum("used").alias("used"),
        F.try_divide(F.sum("used"), F.sum(F.col("used") + F.col("free"))).alias("utilisation"),
    )


def device_scalars(samples: DataFrame, by: str) -> DataFrame:
    """Samples in long form: tags ``gpu{device}_used`` and ``gpu{device}_free``."""
    return samples.select(
        by,
        F.expr("stack(2, 'used', cast(used AS double), 'free', cast(free AS double)) AS (__kind, value)"),
        "device",
    ).select(by, F.concat(F.lit("gpu"), F.col("device"), F.lit("_"), F.col("__kind")).alias("tag"), "value")


def run_summary(scalars: DataFrame) -> DataFrame:
    """One row of a scalar log ``(tag, value)``: mean TFLOPS, total time, used share of memory.

    The share is null when no memory tags were logged.
    """
    tag, value = F.col("tag"), F.col("value")
    used = F.sum(F.when(tag.endswith(USED_SUFFIX), value))
    free = F.sum(F.when(tag.endswith(FREE_SUFFIX), value))
    return scalars.agg(
        F.avg(F.when(tag == TFLOPS_TAG, value)).alias("tflops"),
        F.sum(F.when(tag == TIME_TAG, value)).alias("total_time"),
        F.try_divide(used, used + free).alias("memory_utilisation"),
    )


def probe_log(log: DataFrame) -> DataFrame:
    """Tokens and used share of memory of every probed batch."""
    return log.select(
        "batch_size",
        "seq_len",
        (F.col("batch_size").cast("bigint") * F.col("seq_len")).alias("token_count"),
        F.try_divide(F.col("used"), F.col("used") + F.col("free")).alias("utilisation"),
    )


def pick_capacity(probes: DataFrame, max_utilisation: float) -> DataFrame:
    """The largest token count whose memory use stays within the limit."""
    within = probes.where(F.col("utilisation") <= max_utilisation)
    return within.agg(F.max("token_count").alias("token_capacity"))


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """Per dataset, run ``other`` against ``base``: throughput and time as ratios, memory use in
    percentage points, loss as a difference. Inputs: (dataset, tflops, memory_utilisation, time,
    loss), one row per dataset."""
    joined = base.alias("a").join(other.alias("b"), "dataset")
    return joined.select(
        "dataset",
        F.try_divide("b.tflops", "a.tflops").alias("throughput_ratio"),
        ((F.col("b.memory_utilisation") - F.col("a.memory_utilisation")) * 100).alias("memory_points"),
        F.try_divide("b.time", "a.time").alias("time_ratio"),
        (F.col("b.loss") - F.col("a.loss")).alias("loss_delta"),
    )
