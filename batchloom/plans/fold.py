"""Greedy batch closing on the length histogram instead of on the records.

Records are taken in ascending length, so the longest record of the open batch is always the current
one and the shortest is the one the batch was opened with. Where batches are cut therefore depends
only on how many records there are per length class, never on which. A *class* is a range of records,
consecutive in the sorted order, that share one capacity:

* token capacity: records with the same ``limit div len``. That quotient takes at most
  ``2 * sqrt(limit) + 2`` values, so the fold is that small whatever the corpus holds;
* length difference: one class per length, as the difference is tested against the length itself.

The fold walks the classes once, keeps three integers, and emits a *run* per class from which the
batch of each record follows by arithmetic on its position inside the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Capacity of a class of empty records: any number of them fits.
NO_LIMIT = 1 << 62

RUN_SCHEMA = (
    "class_key bigint, class_base bigint, run_batch bigint, run_filled bigint, "
    "run_room bigint, run_cap bigint"
)


class GreedyFold:
    """Walks classes in ascending order; see the module text for why this is enough."""

    def __init__(self, max_diff: int | None = None):
        self.max_diff = max_diff
        self.batch = 0  # open batch
        self.filled = 0  # records in it
        self.shortest = 0  # length it was opened with

    def run(self, length: int, count: int, cap: int) -> tuple[int, int, int, int]:
        """Take ``count`` records of one class; return (batch, filled, room, cap) at its start."""
        full = self.filled >= cap
        too_wide = self.max_diff is not None and length - self.shortest > self.max_diff
        if self.filled and (full or too_wide):
            self.batch += 1
            self.filled = 0
        if not self.filled:
            self.shortest = length
        room = cap - self.filled
        start = (self.batch, self.filled, room, cap)
        if count <= room:
            self.filled += count
        else:
            further = -(-(count - room) // cap)
            self.batch += further
            self.filled = count - room - (further - 1) * cap
            self.shortest = length
        return start


def fold_classes(classes: DataFrame, max_diff: int | None = None) -> DataFrame:
    """Runs of ``classes(class_key, class_base, length, n, cap)``, in the order of ``class_base``.

    The fold is sequential by nature and takes one task. Its input is the class table, one row per
    capacity or per distinct length, read as a stream of Arrow batches in constant memory.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = GreedyFold(max_diff)
        for frame in frames:
            runs = [
                fold.run(length, n, cap)
                for length, n, cap in zip(
                    frame["length"].tolist(), frame["n"].tolist(), frame["cap"].tolist()
                )
            ]
            out = pd.DataFrame(
                runs, columns=["run_batch", "run_filled", "run_room", "run_cap"], dtype="int64"
            )
            out.insert(0, "class_key", frame["class_key"].to_numpy())
            out.insert(1, "class_base", frame["class_base"].to_numpy())
            yield out

    ordered = classes.repartition(1).sortWithinPartitions("class_base")
    return ordered.mapInPandas(walk, schema=RUN_SCHEMA)


def attach_capacity_runs(limit: int):
    """``per_key`` hook: adds the run of each length class under a token capacity."""
    # Records of a length that a batch holds; one if the length is over the limit.
    capacity = f"CASE WHEN len > 0 THEN greatest({limit}L div len, 1L) ELSE {NO_LIMIT}L END"

    def hook(table: DataFrame) -> DataFrame:
        by_length = table.selectExpr("*", f"{capacity} AS class_key")
        classes = by_length.groupBy("class_key").agg(
            F.expr("min(base) AS class_base"),
            F.expr("max(len) AS length"),
            F.expr("sum(n) AS n"),
            F.expr("max(class_key) AS cap"),
        )
        runs = fold_classes(classes)
        # At most 2 * sqrt(limit) + 2 rows: small by the knob, not by luck.
        return by_length.join(F.broadcast(runs), "class_key").drop("class_key")

    return hook


def attach_difference_runs(max_diff: int, max_size: int):
    """``per_key`` hook: adds the run of each length under a length difference and a size limit."""

    def hook(table: DataFrame) -> DataFrame:
        classes = table.selectExpr(
            "len AS class_key", "base AS class_base", "len AS length", "n", f"{max_size}L AS cap"
        )
        runs = fold_classes(classes, max_diff).withColumnRenamed("class_key", "len")
        # One row per distinct length on both sides; left to Spark to broadcast if it proves small.
        return table.join(runs, "len")

    return hook


def batch_of(ordinal: str = "ordinal") -> tuple[str, str]:
    """(batch_id, pos) of a record from its position and the run of its class."""
    rank = f"({ordinal} - class_base)"
    over = f"({ordinal} - class_base - run_room)"
    batch = f"CASE WHEN {over} < 0 THEN run_batch ELSE run_batch + 1 + {over} div run_cap END"
    pos = f"CASE WHEN {over} < 0 THEN run_filled + {rank} ELSE {over} % run_cap END"
    return batch, pos
