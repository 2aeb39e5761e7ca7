"""Batches to padded rows: ids, attention mask and labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.functions.arrays import fill_like, pad
from batchloom.operators.lengths import field_length, token_fields
from batchloom.plans.policies import MAX_LENGTH, BatchPlan

# Fillers of padded positions.
PAD_ID = 0
IGNORED_LABEL = -100

# Rows of one batch that are handled together. Batches are usually far smaller; one of empty
# records has no upper limit.
SLICE_ROWS = 1 << 16

# Steps of one rank that are written by one task.
STEPS_TOGETHER = 256

# Cells of a matrix in one row of the result: some 150 MB with mask and labels.
MAX_CELLS = 1 << 24


def split_records(tokens: DataFrame, key: str, max_field_length: int) -> DataFrame:
    """Tokenized records as chunks: (seq_id, chunk, fields).

    A record whose ``key`` field is over the maximum becomes pieces of that field alone, its other
    fields are null. The others stay whole as chunk 0. Pieces add up to the input: no row is copied.
    """
    fields = token_fields(tokens)
    rest = [f for f in fields if f != key]
    cut = field_length(tokens, key) > max_field_length
    last = F.when(cut, F.size(key) - 1).otherwise(0)
    # Start positions are exploded, not arrays of pieces: a piece is cut where it is needed.
    starts = F.sequence(F.lit(0), last, F.lit(max_field_length))
    pieces = tokens.select(
        "seq_id", key, *(F.when(~cut, F.col(f)).alias(f) for f in rest), F.posexplode(starts).alias("chunk", "__at")
    )
    piece = F.when(
        F.size(key) > max_field_length, F.slice(key, F.col("__at") + 1, F.lit(max_field_length))
    ).otherwise(F.col(key))
    return pieces.withColumn(key, piece).select("seq_id", "chunk", *fields)


def join_batches(rows: DataFrame, batches: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Assigned rows with ``plan_pos``, ``pad_to`` (the longest row of the batch) and ``columns``.

    Batches are joined slice by slice, so that one of any size is spread over tasks.
    """
    slices = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_records - 1) div {SLICE_ROWS}"))
    sliced = batches.select(
        "batch_id",
        "plan_pos",
        F.col("max_row_len").alias("pad_to"),
        *columns,
        F.explode(slices).alias("__slice"),
    )
    placed = rows.withColumn("__slice", F.expr(f"pos div {SLICE_ROWS}"))
    return placed.join(sliced, ["batch_id", "__slice"]).drop("__slice")


def collate(
    tokens: DataFrame,
    plan: BatchPlan,
    fields: Sequence[str] | None = None,
    loss_masked: Sequence[str] = (),
    with_labels: bool = True,
    padding_side: str = "right",
    pad_to: int | None = None,
    partition_by: Sequence[str] = (),
    placement: DataFrame | None = None,
    pad_id: int = PAD_ID,
) -> DataFrame:
    """Padded rows: (plan_pos, batch_id, pos, n_tokens, pad_to, input_ids, attention_mask, labels).

    Fields are concatenated in order. Ids are padded with ``pad_id`` and labels with -100, to the longest row
    of the batch or to the fixed length ``pad_to``; the labels of ``loss_masked`` fields are -100.
    Only integers are shuffled to find the widths. Token arrays move once, to their places, and
    padding, mask and labels are made after that move. ``partition_by`` deals the result out by those
    columns in between, each rank's steps in ranges of STEPS_TOGETHER, sorted. Bucketed tokens
    (``write_token_set(table=…)``) make that the only move of the arrays. ``placement``, from ``place_rows``, gives places and widths for
    rows that are delivered to ranks; to collate some of the fields, shard ``plan_over_fields``.
    """
    if padding_side not in ("left", "right"):
        raise ValueError(f"unknown padding side {padding_side!r}")
    fields = list(fields or token_fields(tokens))
    if placement is None:
        used = plan_over_fields(plan, tokens, fields)
        placement = join_batches(used.assignment, used.batches)
    tokens, on = chunked(tokens, plan)
    extra = [c for c in placement.columns if c not in ("seq_id", "chunk", "len", "row_len")]
    body = tokens.select(*on, *fields)
    rows = placement.select(*on, *extra).join(body, on)
    if partition_by:
        # By arithmetic from the place, so that no range is sampled and the join runs once.
        together = [F.expr(f"{c} div {STEPS_TOGETHER}") if c == "micro_step" else F.col(c) for c in partition_by if c != "pos"]
        rows = rows.repartition(*together).sortWithinPartitions(*partition_by)
    width = F.lit(pad_to) if pad_to is not None else F.col("pad_to")
    ids = F.concat(*[_present(f) for f in fields])
    masked = set(loss_masked)
    labels = F.concat(
        *[fill_like(F.col(f), IGNORED_LABEL) if f in masked else F.col(f) for f in fields]
    )
    others = [c for c in extra if c not in ("plan_pos", "batch_id", "pos", "pad_to")]
    out = rows.select(
        "plan_pos",
        "batch_id",
        "pos",
        *others,
        width.cast("int").alias("pad_to"),
        ids.alias("__ids"),
        *([labels.alias("__labels")] if with_labels else []),
    )
    if pad_to is not None:
        out = out.withColumn(
            "__ids",
            F.when(F.size("__ids") <= F.col("pad_to"), F.col("__ids")).otherwise(
                F.raise_error(F.lit("a row is longer than the fixed length")).cast("array<int>")
            ),
        )
    columns = [
        F.size("__ids").alias("n_tokens"),
        "pad_to",
        pad(F.col("__ids"), F.col("pad_to"), F.lit(pad_id), padding_side).alias("input_ids"),
        pad(
            F.array_repeat(F.lit(True), F.size("__ids")), F.col("pad_to"), F.lit(False), padding_side
        ).alias("attention_mask"),
    ]
    if with_labels:
        columns.append(
            pad(F.col("__labels"), F.col("pad_to"), F.lit(IGNORED_LABEL), padding_side).alias("labels")
        )
    return out.select("plan_pos", "batch_id", "pos", *others, *columns)


def _present(field: str):
    """The field, or an error where a chunk of a split record does not have it."""
    lost = F.raise_error(F.lit(f"{field} is missing in a record that was split"))
    return F.coalesce(F.col(field), lost.cast("array<int>"))


def plan_over_fields(plan: BatchPlan, tokens: DataFrame, fields: Sequence[str]) -> BatchPlan:
    """The plan with row lengths over ``fields`` only, for collating some of the fields.

    The batches and their order stay; what is padded to is the longest row of those fields.
    """
    if set(fields) == set(token_fields(tokens)):
        return plan
    tokens, on = chunked(tokens, plan)
    total = F.lit(0)
    for field in fields:
        total = total + F.coalesce(field_length(tokens, field), F.lit(0))
    lengths = tokens.select(*on, total.cast("int").alias("row_len"))
    assignment = plan.assignment.drop("row_len").join(lengths, on)
    longest = assignment.groupBy("batch_id").agg(
        F.max("row_len").alias("max_row_len"), F.sum("row_len").alias("tokens")
    )
    batches = plan.batches.drop("max_row_len", "tokens", "padded_tokens").join(longest, "batch_id")
    batches = batches.withColumn("padded_tokens", F.col("n_records") * F.col("max_row_len"))
    return replace(plan, assignment=assignment, batches=batches)


def chunked(tokens: DataFrame, plan: BatchPlan) -> tuple[DataFrame, list[str]]:
    """The tokens as the plan places them, and the columns that name a row of them."""
    if plan.policy != MAX_LENGTH:
        return tokens, ["seq_id"]
    if not plan.knobs.get("key"):
        raise ValueError("plan_max_length needs the name of the split field (key) to be collated")
    split = split_records(tokens, plan.knobs["key"], plan.knobs["max_field_length"])
    return split, ["seq_id", "chunk"]


def batch_matrices(rows: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """The matrices of every batch, as a trainer takes them, in parts of at most ``max_cells`` cells.

    ``part`` is 0 for a batch that fits, as one under any usual capacity does; the parts 0, 1, … of a
    larger one concatenate to it. A part has at least one row, and as many as its width allows, so
    that a row of the result stays within what Spark stores in one.
    """
    names = [c for c in ("input_ids", "attention_mask", "labels") if c in rows.columns]
    others = [c for c in rows.columns if c not in (*names, "pos", "n_tokens")]
    entry = F.struct("pos", *names)
    grouped = (
        rows.withColumn("part", F.expr(f"pos div greatest(1, {max_cells} div greatest(1, pad_to))"))
        .groupBy(*others, "part")
        .agg(F.array_sort(F.collect_list(entry)).alias("__rows"))
    )
    return grouped.select(
        *others,
        "part",
        F.size("__rows").alias("n_rows"),
        *(F.transform("__rows", itemgetter(n)).alias(n) for n in names),
    )


def single_batch(matrices: list) -> dict:
    """The one batch a loader step delivers. More or fewer than one is an error."""
    if len(matrices) != 1:
        raise ValueError(f"a step takes one planned batch, got {len(matrices)}")
    return matrices[0]
