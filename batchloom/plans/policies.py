"""The four batch planning policies and the plan they produce."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.operators.ordinal import ID_BITS, random_ordinal, with_ordinal
from batchloom.plans.fold import attach_capacity_runs, attach_difference_runs, batch_of
from batchloom.session import materialize

# Policy names as they appear in job configurations.
FIXED = "FixedBatchSize"
CAPACITY = "GPUMemoryRestricted"
DIFFERENCE = "LengthDifferenceRestricted"
MAX_LENGTH = "MaxLengthRestricted"
POLICIES = (FIXED, CAPACITY, DIFFERENCE, MAX_LENGTH)

# Order names. "bs" and "pc" both mean padded tokens; "rc" is the record count.
ORDERS = ("none", "bs_asc", "bs_desc", "pc_asc", "pc_desc", "rc_asc", "rc_desc", "random")


# Batches are counted, and there are fewer than 2^54 of them.
BATCH_BITS = 54


@dataclass(frozen=True)
class BatchPlan:
    """Which record goes where.

    ``assignment``: seq_id, chunk, len, row_len, batch_id, pos. ``len`` is what the policy looked
    at, ``row_len`` the whole record (or chunk), and ``chunk`` counts the pieces of a split record
    from 0. ``batches``: batch_id, plan_pos, n_records, min_len, max_len, max_row_len, tokens,
    padded_tokens. Both are lazy.
    """

    policy: str
    knobs: dict
    assignment: DataFrame
    batches: DataFrame

    def ordered(self, order: str, seed: int = 0) -> "BatchPlan":
        """The same batches in another order of delivery."""
        return replace(
            self,
            knobs={**self.knobs, "order": order, "seed": seed},
            batches=order_batches(self.batches, order, seed),
        )

    def item(self, position: int) -> DataFrame:
        """The rows of the batch at ``position``; negative ones count from the end."""
        if position >= 0:
            wanted = self.batches.where(F.col("plan_pos") == position)
        else:
            count = self.batches.agg(F.count(F.lit(1)).alias("n")).scalar()
            wanted = self.batches.where(F.col("plan_pos") == count + F.lit(position))
        # One batch id: the other side is filtered by it before it moves.
        return self.assignment.join(F.broadcast(wanted.select("batch_id", "plan_pos")), "batch_id")

    def rebased(self, assignment: DataFrame) -> "BatchPlan":
        """The plan on a stored copy of its assignment, so that nothing is planned again."""
        return _plan(self.policy, self.knobs, assignment)


def _at_least_one(**knobs: int) -> None:
    for name, value in knobs.items():
        if value is None or int(value) != value or value < 1:
            raise ValueError(f"{name} must be a whole number of at least 1, not {value!r}")


def _assignment(df: DataFrame, batch: str, pos: str) -> DataFrame:
    return df.selectExpr(
        "seq_id",
        "0 AS chunk",
        "cast(len AS int) AS len",
        "cast(row_len AS int) AS row_len",
        f"cast({batch} AS bigint) AS batch_id",
        f"cast({pos} AS bigint) AS pos",
    )


def batch_table(assignment: DataFrame) -> DataFrame:
    """One row per batch. Partial aggregation keeps a batch of any size off a single task."""
    grouped = assignment.groupBy("batch_id").agg(
        F.expr("count(1) AS n_records"),
        F.expr("min(len) AS min_len"),
        F.expr("max(len) AS max_len"),
        F.expr("max(row_len) AS max_row_len"),
        F.expr("cast(sum(row_len) AS bigint) AS tokens"),
    )
    return grouped.selectExpr(
        "batch_id",
        "batch_id AS plan_pos",
        "n_records",
        "min_len",
        "max_len",
        "max_row_len",
        "tokens",
        "n_records * max_row_len AS padded_tokens",
    )


_BATCH_COLUMNS = (
    "batch_id", "plan_pos", "n_records", "min_len", "max_len", "max_row_len", "tokens", "padded_tokens",
)


def order_batches(batches: DataFrame, order: str = "none", seed: int = 0, batch_bits: int = BATCH_BITS) -> DataFrame:
    """Set ``plan_pos``, the 0-based position of delivery. Ties keep the order of ``batch_id``.

    ``batch_bits`` says that there are fewer than ``2^batch_bits`` batches (``with_ordinal``).
    """
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}, use one of {ORDERS}")
    body = [c for c in _BATCH_COLUMNS if c not in ("batch_id", "plan_pos")]
    if order == "none":
        return batches.selectExpr("batch_id", "batch_id AS plan_pos", *body)
    if order == "random":
        out = random_ordinal(batches, seq="batch_id", seed=seed, carry=body, out="plan_pos")
        return out.select(*_BATCH_COLUMNS)
    measure = "n_records" if order.startswith("rc") else "padded_tokens"
    sign = "-" if order.endswith("desc") else ""
    keyed = batches.selectExpr("batch_id", *body, f"{sign}{measure} AS __key")
    out = with_ordinal(keyed, key="__key", seq="batch_id", carry=body, out="plan_pos", id_bits=batch_bits)
    return out.select(*_BATCH_COLUMNS)


def _plan(policy: str, knobs: dict, assignment: DataFrame, batch_bits: int = BATCH_BITS) -> BatchPlan:
    batches = batch_table(assignment)
    return BatchPlan(
        policy,
        knobs,
        assignment,
        order_batches(batches, knobs.get("order", "none"), knobs.get("seed", 0), batch_bits),
    )


def _lengths(df: DataFrame) -> DataFrame:
    """(seq_id, len, row_len); without a ``row_len`` the planned length is the whole record."""
    return df.selectExpr("seq_id", "len", "row_len" if "row_len" in df.columns else "len AS row_len")


def plan_fixed(lengths: DataFrame, batch_size: int, smart: bool = True, id_bits: int = ID_BITS) -> BatchPlan:
    """Slices of ``batch_size`` records, in input order or (``smart``) in ascending length.

    Here and below, ``id_bits`` says that record ids are below ``2^id_bits`` (``with_ordinal``).
    """
    _at_least_one(batch_size=batch_size)
    if smart:
        ranked = _by_length(lengths, id_bits)
    else:
        ranked = with_ordinal(_lengths(lengths), seq="seq_id", carry=["len", "row_len"], id_bits=id_bits)
    assignment = _assignment(ranked, f"ordinal div {batch_size}", f"ordinal % {batch_size}")
    return _plan(FIXED, {"batch_size": batch_size, "smart": smart}, assignment)


def rank_lengths(lengths: DataFrame, id_bits: int = ID_BITS) -> DataFrame:
    """``lengths`` with ``ordinal``, the position in ascending length, stored once for several sorted plans.

    The policies that sort take it in place of ``lengths`` and rank nothing themselves.
    """
    return materialize(_by_length(lengths, id_bits), "ranks")


def _by_length(lengths: DataFrame, id_bits: int, per_key=None) -> DataFrame:
    """Records ranked by (len, seq_id), carrying a row length of its own only if there is one."""
    if "ordinal" in lengths.columns:
        ranked = lengths.select(*(c for c in ("seq_id", "len", "row_len", "ordinal") if c in lengths.columns))
        if per_key is not None:
            # One row for each length; equal lengths of most records are split by Spark like any skewed join.
            table = per_key(ranked.groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("base")))
            ranked = ranked.join(table.drop("n", "base"), "len")
        return ranked if "row_len" in lengths.columns else ranked.selectExpr("*", "len AS row_len")
    own_row = "row_len" in lengths.columns
    ranked = with_ordinal(
        _lengths(lengths) if own_row else lengths.select("seq_id", "len"),
        key="len",
        seq="seq_id",
        carry=["row_len"] if own_row else [],
        per_key=per_key,
        id_bits=id_bits,
    )
    return ranked if own_row else ranked.selectExpr("*", "len AS row_len")


def plan_capacity(
    lengths: DataFrame, limit: int, order: str = "none", seed: int = 0, id_bits: int = ID_BITS
) -> BatchPlan:
    """As many records per batch as ``records * longest <= limit`` allows, in ascending length.

    A record longer than the limit becomes a batch of its own.
    """
    _at_least_one(limit=limit)
    ranked = _by_length(lengths, id_bits, attach_capacity_runs(limit))
    knobs = {"limit": limit, "order": order, "seed": seed}
    # There are no more batches than records.
    return _plan(CAPACITY, knobs, _assignment(ranked, *batch_of()), min(id_bits, BATCH_BITS))


def plan_difference(
    lengths: DataFrame, max_token_diff: int, max_plan_size: int, id_bits: int = ID_BITS
) -> BatchPlan:
    """Batches of at most ``max_plan_size`` records whose lengths differ by ``max_token_diff``."""
    _at_least_one(max_plan_size=max_plan_size)
    if max_token_diff < 0:
        raise ValueError("max_token_diff must not be negative")
    ranked = _by_length(lengths, id_bits, attach_difference_runs(max_token_diff, max_plan_size))
    knobs = {"max_token_diff": max_token_diff, "max_plan_size": max_plan_size}
    return _plan(DIFFERENCE, knobs, _assignment(ranked, *batch_of()))


def plan_max_length(
    lengths: DataFrame,
    max_field_length: int,
    batch_size: int,
    smart: bool = False,
    key: str | None = None,
    id_bits: int = ID_BITS,
) -> BatchPlan:
    """Records over ``max_field_length`` are cut into chunks; ``batch_size`` chunks per batch.

    Chunks of one record may fall into two batches. ``smart`` sorts by the uncut length first.
    A chunk keeps the planned field alone, so its ``row_len`` is its own length. ``key`` is the name
    of that field, which collation needs to cut the records.
    """
    _at_least_one(max_field_length=max_field_length, batch_size=batch_size)
    # A record that is not cut, also an empty one, is one piece.
    count = f"greatest((len + {max_field_length - 1}) div {max_field_length}, 1)"
    ranked = with_ordinal(
        _lengths(lengths),
        key="len" if smart else None,
        seq="seq_id",
        carry=["row_len"] if smart else ["len", "row_len"],
        weight=F.expr(count),
        id_bits=id_bits,
    )
    pieces = ranked.selectExpr("*", f"explode(sequence(0, cast({count} - 1 AS int))) AS chunk")
    piece = f"least(len - chunk * {max_field_length}, {max_field_length})"
    assignment = pieces.selectExpr(
        "seq_id",
        "chunk",
        f"cast(if(len > {max_field_length}, {piece}, len) AS int) AS len",
        f"cast(if(len > {max_field_length}, {piece}, row_len) AS int) AS row_len",
        f"(ordinal + chunk) div {batch_size} AS batch_id",
        f"(ordinal + chunk) % {batch_size} AS pos",
    )
    knobs = {
        "max_field_length": max_field_length,
        "batch_size": batch_size,
        "smart": smart,
        "key": key,
    }
    return _plan(MAX_LENGTH, knobs, assignment)


# Knobs of each policy: required ones, then optional ones.
_KNOBS: dict[str, tuple[Sequence[str], Sequence[str]]] = {
    FIXED: (("batch_size",), ("smart",)),
    CAPACITY: (("limit",), ("order", "seed")),
    DIFFERENCE: (("max_token_diff", "max_plan_size"), ()),
    MAX_LENGTH: (("max_field_length", "batch_size"), ("smart", "key")),
}
_BUILDERS = {
    FIXED: plan_fixed,
    CAPACITY: plan_capacity,
    DIFFERENCE: plan_difference,
    MAX_LENGTH: plan_max_length,
}


def plan(lengths: DataFrame, policy: str, id_bits: int = ID_BITS, **knobs) -> BatchPlan:
    """Plan by policy name, the way job configurations do; sorting is off unless asked for."""
    if policy not in _BUILDERS:
        raise ValueError(f"unknown policy {policy!r}, use one of {POLICIES}")
    required, optional = _KNOBS[policy]
    given = {name: value for name, value in knobs.items() if value is not None}
    missing = [name for name in required if name not in given]
    unknown = [name for name in given if name not in (*required, *optional)]
    if missing or unknown:
        raise ValueError(f"{policy}: missing knobs {missing}, unknown knobs {unknown}")
    if "smart" in optional:
        given.setdefault("smart", False)
    return _BUILDERS[policy](lengths, id_bits=id_bits, **given)
