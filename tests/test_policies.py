import random

import pytest
from pyspark.sql import functions as F

import naive
from batchloom.plans import policies as P


def frame(spark, lengths: dict[int, int]):
    return spark.createDataFrame(list(lengths.items()), "seq_id bigint, len int").repartition(3)


def assigned(plan):
    return {r["seq_id"]: (r["batch_id"], r["pos"]) for r in plan.assignment.collect()}


def numbered(*lengths):
    return dict(enumerate(lengths))


def batch_ids(plan):
    return [b for _, (b, _) in sorted(assigned(plan).items())]


def sample(seed, n=300, top=50):
    rng = random.Random(seed)
    return {i * 3: top if rng.random() < 0.5 else rng.randint(0, top) for i in range(n)}


# Hand cases.


def test_capacity_by_hand(spark):
    plan = P.plan_capacity(frame(spark, numbered(1, 1, 1, 2, 2, 3, 5, 5)), 10)
    assert batch_ids(plan) == [0, 0, 0, 0, 0, 1, 1, 2]


def test_a_record_over_the_limit_is_a_batch_of_its_own(spark):
    assert batch_ids(P.plan_capacity(frame(spark, numbered(12, 3, 3)), 10)) == [1, 0, 0]
    assert batch_ids(P.plan_capacity(frame(spark, numbered(12, 13, 14)), 10)) == [0, 1, 2]


def test_empty_records_share_a_batch_and_are_kept(spark):
    assert batch_ids(P.plan_capacity(frame(spark, numbered(0, 0, 0)), 10)) == [0, 0, 0]
    assert batch_ids(P.plan_capacity(frame(spark, numbered(0, 0, 0, 4, 5)), 10)) == [0, 0, 0, 1, 1]


def test_difference_by_hand(spark):
    plan = P.plan_difference(frame(spark, numbered(1, 2, 3, 10, 11, 30)), 2, 2)
    assert batch_ids(plan) == [0, 0, 1, 2, 2, 3]


def test_fixed_by_hand(spark):
    plan = P.plan_fixed(frame(spark, numbered(*range(7, 0, -1))), 3, smart=False)
    assert batch_ids(plan) == [0, 0, 0, 1, 1, 1, 2]


def test_sorting_is_stable(spark):
    plan = P.plan_fixed(frame(spark, numbered(2, 1, 2, 1)), 1)
    assert batch_ids(plan) == [2, 0, 3, 1]


def test_max_length_by_hand(spark):
    plan = P.plan_max_length(frame(spark, numbered(250, 30)), 100, 2)
    rows = plan.assignment.orderBy("seq_id", "chunk").collect()
    assert [(r["len"], r["batch_id"]) for r in rows] == [(100, 0), (100, 0), (50, 1), (30, 1)]


def test_an_exact_multiple_and_an_empty_record_are_not_cut_further(spark):
    plan = P.plan_max_length(frame(spark, numbered(200, 100, 0)), 100, 10)
    rows = plan.assignment.orderBy("seq_id", "chunk").collect()
    assert [(r["seq_id"], r["len"]) for r in rows] == [(0, 100), (0, 100), (1, 100), (2, 0)]


# Against planning record by record.


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", [1, 37, 100, 1000])
def test_capacity(spark, seed, limit):
    lengths = sample(seed)
    plan = P.plan_capacity(frame(spark, lengths), limit)
    assert assigned(plan) == naive.capacity(lengths, limit)
    for batch in plan.batches.collect():
        assert batch["n_records"] == 1 or batch["padded_tokens"] <= limit


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("diff,size", [(0, 1), (3, 7), (100, 40)])
def test_difference(spark, seed, diff, size):
    lengths = sample(seed)
    assert assigned(P.plan_difference(frame(spark, lengths), diff, size)) == naive.difference(
        lengths, diff, size
    )


@pytest.mark.parametrize("smart", [False, True])
def test_fixed(spark, smart):
    lengths = sample(5)
    assert assigned(P.plan_fixed(frame(spark, lengths), 7, smart)) == naive.fixed(lengths, 7, smart)


@pytest.mark.parametrize("smart", [False, True])
def test_max_length(spark, smart):
    lengths = sample(6)
    plan = P.plan_max_length(frame(spark, lengths), 9, 4, smart)
    got = {
        (r["seq_id"], r["chunk"]): (r["batch_id"], r["pos"], r["len"]) for r in plan.assignment.collect()
    }
    assert got == naive.max_length(lengths, 9, 4, smart)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_results_do_not_depend_on_partitioning(spark, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    lengths = sample(9)
    df = frame(spark, lengths).repartition(partitions)
    assert assigned(P.plan_capacity(df, 100)) == naive.capacity(lengths, 100)


def test_row_length_is_kept_beside_the_planned_length(spark):
    df = frame(spark, sample(2)).withColumn("row_len", F.col("len") + 5)
    for plan in (P.plan_difference(df, 3, 7), P.plan_fixed(df, 4), P.plan_fixed(df, 4, smart=False)):
        assert all(r["row_len"] == r["len"] + 5 for r in plan.assignment.collect())


# Orders.


@pytest.mark.parametrize("order", P.ORDERS)
def test_orders(spark, order):
    plan = P.plan_capacity(frame(spark, sample(4)), 100, order=order, seed=3)
    rows = sorted(plan.batches.collect(), key=lambda r: r["plan_pos"])
    assert [r["plan_pos"] for r in rows] == list(range(len(rows)))
    if order == "random":
        assert sorted(r["batch_id"] for r in rows) == list(range(len(rows)))
        return
    kind, _, direction = order.partition("_")
    measure = {"none": "batch_id", "rc": "n_records"}.get(kind, "padded_tokens")
    sign = -1 if direction == "desc" else 1
    expected = sorted(rows, key=lambda r: (sign * r[measure], r["batch_id"]))
    assert [r["batch_id"] for r in rows] == [r["batch_id"] for r in expected]


def test_reordering_a_plan(spark):
    plan = P.plan_fixed(frame(spark, sample(4)), 8)
    first = plan.ordered("pc_desc").batches.where("plan_pos = 0").first()
    assert first["padded_tokens"] == plan.batches.agg(F.max("padded_tokens")).first()[0]


# By name, and what is refused.


def test_by_name_is_unsorted_unless_asked(spark):
    lengths = sample(8)
    plan = P.plan(frame(spark, lengths), "FixedBatchSize", batch_size=4, order=None)
    assert assigned(plan) == naive.fixed(lengths, 4, smart=False)
    plan = P.plan(frame(spark, lengths), "FixedBatchSize", batch_size=4, smart=True)
    assert assigned(plan) == naive.fixed(lengths, 4, smart=True)


@pytest.mark.parametrize(
    "policy,knobs",
    [
        ("Unknown", {}),
        ("FixedBatchSize", {}),
        ("FixedBatchSize", {"batch_size": 0}),
        ("FixedBatchSize", {"batch_size": 4, "limit": 3}),
        ("GPUMemoryRestricted", {"limit": 0}),
        ("GPUMemoryRestricted", {"limit": 10, "order": "sideways"}),
        ("LengthDifferenceRestricted", {"max_token_diff": -1, "max_plan_size": 4}),
        ("MaxLengthRestricted", {"max_field_length": 0, "batch_size": 4}),
    ],
)
def test_refused(spark, policy, knobs):
    with pytest.raises(ValueError):
        P.plan(frame(spark, numbered(1)), policy, **knobs)


def test_empty_input_gives_no_batches(spark):
    plan = P.plan_capacity(frame(spark, numbered(1)).where("false"), 10, order="pc_desc")
    assert plan.batches.collect() == [] and plan.assignment.collect() == []


@pytest.mark.parametrize("own_row", [False, True])
def test_plans_of_lengths_that_are_ranked_once(spark, own_row):
    """The same plans as from the lengths, without ranking again."""
    rng = random.Random(12)
    rows = [(i * 3, 9 if rng.random() < 0.6 else rng.randrange(30), rng.randrange(30, 60)) for i in range(500)]
    lengths = spark.createDataFrame(rows, "seq_id bigint, len int, row_len int")
    lengths = lengths if own_row else lengths.drop("row_len")
    ranked = P.rank_lengths(lengths)
    for make in (lambda x: P.plan_fixed(x, 7), lambda x: P.plan_capacity(x, 100, order="pc_desc"), lambda x: P.plan_difference(x, 3, 8)):
        a, b = make(lengths), make(ranked)
        for part in ("assignment", "batches"):
            x, y = getattr(a, part), getattr(b, part)
            assert x.columns == y.columns and sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
        assert "Window" not in b.assignment._jdf.queryExecution().optimizedPlan().toString()
