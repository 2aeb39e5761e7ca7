import math

import pytest

import batchloom as bl
from batchloom.operators.shard import step_layout, with_loss_weight
from batchloom.plans import measures as M
from batchloom.plans import policies as P


def batches(spark, n, size=3):
    df = spark.createDataFrame([(i, 1 + i % 5) for i in range(n * size)], "seq_id bigint, len int")
    return P.plan_fixed(df, size).batches


def dealt(shards):
    out = {}
    for r in shards.orderBy("rank", "micro_step").collect():
        out.setdefault(r["rank"], []).append(r["plan_pos"])
    return out


def test_by_hand(spark):
    assert dealt(bl.shard_batches(batches(spark, 5), 2)) == {0: [0, 2, 4], 1: [1, 3, 0]}


@pytest.mark.parametrize("n,world", [(1, 1), (1, 5), (2, 7), (8, 4), (9, 4)])
def test_every_rank_has_as_many(spark, n, world):
    out = dealt(bl.shard_batches(batches(spark, n), world))
    total = math.ceil(n / world) * world
    assert out == {r: [p % n for p in range(r, total, world)] for r in range(world)}


def test_steps(spark):
    rows = bl.shard_batches(batches(spark, 8), 2, accumulation=3).collect()
    assert {(r["micro_step"], r["optimizer_step"]) for r in rows} == {(0, 0), (1, 0), (2, 0), (3, 1)}


def test_shuffled(spark):
    b = batches(spark, 30)
    one, same, two = (dealt(bl.shard_batches(b, 4, shuffle=True, seed=s)) for s in (1, 1, 2))
    assert one == same
    ids = lambda s: [
        r["batch_id"] for r in bl.shard_batches(b, 4, shuffle=True, seed=s).orderBy("micro_step", "rank").collect()
    ]
    assert ids(1) != ids(2) and sorted(ids(1)[:30]) == list(range(30))


def test_layout(spark):
    row = step_layout(batches(spark, 11), world_size=2, accumulation=4, epochs=3).first()
    assert tuple(row) == (11, 6, 2, 6)


def test_accumulation():
    assert bl.accumulation_steps(32, 4, 8) == 1
    assert bl.accumulation_steps(128, 4, 8) == 4
    for bad in ((30, 4, 8), (16, 4, 8), (0, 4, 8)):
        with pytest.raises(ValueError):
            bl.accumulation_steps(*bad)
    with pytest.raises(ValueError):
        bl.shard_batches(None, 0)


def test_loss_weight(spark):
    rows = with_loss_weight(batches(spark, 2), 4).collect()
    assert [r["loss_weight"] for r in rows] == [0.75, 0.75]


def test_plan_numbers(spark):
    df = spark.createDataFrame(list(enumerate([1, 2, 3, 10, 11, 30])), "seq_id bigint, len int")
    plan = P.plan_difference(df, 2, 2)
    assert tuple(M.difference_stats(plan.batches).first()) == (4, 1, 0)
    assert tuple(M.plan_stats(plan.batches).first()) == (4,)
    plan = P.plan_capacity(df, 12)
    assert sorted(map(tuple, M.batch_measures(plan.batches).collect())) == [
        (0, 3, 9, 2),
        (1, 1, 10, 0),
        (2, 1, 11, 0),
        (3, 1, 30, 0),
    ]
    assert tuple(M.capacity_stats(plan.batches).first()) == (4, 30, 3, 30)
    assert [r["seq_id"] for r in M.plan_item(plan, -1).collect()] == [5]
    assert M.plan_item(plan, 7).collect() == []
    empty = P.plan_capacity(df.where("false"), 12).batches
    assert tuple(M.capacity_stats(empty).first()) == (0, 0, 0, 0)
    assert tuple(M.difference_stats(empty).first()) == (0, None, None)


def test_preview_of_short_and_split_records(spark):
    df = spark.createDataFrame([(0, list(range(12))), (1, [7, 8])], "seq_id bigint, content array<int>")
    plan = P.plan_fixed(bl.lengths_of(df), 2, smart=False)
    rows = M.preview(df, plan).orderBy("pos").collect()
    assert [(r["size"], r["first_ids"], r["last_ids"]) for r in rows] == [
        (12, [0, 1, 2, 3, 4], [7, 8, 9, 10, 11]),
        (2, [7, 8], [7, 8]),
    ]
    plan = P.plan_max_length(bl.lengths_of(df, key="content"), 8, 2, key="content")
    rows = M.preview(df, plan).orderBy("batch_id", "pos").collect()
    assert [(r["batch_id"], r["size"], r["last_ids"]) for r in rows] == [
        (0, 8, [3, 4, 5, 6, 7]),
        (0, 4, [8, 9, 10, 11]),
        (1, 2, [7, 8]),
    ]
