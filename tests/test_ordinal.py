import random

import pytest
from pyspark.sql import functions as F

from batchloom.operators.ordinal import random_ordinal, with_ordinal


def frame(spark, rows, schema="seq bigint, k int, w int"):
    return spark.createDataFrame(rows, schema).repartition(5)


def expected(rows, weighted):
    out, at = {}, 0
    for seq, key, w in sorted(rows, key=lambda r: (r[1], r[0])):
        out[seq] = at
        at += w if weighted else 1
    return out


IDS = {
    "dense": lambda rng, n: list(range(n)),
    "sparse": lambda rng, n: [(i // 3) * (1 << 20) + i % 3 for i in range(n)],
    "partitioned": lambda rng, n: [((i % 7) << 33) + i // 7 for i in range(n)],
    "random": lambda rng, n: rng.sample(range(1 << 62), n),
}


@pytest.mark.parametrize("ids", IDS)
@pytest.mark.parametrize("bits", [2, 18])
@pytest.mark.parametrize("weighted", [False, True])
def test_matches_sorting(spark, ids, bits, weighted):
    rng = random.Random(f"{ids}{bits}{weighted}")
    # Two thirds of the rows share one key.
    rows = [
        (seq, 7 if rng.random() < 0.66 else rng.randint(-5, 40), rng.randint(0, 4))
        for seq in IDS[ids](rng, 400)
    ]
    out = with_ordinal(
        frame(spark, rows),
        seq="seq",
        key="k",
        weight=F.col("w") if weighted else None,
        carry=["w"],
        block_bits=bits,
    )
    got = {r["seq"]: r["ordinal"] for r in out.collect()}
    assert got == expected(rows, weighted)
    assert {(r["seq"], r["w"]) for r in out.collect()} == {(s, w) for s, _, w in rows}


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_without_key_and_any_partitioning(spark, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    rows = [(i * 1000, 0, 1) for i in range(300)]
    out = with_ordinal(frame(spark, rows), seq="seq", block_bits=8)
    assert {r["seq"]: r["ordinal"] for r in out.collect()} == {i * 1000: i for i in range(300)}


def test_null_is_an_error(spark):
    for rows in ([(None, 1, 1)], [(1, None, 1)]):
        with pytest.raises(Exception, match="is null"):
            with_ordinal(frame(spark, rows), seq="seq", key="k").collect()


def test_empty_input(spark):
    assert with_ordinal(frame(spark, []), seq="seq", key="k").collect() == []


def test_random_order_is_a_seeded_permutation(spark):
    df = spark.range(500).withColumnRenamed("id", "seq").withColumn("w", F.lit(3))

    def order(seed):
        rows = random_ordinal(df, seq="seq", seed=seed, carry=["w"]).collect()
        return {r["seq"]: r["ordinal"] for r in rows}

    first, again, other = order(1), order(1), order(2)
    assert first == again != other
    assert sorted(first.values()) == list(range(500))
    assert [s for s, _ in sorted(first.items(), key=lambda e: e[1])] != list(range(500))


def test_a_key_of_all_rows_is_spread(spark):
    """No task of the planning stage sees more than a block of a hot key."""
    df = spark.range(1 << 16).selectExpr("id AS seq", "7 AS k")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_ordinal(df, seq="seq", key="k", block_bits=10)
        sizes = [
            r["count"]
            for r in out.groupBy(F.spark_partition_id().alias("p"), F.shiftright("seq", 10).alias("b")).count().collect()
        ]
        assert sizes == [1 << 10] * 64
        assert out.select(F.spark_partition_id()).distinct().count() == 8
        assert out.where("ordinal != seq").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def window_groups(ids, levels):
    """Rows of every window partition of the hierarchy over these ids, level by level."""
    from collections import Counter

    for i in range(levels + 1):
        rows = {x >> 18 * i for x in ids}
        yield max(Counter(x >> 18 for x in rows).values()) if i < levels else len(rows)


@pytest.mark.parametrize("bits,levels", [(63, 3), (62, 3), (54, 2), (36, 1), (20, 1)])
def test_windows_are_bounded_for_any_ids(spark, bits, levels):
    """Hashed ids of any width under one hot key: no window holds more than 2^18 rows, and results are exact."""
    rng = random.Random(bits)
    ids = sorted({rng.randrange(1 << bits) for _ in range(3000)})
    assert all(n <= 1 << 18 for n in window_groups(ids, levels))
    # The worst that ids of so many bits can do: full groups at every level.
    assert 1 << max(0, bits - 18 * levels) <= 1 << 18
    rows = [(i, 7 if k % 10 else k % 13, 1) for k, i in enumerate(ids)]
    out = with_ordinal(frame(spark, rows), seq="seq", key="k", id_bits=bits)
    assert {r["seq"]: r["ordinal"] for r in out.collect()} == expected(rows, False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [f"shiftright(__first" in plan and f", {18 * (i + 1)})" in plan for i in range(4)] == [i < levels for i in range(4)]
    out = with_ordinal(frame(spark, rows), seq="seq", id_bits=bits)
    assert [r["ordinal"] for r in out.orderBy("seq").collect()] == list(range(len(ids)))


def test_an_id_beyond_its_bits_is_an_error(spark):
    with pytest.raises(Exception, match="more than 20 bits"):
        with_ordinal(frame(spark, [(1 << 20, 1, 1)]), seq="seq", key="k", id_bits=20).collect()
