import pytest
from pyspark.sql import functions as F

from batchloom.operators import reports as R
from batchloom.plans import probe as B


def grid(spark, start=5000, end=18000, **knobs):
    return B.probe_grid(spark.createDataFrame([(start, end)], "start bigint, end bigint"), **knobs)


def test_probe_lengths():
    assert B.probe_lengths() == [320, 640, 1280, 2560, 5120, 10240, 20480, 40960, 81920]
    with pytest.raises(ValueError):
        B.probe_lengths(50, 20)


def test_probe_grid(spark):
    row = grid(spark).agg(
        F.count("*"), F.sum("n_records"), F.sum("param_count"), F.min("param_count"), F.max("param_count")
    )
    assert tuple(row.first()) == (69, 896, 796800, 5120, 17920)


def test_probe_order_is_stable(spark):
    rows = B.order_probes(grid(spark)).orderBy("plan_pos").collect()
    keys = [(r["param_count"], r["target"], r["seq_len"]) for r in rows]
    assert keys == sorted(keys) and [r["plan_pos"] for r in rows] == list(range(69))


def test_probe_rows(spark):
    rows = B.probe_rows(grid(spark, 5000, 7000), seed=5).collect()
    assert all(len(r["profile_content"]) == r["seq_len"] for r in rows)
    ids = [i for r in rows for i in r["profile_content"]]
    assert min(ids) == 0 and max(ids) == 99 and len(set(ids)) == 100


def test_probe_summary(spark):
    row = B.probe_summary(grid(spark)).where("param_count = 5120 and seq_len = 320").first()
    assert row["summary"] == "  5120:   16 *  320"
    assert grid(spark, 10, 10).collect() == []


def test_steps_over_ranks(spark):
    log = spark.createDataFrame(
        [(0, 0, 2, 1.0, 2.0, 10.0), (0, 0, 4, 3.0, 4.0, 30.0), (0, 1, 1, 1.0, 1.0, 5.0)],
        "epoch int, step bigint, batch_size int, normalized_loss double, step_time double, tflops double",
    )
    rows = R.step_metrics(log, batch_per_device=3).orderBy("step").collect()
    assert tuple(rows[0]) == (0, 0, 6, 2.0, 3.0, 2.0, 20.0)
    assert tuple(rows[1]) == (0, 1, 1, 3.0, 1.0, 1.0, 5.0)
    numbers = R.with_global_step(log.withColumn("epoch", F.lit(2)), 10).select("global_step").collect()
    assert sorted(r[0] for r in numbers) == [20, 20, 21]


def test_throughput(spark):
    args = (F.lit(8), F.lit(100), F.lit(2.0))
    row = spark.range(1).select(R.throughput(0.03, *args), R.throughput(0.03, *args, recompute=True)).first()
    assert row[0] == pytest.approx(12.0) and row[1] == pytest.approx(16.0)


def test_memory(spark):
    samples = spark.createDataFrame(
        [(1, 0, 6.0, 2.0), (1, 1, 6.0, 6.0)], "t int, device int, used double, free double"
    )
    assert tuple(R.memory_utilisation(samples, "t").first()) == (1, 12.0, 0.6)
    long = R.device_scalars(samples, "t").orderBy("tag").collect()
    assert [tuple(r) for r in long] == [
        (1, "gpu0_free", 2.0),
        (1, "gpu0_used", 6.0),
        (1, "gpu1_free", 6.0),
        (1, "gpu1_used", 6.0),
    ]


def test_run_summary(spark):
    rows = [("tflops (mean)", 2.0), ("tflops (mean)", 4.0), ("time (mean)", 1.0), ("time (mean)", 2.0), ("x", 9.0)]
    scalars = spark.createDataFrame(rows, "tag string, value double")
    assert tuple(R.run_summary(scalars).first()) == (3.0, 3.0, None)
    more = spark.createDataFrame([("gpu0_used", 3.0), ("gpu0_free", 1.0)], "tag string, value double")
    assert tuple(R.run_summary(scalars.union(more)).first()) == (3.0, 3.0, 0.75)


def test_capacity_pick(spark):
    log = spark.createDataFrame(
        [(2, 100, 5.0, 5.0), (4, 100, 9.0, 1.0), (8, 100, 10.0, 0.0)],
        "batch_size int, seq_len int, used double, free double",
    )
    assert R.pick_capacity(R.probe_log(log), 0.95).first()[0] == 400


def test_comparison(spark):
    schema = "dataset string, tflops double, memory_utilisation double, time double, loss double"
    base = spark.createDataFrame([("gsm8k", 49.53, 0.8819, 363.0, 0.431)], schema)
    other = spark.createDataFrame([("gsm8k", 62.55, 0.9302, 164.0, 0.658)], schema)
    row = R.compare_runs(base, other).first()
    assert [round(v, d) for v, d in zip(row[1:], (2, 2, 2, 3))] == [1.26, 4.83, 0.45, 0.227]
