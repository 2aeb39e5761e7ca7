"""Wall time of the headline queries. Prints one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the local threads,
``BENCH_RUNS`` the runs per query (the fastest counts; the first one also warms up the JVM), and
``BENCH_SKEW_ROWS`` the rows of the skewed planning run (0 leaves it out).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import batchloom as bl  # noqa: E402
from batchloom.session import RECOMMENDED, materialize  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "prep_conversation_pairs",
    "tokenize_codepoint",
    "tokenize_vocabulary",
    "tokenize_user_object",
    "budget_sft",
    "smart_sort_rank",
    "plan_fixed",
    "plan_fixed_sorted",
    "plan_token_capacity",
    "plan_length_difference_documents",
    "plan_max_length",
    "plan_order_pc_desc",
    "collate_right",
    "collate_split_records",
    "collate_matrices",
    "shard_ranks",
    "merge_token_sets",
    "sink_training_rows",
    "dataset_profile",
    "padding_report",
    "step_metrics",
)
PER_DOCUMENT = ("tokenize_codepoint", "tokenize_vocabulary", "plan_token_capacity", "collate_split_records")
MAX_LEN = 4096


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def fastest(make: Callable[[], DataFrame], runs: int) -> float:
    times = []
    for _ in range(runs):
        started = time.perf_counter()
        run(make())
        times.append(time.perf_counter() - started)
    return min(times)


def skewed_lengths(spark: SparkSession, rows: int) -> DataFrame:
    """Nine records in ten have the maximum length, as after truncation."""
    other = 1 + F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(MAX_LEN))
    length = F.when(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(10)) > 0, MAX_LEN).otherwise(other)
    return spark.range(rows).select(F.col("id").alias("seq_id"), length.cast("int").alias("len"))


def laid_out(spark: SparkSession, folder: str, files: int) -> str:
    """A folder with the same tables, the documents in as many files as there are threads.

    The table comes in one row group, which is one task up to the first shuffle; tables of any size have many.
    """
    out = tempfile.mkdtemp(prefix="bench-tables-")
    for path in sorted(Path(folder).glob("*.parquet")):
        if path.stem != "documents":
            os.symlink(path, f"{out}/{path.name}")
    spark.read.parquet(f"{folder}/documents.parquet").repartition(files).write.parquet(f"{out}/documents.parquet")
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    skew_rows = int(os.environ.get("BENCH_SKEW_ROWS", "10000000"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for name, value in RECOMMENDED.items():
        builder = builder.config(name, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    started = time.perf_counter()
    tables = laid_out(spark, folder, int(cpus))
    layout = round(time.perf_counter() - started, 3)
    times = {name: round(fastest(lambda n=name: QUERIES[n](spark, tables), runs), 3) for name in HEADLINE}
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    extra: dict[str, object] = {
        "documents": documents,
        "documents_per_sec": {n: round(documents / times[n]) for n in PER_DOCUMENT},
    }
    if skew_rows:
        lengths = materialize(skewed_lengths(spark, skew_rows), "lengths")
        spark.conf.set("spark.sql.shuffle.partitions", str(8 * int(cpus)))
        took = fastest(lambda: bl.plan_capacity(lengths, 12_000).batches, 1)
        extra["plan_skewed"] = {
            "rows": skew_rows,
            "sec": round(took, 3),
            "records_per_sec": round(skew_rows / took),
        }
    print(
        json.dumps(
            {
                "metric": "token batch preparation, sum of headline queries and of laying out the documents",
                "value": round(layout + sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "layout": layout,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                **extra,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
