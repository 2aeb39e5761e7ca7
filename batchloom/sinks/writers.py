"""Writers: JSON lines, tokenized sets, plans and padded training rows."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from batchloom.operators.lengths import field_length, record_length, token_fields
from batchloom.plans.policies import BatchPlan
from batchloom.session import scratch_path
from batchloom.sinks.commit import Manifest, VersionWriter, read_manifest
from batchloom.sources.tokensets import TOKEN_SUFFIX


def write_jsonl(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, UTF-8, characters as they are."""
    records.write.mode(mode).json(path)


def token_set_path(folder: str) -> str:
    """Where the tokenized set of a dataset folder goes: beside it, under its name."""
    folder = folder.rstrip("/")
    return posixpath.join(posixpath.dirname(folder), posixpath.basename(folder) + TOKEN_SUFFIX)


def write_token_set(
    tokens: DataFrame,
    path: str,
    mode: str = "errorifexists",
    table: str | None = None,
    buckets: int | None = None,
) -> None:
    """Tokens with the length of every field beside it, so that planning never reads ids.

    With ``table`` and ``buckets`` the set is also a table of the catalog, bucketed by id. Collating
    from that table moves only the plan to the tokens, which pays off when one set serves several
    plans.
    """
    lengths = {
        f"{f}_len": field_length(tokens, f) for f in token_fields(tokens) if f"{f}_len" not in tokens.columns
    }
    out = tokens.withColumns(lengths) if lengths else tokens
    if "total_len" not in out.columns:
        out = out.withColumn("total_len", record_length(out))
    if table is None:
        out.write.mode(mode).parquet(path)
        return
    if not buckets or buckets < 1:
        raise ValueError("a bucketed set needs the number of buckets")
    dealt = out.repartition(buckets, "seq_id")
    writer = dealt.write.mode(mode).bucketBy(buckets, "seq_id").sortBy("seq_id")
    writer.option("path", path).saveAsTable(table)


def plan_path(token_path: str, policy: str, knobs: dict) -> str:
    """A plan's folder beside its tokens; the name tells the policy and its knobs."""
    stem = token_path.rstrip("/").removesuffix(TOKEN_SUFFIX)
    parts = [f"{name}={value}" for name, value in sorted(knobs.items()) if value is not None]
    return ".".join([stem, policy, *parts, "plan"])


# Rows of an assignment or a batch table in a file: some 40 MB.
ROWS_PER_FILE = 1 << 22


def _clustered(writer: VersionWriter, name: str, df: DataFrame, rows: int, key: str, *then: str) -> DataFrame:
    """Write a table in ranges of ``key``, a file each, with a table of the ranges beside it.

    The next keys are part of the range, so one value of ``key`` may fill many files.
    """
    ranges = df.repartitionByRange(max(1, -(-rows // ROWS_PER_FILE)), key, *then).sortWithinPartitions(key, *then)
    stored = writer.write(name, ranges)
    path = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    index = stored.select(path, key).groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows"))
    writer.write(f"{name}_files", index.coalesce(1))
    return stored


def _write_plan_parts(writer: VersionWriter, plan: BatchPlan) -> dict:
    # Planned once: ranges and batches are made from the stored rows.
    spark = writer.spark
    path = scratch_path(spark, "plan")
    seen = Observation()
    plan.assignment.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    planned = spark.read.parquet(path)
    stored = plan.rebased(_clustered(writer, "assignment", planned, seen.get["rows"], "batch_id", "pos"))
    _clustered(writer, "batches", stored.batches, seen.get["rows"], "plan_pos")
    return {"policy": plan.policy, "knobs": plan.knobs}


def write_plan(plan: BatchPlan, path: str, mode: str = "errorifexists") -> None:
    """Assignment in ranges of batches and batch table in plan order, as one version with an index of their files.

    Planning runs once: both tables are made from its rows.
    """
    writer = VersionWriter(plan.assignment.sparkSession, path, mode)
    writer.commit(_write_plan_parts(writer, plan))


@dataclass(frozen=True)
class StoredPlan(BatchPlan):
    """A written plan. An item is read from the files that hold it, however many there are."""

    manifest: Manifest | None = None

    def ordered(self, order: str, seed: int = 0) -> BatchPlan:
        return BatchPlan(self.policy, self.knobs, self.assignment, self.batches).ordered(order, seed)

    def _rows(self, name: str, key: str, value: int) -> DataFrame:
        spark = self.assignment.sparkSession
        ranges = self.manifest.read(spark, f"{name}_files").where((F.col("first") <= value) & (F.col("last") >= value))
        files = [f"{self.manifest.part_path(name)}/{r['file']}" for r in ranges.select("file").collect()]
        if not files:
            return self.manifest.read(spark, name).where("false")
        return spark.read.parquet(*files).where(F.col(key) == value)

    def item(self, position: int) -> DataFrame:
        at = position if position >= 0 else position + self.manifest.parts["batches"].rows
        batch = self._rows("batches", "plan_pos", at).select("batch_id").first()
        rows = self._rows("assignment", "batch_id", -1 if batch is None else batch["batch_id"])
        return rows.select("batch_id", *(c for c in rows.columns if c != "batch_id"), F.lit(at).cast("bigint").alias("plan_pos"))


def _stored_plan(spark: SparkSession, manifest: Manifest) -> StoredPlan:
    about = manifest.about
    tables = (manifest.read(spark, part) for part in ("assignment", "batches"))
    return StoredPlan(about["policy"], about["knobs"], *tables, manifest)


def read_plan(spark: SparkSession, path: str) -> StoredPlan:
    """A written plan, which may be empty. One whose write was interrupted is refused."""
    return _stored_plan(spark, read_manifest(spark, path))


# The columns training rows are arranged by.
ARRANGED = ("rank", "micro_step", "pos")


def write_training_rows(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Padded rows by rank, each rank in the order of its steps.

    ``rows`` come from ``collate`` with ``partition_by=ARRANGED``, which sorts them while they are
    small; they are not sorted again here.
    """
    rows.write.mode(mode).partitionBy("rank").parquet(path)


def write_training_set(rows: DataFrame, plan: BatchPlan, path: str, mode: str = "errorifexists") -> None:
    """Training rows (``write_training_rows``) and the plan that they follow, as one version."""
    writer = VersionWriter(rows.sparkSession, path, mode)
    about = _write_plan_parts(writer, plan)
    writer.write("rows", rows, lambda df, target: write_training_rows(df, target))
    writer.commit(about)


def read_training_set(spark: SparkSession, path: str) -> tuple[DataFrame, StoredPlan]:
    """Training rows and their plan, of one version."""
    manifest = read_manifest(spark, path)
    return manifest.read(spark, "rows"), _stored_plan(spark, manifest)
