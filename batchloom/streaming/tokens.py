"""JSON lines to a tokenized set as a stream: files that arrive are tokenized once, whatever stops in between.

Each micro-batch is written as a part of the set under its own number, and written again as a whole if the batch is
repeated after a failure. The stream's checkpoint says which files a batch has, so a stop and restart neither loses nor
repeats a record. Records of a batch are numbered by file and line, behind the ids of all batches before: batch
``n`` has the ids from ``n * 2^36`` on, so ids don't depend on when the others ran.

The set is read like any other: ``spark.read.parquet(path)``, with the number of the batch as ``batch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from batchloom.operators.prepare import project_fields
from batchloom.operators.tokenize import Tokenizer, tokenize
from batchloom.session import materialize
from batchloom.sinks.writers import write_token_set
from batchloom.sources.files import NameFilter
from batchloom.sources.records import JSONL_NAMES, POSITION, number_positions, parse_json_lines, positioned
from batchloom.spec import DatasetSpec

#: Bits of an id within its batch, and the batches that fit in front of them.
ROW_BITS, MOST_BATCHES = 36, 1 << 27


def stream_lines(spark: SparkSession, folder: str, names: NameFilter = JSONL_NAMES, files_at_once: int | None = None) -> DataFrame:
    """Lines of the files in ``folder`` as they arrive, with the file and split that they are from."""
    if names.regex is not None:
        raise ValueError("files of a stream are named by a suffix, a prefix or a part of the name")
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if names.glob():
        reader = reader.option("pathGlobFilter", names.glob())
    if files_at_once is not None:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return reader.load(folder).select("value", path.alias(POSITION[0]), block.alias(POSITION[1]))


def write_batch(lines: DataFrame, batch: int, spec: DatasetSpec, tokenizer: Tokenizer, path: str) -> None:
    """Tokenize the lines of a micro-batch and write them as part ``batch``, in place of what a failure may have left."""
    if batch >= MOST_BATCHES:
        raise ValueError(f"a stream has at most {MOST_BATCHES} batches")
    rows = lines.withColumn(POSITION[2], F.monotonically_increasing_id())
    records = parse_json_lines(rows, list(spec.field_names))
    numbered = number_positions(project_fields(records, spec.field_names, keep=POSITION), rows)
    own = F.when(F.col("seq_id") < (1 << ROW_BITS), F.col("seq_id") + (batch << ROW_BITS))
    beyond = F.raise_error(F.lit(f"a batch has more than 2^{ROW_BITS} lines")).cast("bigint")
    # Written once before it is tokenized: ids then stay with their records.
    records = materialize(numbered.withColumn("seq_id", own.otherwise(beyond)), "batch")
    write_token_set(tokenize(records, spec, tokenizer), f"{path.rstrip('/')}/batch={batch}", mode="overwrite")


def stream_token_set(
    spark: SparkSession,
    spec: DatasetSpec,
    tokenizer: Tokenizer,
    path: str,
    checkpoint: str,
    names: NameFilter = JSONL_NAMES,
    files_at_once: int | None = None,
    until_done: bool = False,
) -> StreamingQuery:
    """Start to tokenize the JSON lines in the folder of ``spec`` into the set at ``path``.

    ``until_done`` ends the stream when all files that are there have been read; a later call with the same
    ``checkpoint`` goes on behind them.
    """
    if spec.file_format != "jsonl" or spec.folder_path is None:
        raise ValueError("a stream reads the JSON lines of a folder")
    lines = stream_lines(spark, spec.folder_path, names, files_at_once)
    writer = lines.writeStream.option("checkpointLocation", checkpoint)
    if until_done:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(lambda rows, batch: write_batch(rows, batch, spec, tokenizer, path)).start()
