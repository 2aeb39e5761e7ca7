"""Record readers: JSON lines, JSON arrays, whole text files, Parquet and keyed JSON objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.functions.text import unix_newlines
from batchloom.operators.prepare import project_fields
from batchloom.session import materialize
from batchloom.sources.files import ANY_NAME, NameFilter, folder_reader, matching
from batchloom.sources.json_index import only_one, read_json_pieces
from batchloom.spec import DatasetSpec

# JSON texts that count as no record, besides zero in its spellings.
EMPTY_JSON = ("{}", "[]", "null", '""', "false")
ZERO_JSON = r"^-?0(\.0*)?([eE][+-]?[0-9]+)?$"


# JSON line files by name; and with the part files Spark writes JSON lines to, for who asks for them.
JSONL_NAMES = NameFilter(suffix="jsonl")
JSONL_OR_PARTS = NameFilter(regex=r".*jsonl$|part-.*\.json$")

# Fixed value: the longest string that Spark's variant parser takes, in characters.
VARIANT_STRING = 20_000_000

# Where a row comes from: file, split and place in the split, as a scan gives them.
POSITION = ("__path", "__block", "__row")


def _is_empty(parsed: Column) -> Column:
    text = F.to_json(parsed)
    return text.isin(*EMPTY_JSON) | text.rlike(ZERO_JSON)


def parse_json_lines(
    lines: DataFrame, fields: Sequence[str], value: str = "value", observation: Observation | None = None
) -> DataFrame:
    """Fields of one JSON object per line, row-local.

    Lines that are not JSON are dropped and counted, and so are empty values such as ``{}`` or
    ``null``. ``observation`` receives the counts ``lines``, ``undecodable`` and ``empty``. Fields
    that are not strings come as their JSON text; absent ones as null. Objects with strings that are
    too long for the first parser are read by one without that limit, so that no line is lost by size.
    """
    others = [c for c in lines.columns if c != value]
    parsed = lines.select(*others, value, F.try_parse_json(value).alias("__json"))
    schema = ", ".join([*(f"`{field}` STRING" for field in fields), "__bad STRING"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "maxStringLen": str(2**31 - 1)}
    refused = F.col("__json").isNull() & (F.octet_length(value) > VARIANT_STRING)
    parsed = parsed.withColumn("__long", F.when(refused, F.from_json(value, schema, options)))
    long = F.col("__long").isNotNull() & F.col("__long.__bad").isNull()
    if observation is not None:
        parsed = parsed.observe(
            observation,
            F.count(F.lit(1)).alias("lines"),
            F.count_if(F.col("__json").isNull() & ~long).alias("undecodable"),
            F.count_if(F.col("__json").isNotNull() & _is_empty(F.col("__json"))).alias("empty"),
        )
    kept = parsed.where(long | (F.col("__json").isNotNull() & ~_is_empty(F.col("__json"))))
    return kept.select(
        *others,
        *(
            F.coalesce(F.try_variant_get("__json", f"$['{field}']", "string"), F.col("__long")[field]).alias(field)
            for field in fields
        ),
    )


def read_jsonl(
    spark: SparkSession,
    folder: str,
    fields: Sequence[str],
    names: NameFilter = JSONL_NAMES,
    recursive: bool = True,
    observation: Observation | None = None,
) -> DataFrame:
    lines = matching(folder_reader(spark, names, recursive).text(folder), names)
    return parse_json_lines(lines.select("value"), fields, observation=observation)


def positioned(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of a scan with the POSITION of every row."""
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return rows.select(
        *columns, path.alias(POSITION[0]), block.alias(POSITION[1]), F.monotonically_increasing_id().alias(POSITION[2])
    )


def number_positions(records: DataFrame, rows: DataFrame) -> DataFrame:
    """``records`` with ``seq_id`` instead of their POSITION: the number of the row in the input.

    ``rows`` are all rows of the scan, so ids have gaps where rows were dropped. Files come in the order
    of their paths, and rows in the order of their file, however the files are split, packed and read.
    Rows are counted by split first; one pass over the records follows, in which none of them moves if
    the table of splits is small enough for Spark to send it along.
    """
    path, block, row = POSITION
    splits = materialize(rows.groupBy(path, block).agg(F.count(F.lit(1)).alias("__n"), F.min(row).alias("__first")), "splits")

    def sums(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    # One row for a file in the only window without a key.
    files = splits.groupBy(path).agg(F.sum("__n").alias("__rows"))
    bases = files.select(path, sums("__rows", Window.orderBy(path).rowsBetween(Window.unboundedPreceding, -1)).alias("__base"))
    inner = Window.partitionBy(path).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    places = splits.withColumn("__before", sums("__n", inner)).join(bases, path)
    place = F.col(row) - F.col("__first")
    moved = F.raise_error(F.lit("the files were split in another way while they were numbered")).cast("bigint")
    seq = F.when((place >= 0) & (place < F.col("__n")), F.col("__base") + F.col("__before") + place).otherwise(moved)
    others = [c for c in records.columns if c not in POSITION]
    return records.join(places, [path, block]).select(seq.alias("seq_id"), *others)


def read_json_arrays(
    spark: SparkSession,
    folder: str,
    fields: Sequence[str],
    names: NameFilter = NameFilter(suffix="json"),
    recursive: bool = True,
) -> DataFrame:
    """Files that hold one JSON array of records each, or one record. Nothing is skipped: bad JSON aborts.

    A file is read in as many tasks as it has splits (``json_index``).
    """
    return numbered_json(spark, folder, fields, names, recursive).select(*fields)


def numbered_json(
    spark: SparkSession, folder: str, fields: Sequence[str], names: NameFilter, recursive: bool = True
) -> DataFrame:
    """``read_json_arrays`` with ``seq_id``, the number of the record in the files in order of their paths."""
    pieces = read_json_pieces(spark, folder, names, "[{", recursive)
    struct = ", ".join(f"`{f}`: STRING" for f in fields)
    records = only_one(F.from_json("piece", f"ARRAY<STRUCT<{struct}>>", {"mode": "FAILFAST"}), "record")
    nothing = F.raise_error(F.lit("bad JSON: a record is null"))
    record = pieces.select(F.col("number").alias("seq_id"), records[0].alias("__record"))
    return record.select("seq_id", *(F.when(F.col("__record").isNull(), nothing).otherwise(F.col("__record")[f]).alias(f) for f in fields))


def read_strict_jsonl(
    spark: SparkSession, folder: str, fields: Sequence[str], names: NameFilter = ANY_NAME, recursive: bool = True
) -> DataFrame:
    """JSON lines where every line must be a record: bad JSON aborts."""
    schema = ", ".join(f"`{f}` STRING" for f in fields)
    reader = folder_reader(spark, names, recursive).schema(schema).option("mode", "FAILFAST")
    return matching(reader.json(folder), names).select(*fields)


def read_texts(
    spark: SparkSession,
    folder: str,
    names: NameFilter = NameFilter(suffix="txt"),
    recursive: bool = True,
    with_path: bool = False,
) -> DataFrame:
    """One record per file: (content) and, if asked for, (path). Newlines are made Unix ones."""
    files = matching(folder_reader(spark, names, recursive).text(folder, wholetext=True), names)
    path = [F.col("_metadata.file_path").alias("path")] if with_path else []
    return files.select(*path, unix_newlines(F.col("value")).alias("content"))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """A table, or some columns of it."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def read_keyed_json(
    spark: SparkSession, folder: str, fields: Sequence[str], names: NameFilter = NameFilter(suffix="json")
) -> DataFrame:
    """Files that hold one JSON object ``id -> record`` each: (record_id, field…). Bad JSON aborts.

    A file is read in as many tasks as it has splits (``json_index``).
    """
    struct = ", ".join(f"`{f}`: STRING" for f in fields)
    pieces = read_json_pieces(spark, folder, names, "{")
    objects = F.from_json("piece", f"MAP<STRING, STRUCT<{struct}>>", {"mode": "FAILFAST"})
    entries = pieces.select(F.explode(only_one(objects, "entry")).alias("record_id", "__record"))
    return entries.select("record_id", *(F.col("__record")[f].alias(f) for f in fields))


def read_dataset(
    spark: SparkSession,
    spec: DatasetSpec,
    observation: Observation | None = None,
    names: NameFilter | None = None,
    numbered: bool = False,
) -> DataFrame:
    """The fields of a file dataset, by its format. Every record must have all of them.

    Files are those whose name ends with the format, unless ``names`` says otherwise. ``numbered``
    adds ``seq_id``, the position in the files in the order of their paths (``number_positions``).
    """
    if spec.file_format is None:
        raise ValueError("this spec describes no files")
    names = names or NameFilter(suffix=spec.file_format)
    fields, reader = list(spec.field_names), folder_reader(spark, names)
    if spec.file_format == "jsonl":
        rows = positioned(matching(reader.text(spec.folder_path), names), "value")
        records = parse_json_lines(rows, fields, observation=observation)
    elif spec.file_format == "json":
        records = numbered_json(spark, spec.folder_path, fields, names)
        return project_fields(records, fields, keep=("seq_id",) if numbered else ())
    else:
        rows = positioned(matching(reader.text(spec.folder_path, wholetext=True), names), "value")
        records = rows.withColumn("content", unix_newlines(F.col("value")))
    if not numbered:
        return project_fields(records, fields, keep=())
    return number_positions(project_fields(records, fields, keep=POSITION), rows)


def number_records(records: DataFrame) -> DataFrame:
    """Give every record of any DataFrame a ``seq_id`` once, and write the result so that it never changes.

    Ids rise in the order in which this run reads the records. Where they shall follow the files,
    whatever the cluster, use ``read_dataset(…, numbered=True)``.
    """
    if "seq_id" in records.columns:
        raise ValueError("the records have a seq_id already")
    numbered = records.select(F.monotonically_increasing_id().alias("seq_id"), "*")
    return materialize(numbered, "records")
