"""Reading and merging tokenized sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: what a tokenized set is called, beside the folder it was made from.
TOKEN_SUFFIX = ".tokens.parquet"


def read_token_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_token_sets(*sets: DataFrame) -> DataFrame:
    """Records of all sets, in the order given, under new ids.

    Ids of a set are moved behind those of the sets before it: order and uniqueness hold, and no
    record is shuffled or numbered again. The offsets, a row for each set given here, are sent along.
    """
    if not sets:
        raise ValueError("give at least one tokenized set")
    columns = sets[0].columns
    for tokens in sets:
        if set(tokens.columns) != set(columns):
            raise ValueError(f"sets have different columns: {columns} and {tokens.columns}")
    named = reduce(DataFrame.unionByName, (t.select(*columns, F.lit(i).alias("__set")) for i, t in enumerate(sets)))
    return _moved(named).select(*columns)


def _moved(named: DataFrame) -> DataFrame:
    """Records of sets named in ``__set``, with their ids behind those of the sets before."""
    sizes = named.groupBy("__set").agg((F.max("seq_id") + 1).cast("bigint").alias("__n"))
    before = Window.orderBy("__set").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__set", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return named.join(F.broadcast(offsets), "__set").withColumn("seq_id", F.col("seq_id") + F.col("__offset"))


def read_token_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All tokenized sets directly in ``folder``, merged in the order of their names.

    One scan over all sets; the highest id of each comes from one aggregate over the id column, and
    the offsets of the sets, a row for each, are sent along. Sets with other columns are an error.
    """
    paths = f"{folder.rstrip('/')}/*{TOKEN_SUFFIX}"
    tokens = spark.read.parquet(paths)
    merged = spark.read.option("mergeSchema", "true").parquet(paths)
    if sorted(merged.dtypes) != sorted(tokens.dtypes):
        raise ValueError(f"sets have different columns: {tokens.dtypes} and {merged.dtypes}")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*" + TOKEN_SUFFIX.replace(".", r"\.") + ")/[^/]*$", 1)
    columns = tokens.columns
    named = tokens.select(*columns, name.alias("__set"))
    present = [
        F.coalesce(F.col(c), F.raise_error(F.lit(f"a set has no {c}")).cast(t)).alias(c) for c, t in tokens.dtypes if c != "seq_id"
    ]
    return _moved(named).select("seq_id", *present).select(*columns)
