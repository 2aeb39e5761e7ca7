"""File discovery: which files of a folder a job reads."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NameFilter:
    """A condition on the file name (not on the folders): one of four kinds, or none.

    ``suffix`` is compared as text, without a dot: ``json`` also accepts ``adjson``. ``regex`` is
    anchored at the start only.
    """

    suffix: str | None = None
    prefix: str | None = None
    contains: str | None = None
    regex: str | None = None

    def __post_init__(self) -> None:
        if sum(v is not None for v in (self.suffix, self.prefix, self.contains, self.regex)) > 1:
            raise ValueError("give one condition on the file name")

    def glob(self) -> str | None:
        """The condition as a glob the listing applies; a regular expression has none."""
        if self.suffix is not None:
            return "*" + _literal_glob(self.suffix)
        if self.prefix is not None:
            return _literal_glob(self.prefix) + "*"
        if self.contains is not None:
            return "*" + _literal_glob(self.contains) + "*"
        return None

    def condition(self, name: Column) -> Column:
        if self.suffix is not None:
            return name.endswith(self.suffix)
        if self.prefix is not None:
            return name.startswith(self.prefix)
        if self.contains is not None:
            return name.contains(self.contains)
        if self.regex is not None:
            return name.rlike(f"^(?:{self.regex})")
        return F.lit(True)


ANY_NAME = NameFilter()


def _literal_glob(text: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", text)


def folder_reader(spark: SparkSession, names: NameFilter = ANY_NAME, recursive: bool = True) -> DataFrameReader:
    """A reader that lists a folder, recursively by default, and applies the name filter there."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    glob = names.glob()
    return reader.option("pathGlobFilter", glob) if glob else reader


def matching(df: DataFrame, names: NameFilter) -> DataFrame:
    """Rows of files that match. Needed for regular expressions only; Spark prunes by it."""
    return df.where(names.condition(F.col("_metadata.file_name"))) if names.regex is not None else df


def list_files(
    spark: SparkSession, folder: str, names: NameFilter = ANY_NAME, recursive: bool = True
) -> DataFrame:
    """(path, name, relative_path, length) of the files. Contents are not read.

    A missing folder is an error. Names that begin with ``_`` or ``.`` are not listed by Spark.
    """
    files = folder_reader(spark, names, recursive).format("binaryFile").load(folder)
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    if names.regex is not None:
        files = files.where(names.condition(F.col("name")))
    return files.select("path", "name", relative_path(F.col("path"), folder).alias("relative_path"), "length")


def relative_path(path: Column, folder: str) -> Column:
    """The part of ``path`` below ``folder``. Paths come back with a scheme, folders often without."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).rstrip("/") + "/"
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")
    return F.when(plain.startswith(root), F.substring(plain, len(root) + 1, 1 << 30)).otherwise(plain)


def mirror_paths(
    spark: SparkSession,
    folder: str,
    mirror: str,
    names: NameFilter = ANY_NAME,
    recursive: bool = True,
) -> DataFrame:
    """``list_files`` plus ``mirror_path``: the same relative path under ``mirror``."""
    files = list_files(spark, folder, names, recursive)
    return files.withColumn(
        "mirror_path", F.concat(F.lit(mirror.rstrip("/") + "/"), F.col("relative_path"))
    )
