"""Processing a folder tree file by file into a mirrored one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from batchloom.sources.files import ANY_NAME, NameFilter, mirror_paths


def process_to_mirror(
    spark: SparkSession,
    folder: str,
    mirror: str,
    function: Callable[[str, str], None],
    names: NameFilter = ANY_NAME,
    recursive: bool = True,
) -> DataFrame:
    """Call ``function(source_path, mirror_path)`` for every file, in parallel.

    Parent folders are made first. Both trees must be mounted on every executor. A task that is
    repeated calls the function again for its files, so the function should overwrite its output.
    The result is (relative_path, mirror_path), and reading it does the work.
    """
    files = mirror_paths(spark, folder, mirror, names, recursive)

    def run(frames):
        for frame in frames:
            for source, target in zip(frame["path"], frame["mirror_path"]):
                target = _local(target)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                function(_local(source), target)
            yield frame[["relative_path", "mirror_path"]]

    paths = files.select("path", "relative_path", "mirror_path")
    return paths.mapInPandas(run, schema="relative_path string, mirror_path string")


def _local(path: str) -> str:
    """A ``file:`` path as the mounted path it stands for."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return path
