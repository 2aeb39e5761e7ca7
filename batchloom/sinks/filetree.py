"""A sink for trees of files: a Python data source whose tasks write to a staging folder and whose commit renames.

A row is a file: ``relative_path`` and ``content``. Tasks write their files under names of their own and report them
in commit messages; when all have succeeded the driver's commit renames the reported files to their places and removes
the staging folder with all that attempts which failed have left. So a repeated task leaves one copy, and a job
that fails leaves nothing in the tree but perhaps staged files, in a folder that Spark's readers skip. Paths are URIs of any file system that Arrow knows (local, HDFS, S3, GCS); files of
another job at the same places are replaced.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from batchloom.sources.files import ANY_NAME, NameFilter, folder_reader, matching, relative_path

FORMAT = "file_tree"
SCHEMA = "relative_path string, content binary"


def open_tree(uri: str):
    """The Arrow file system of a URI, and the path in it."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task has written: name in the staging folder and place in the tree."""

    files: list[tuple[str, str]] = field(default_factory=list)


class FileTreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.job = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, base = open_tree(self.root)
        attempt, done = uuid.uuid4().hex, Staged()
        folder = f"{base}/{self.job}/{attempt}"
        for batch in iterator:
            for place, content in zip(batch.column("relative_path"), batch.column("content")):
                if not done.files:
                    files.create_dir(folder, recursive=True)
                name = f"{attempt}/{len(done.files)}"
                with files.open_output_stream(f"{base}/{self.job}/{name}") as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                done.files.append((name, _inside(place.as_py())))
        return done

    def commit(self, messages: list[Staged | None]) -> None:
        files, base = open_tree(self.root)
        staged = [x for m in messages if m is not None for x in m.files]
        for folder in sorted({posixpath.dirname(place) for _, place in staged}):
            files.create_dir(f"{base}/{folder}" if folder else base, recursive=True)
        for name, place in staged:
            files.move(f"{base}/{self.job}/{name}", f"{base}/{place}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, base = open_tree(self.root)
        if files.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{self.job}")


def _inside(place: str | None) -> str:
    """A relative path that stays below the root."""
    plain = posixpath.normpath(place or "")
    if not place or plain.startswith(("/", "..")) or plain == ".":
        raise ValueError(f"{place!r} is no place in the tree")
    return plain


class FileTreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FileTreeWriter:
        return FileTreeWriter(self.options["path"])


def write_files(files: DataFrame, root: str) -> None:
    """Write every row (``relative_path``, ``content``) as a file below ``root``."""
    files.sparkSession.dataSource.register(FileTreeSource)
    files.select("relative_path", "content").write.format(FORMAT).mode("append").save(root)


def mirror_files(
    spark: SparkSession,
    folder: str,
    mirror: str,
    function: Callable[[str, bytes], bytes | None],
    names: NameFilter = ANY_NAME,
    recursive: bool = True,
) -> None:
    """Write ``function(relative_path, content)`` of every file to the same place below ``mirror``.

    Contents come from Spark's file source, so nothing needs to be mounted and the function opens no file; None
    leaves a file out. A file must fit in a row. Files without a byte are not listed by Spark and get no copy.
    """
    source = matching(folder_reader(spark, names, recursive).format("binaryFile").load(folder), names)
    rows = source.select(relative_path(F.col("path"), folder).alias("relative_path"), "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column(0), batch.column(1)):
                made = function(place.as_py(), content.as_py())
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([place.as_py()]), pa.array([made], pa.binary())], names=["relative_path", "content"])

    write_files(rows.mapInArrow(run, SCHEMA), mirror)
