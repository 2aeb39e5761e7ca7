"""Several tables written as one version: a manifest comes last, and readers see what it names or nothing.

A version is a folder for each table, under names of their own, and a numbered JSON file in ``_manifests`` that lists
them with their rows, files and bytes. It is made in one piece by the file system that Spark writes to, and only if it does
not exist. What a job leaves that ends before that is refused by name, and cleared away by the next version. A new
version replaces the last one, whose folders go when it stands: one writer at a time, and readers that open the set anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_manifests"


class _Files:
    """The file system of a path, as Spark's Hadoop configuration names it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.files = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        if not self.files.exists(self.path(name)):
            return []
        return [status.getPath().getName() for status in self.files.listStatus(self.path(name))]

    def text(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; one that exists is an error."""
        stream = self.files.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def size(self, name: str) -> tuple[int, int]:
        """Files and bytes below a folder."""
        summary = self.files.getContentSummary(self.path(name))
        return summary.getFileCount(), summary.getLength()

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)


@dataclass(frozen=True)
class Part:
    """A table of a version: its folder, and what must be in it."""

    folder: str
    rows: int
    files: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    path: str
    version: int
    parts: dict[str, Part]
    about: dict = field(default_factory=dict)

    def part_path(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{self.parts[name].folder}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.part_path(name))


def _versions(files: _Files) -> list[tuple[int, str]]:
    names = (n.removesuffix(".json") for n in files.names(MANIFESTS) if n.endswith(".json"))
    return sorted(((int(n), f"{MANIFESTS}/{n}.json") for n in names if n.isdigit()), reverse=True)


def find_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The last version at ``path``, or None. A manifest that was cut off does not count."""
    files = _Files(spark, path)
    for version, name in _versions(files):
        try:
            stored = json.loads(files.text(name))
        except ValueError:
            continue
        return Manifest(path, version, {n: Part(**p) for n, p in stored["parts"].items()}, stored["about"])
    return None


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The last version at ``path``, with all its files in place; anything else is an error that names what is missing."""
    manifest, files = find_manifest(spark, path), _Files(spark, path)
    if manifest is None:
        left = sorted(n for n in files.names("") if n != MANIFESTS)
        if not files.files.exists(files.path("")):
            raise FileNotFoundError(f"there is nothing at {path}")
        raise ValueError(f"{path} has no finished version; a write was interrupted and left {left}")
    for name, part in manifest.parts.items():
        there = files.size(part.folder) if files.files.exists(files.path(part.folder)) else (0, 0)
        if there != (part.files, part.bytes):
            raise ValueError(f"{path}: {name} has {there} files and bytes, version {manifest.version} wrote {(part.files, part.bytes)}")
    return manifest


class VersionWriter:
    """Writes the tables of a version one after another; ``commit`` makes them the version at ``path``."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "errorifexists"):
        if mode not in ("errorifexists", "error", "overwrite"):
            raise ValueError(f"unknown mode {mode!r}: a version is new or replaces the last one")
        before = find_manifest(spark, path)
        if before is not None and mode != "overwrite":
            raise FileExistsError(f"{path} has version {before.version} already")
        self.spark, self.path, self.parts = spark, path.rstrip("/"), {}
        self._files = _Files(spark, path)
        self._next = max((v for v, _ in _versions(self._files)), default=0) + 1

    def write(self, name: str, df: DataFrame, save: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
        """Write a table and give it back as it is stored. ``save`` writes a DataFrame to a path, by default as Parquet."""
        folder, seen = f"{name}-{uuid.uuid4().hex}", Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        target = f"{self.path}/{folder}"
        if save is None:
            counted.write.parquet(target)
        else:
            save(counted, target)
        files, size = self._files.size(folder)
        self.parts[name] = Part(folder, seen.get["rows"], files, size)
        return self.spark.read.parquet(target)

    def commit(self, about: dict | None = None) -> Manifest:
        manifest = Manifest(self.path, self._next, dict(self.parts), about or {})
        text = json.dumps({"parts": {n: asdict(p) for n, p in manifest.parts.items()}, "about": manifest.about}, indent=1)
        self._files.create(f"{MANIFESTS}/{self._next:06d}.json", text)
        kept = {p.folder for p in manifest.parts.values()} | {MANIFESTS}
        for name in self._files.names(""):
            if name not in kept:
                self._files.delete(name)
        for version, name in _versions(self._files):
            if version < self._next:
                self._files.delete(name)
        return manifest
