"""Bloom sketches of hashes, merged over tasks and sent to all of them as rows of bits.

A hash has a chunk and two cells in it. Tasks count the cells of what they read, up to 2; the partial counts are merged
by chunk; a row of the sketch says which cells of a chunk were counted ``least`` times. With ``least`` 2 it is a
counting Bloom filter: a hash with a cell that was counted once is in no other row. With 1 it is a set: a hash with a cell
that was never counted is not in it. CELLS cells for every row and MAX_CHUNKS chunks (64 MB) at most: beyond 33
million rows the cells fill up, and more hashes pass that need not. None is ever lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.session import materialize

#: Cells for each row, cells of a chunk (a row of the sketch), and the most chunks.
CELLS, CHUNK, MAX_CHUNKS = 16, 1 << 13, 1 << 16
#: Cells that a task gathers before it passes their counts on.
BATCH_CELLS = 1 << 21


def _cells(h: Column, chunks: int) -> tuple[Column, Column, Column]:
    """The chunk of a hash and its two cells in it."""
    place = F.pmod(F.shiftrightunsigned(h, 26), F.lit(chunks)).cast("int")
    return place, h.bitwiseAND(CHUNK - 1).cast("int"), F.shiftrightunsigned(h, 13).bitwiseAND(CHUNK - 1).cast("int")


def _partial_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, cells that were met, cells that were met twice) of what a task has read, as 16-bit numbers."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        cell, times = np.unique(np.concatenate(held), return_counts=True)
        chunk, first = np.unique(cell // CHUNK, return_index=True)
        parts = [x.astype(np.uint16) for x in np.split(cell % CHUNK, first[1:])]
        twice = [p[t >= 2] for p, t in zip(parts, np.split(times, first[1:]))]
        binary = [pa.array([x.tobytes() for x in y], pa.binary()) for y in (parts, twice)]
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), *binary], names=["chunk", "once", "twice"])

    for batch in batches:
        chunk, a, b = (c.to_numpy().astype(np.int64) for c in batch.columns)
        held += [chunk * CHUNK + a, (chunk * CHUNK + b)[a != b]]
        if sum(map(len, held)) >= BATCH_CELLS:
            yield flush()
            held.clear()
    if sum(map(len, held)):
        yield flush()


def _merger(least: int):
    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial counts in order of chunks as one row of bits for each: was a cell met ``least`` times?"""
        now, counts = None, np.zeros(CHUNK, np.uint8)

        def row() -> pa.RecordBatch:
            words = np.packbits(counts >= least, bitorder="little").view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([words], pa.list_(pa.int64()))], names=["chunk", "bits"])

        for batch in batches:
            for chunk, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now:
                    if now is not None:
                        yield row()
                    now, counts = chunk, np.zeros(CHUNK, np.uint8)
                for cells in (once, twice):
                    at = np.frombuffer(cells, np.uint16)
                    counts[at] = np.minimum(counts[at] + 1, 2)
        if now is not None:
            yield row()

    return merge


def sketch(hashes: DataFrame, h: str, rows: int, least: int) -> tuple[DataFrame, int]:
    """The merged sketch of these hashes (of ``rows`` rows), (chunk, bits), and its number of chunks."""
    chunks = min(MAX_CHUNKS, max(1, -(-rows * CELLS // CHUNK)))
    partial = hashes.select(*_cells(F.col(h), chunks)).mapInArrow(_partial_counts, "chunk int, once binary, twice binary")
    merged = partial.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merger(least), "chunk int, bits array<bigint>")
    return materialize(merged, "sketch"), chunks


def with_maybe(df: DataFrame, h: str, merged: DataFrame, chunks: int) -> DataFrame:
    """``df`` with ``maybe``: false if a cell of the hash was not counted so often."""
    chunk, a, b = _cells(F.col(h), chunks)
    bits = F.broadcast(merged.select(F.col("chunk").alias("sketch chunk"), F.col("bits").alias("sketch bits")))
    met = lambda cell: F.getbit(F.col("sketch bits")[F.shiftright(cell, 6)], cell.bitwiseAND(63)) == 1
    return df.join(bits, chunk == F.col("sketch chunk"), "left").withColumn("maybe", F.coalesce(met(a) & met(b), F.lit(False))).drop("sketch chunk", "sketch bits")
