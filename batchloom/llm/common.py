"""Helpers the corpus operators share: batches of text in tasks, ragged arrays, folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.session import materialize

#: Bytes of text that a task works on at a time; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, read by exact name, whatever else ``df`` carries."""
    return df.select(*(F.col(f"`{name}`") for name in names))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    return stem if stem not in df.columns else f"{stem}_{uuid.uuid4().hex[:8]}"


def crc_fold(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of ``batch`` of about ``limit`` bytes of text each; null texts become empty."""
    at = batch.schema.get_field_index(text)
    texts = batch.column(at).fill_null("")
    batch = batch.set_column(at, text, texts)
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


Work = Callable[[pa.RecordBatch], pa.RecordBatch]


def map_texts(df: DataFrame, text: str, make: Callable[[], Work], schema: str) -> DataFrame:
    """What ``make()`` returns, called once in a task, on every slice of texts that the task reads."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in slices(batch, text):
                yield work(piece)

    return df.mapInArrow(run, schema)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Start of every part of a flat array whose parts have these lengths."""
    return np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)


def sums_of(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of every part (0 for empty ones); ``values`` may have columns."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.result_type(values, np.int64))
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def gather(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions offset, offset + 1, ... of every part, one after another."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(offsets - starts_of(lengths), lengths)


def code_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space: a code for each, the distinct words, words in each text."""
    parts = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        counts = sums_of(full.astype(np.int64), counts)
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, counts


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finisher of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(s) for s in strings.to_pylist()), np.uint64, len(strings))


def sample_rows(df: DataFrame, key: str, group: str, size: int) -> Column:
    """A condition that about ``size`` rows of each group meet, chosen by a hash of ``key``.

    One pass over the two columns counts the groups; where a group is not larger, all its rows are in.
    """
    counts = df.groupBy(F.col(f"`{group}`").alias("g")).count().toArrow().to_pylist()
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col(f"`{group}`") == row["g"], min(1.0, size / row["count"])).otherwise(share)
    return (F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(1 << 20)) / float(1 << 20)) < share


def labelled_sample(
    documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, size: int
) -> tuple[DataFrame, dict[int, int]]:
    """(key, label, text) of about ``size`` documents of each label, and how many labels there are of each.

    The keys are chosen among the labels alone. Their number is bounded by ``size``, so they are sent to
    the tasks that read the documents: no text moves, and what is found is written once.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("long").alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("key").isNotNull())
    chosen = known.where(sample_rows(known, "key", "label", size))
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    docs = documents.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sample = materialize(docs.join(F.broadcast(chosen), "key").select("key", "label", "text"), "sample")
    return sample, counts
