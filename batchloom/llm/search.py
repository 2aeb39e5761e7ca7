"""Ranked lexical search: best-first over intervals of documents, bounded by range maxima of posting lists.

A *shard* is a run of documents in order of their ids with the posting lists of the terms that are asked for. Each
posting has its impact, what its term adds to the score of its document. A sparse table over every list tells the largest
impact, and where it is, in any range of it in two look-ups, so the sum over a query's lists bounds the score of every
document in an interval. The interval of the highest bound is split at the document of its largest single impact; that
document is scored, and the halves go back to the frontier. The search ends when no bound reaches the
k-th best score, so the results are exact. Many intervals are split at a time, all lists at once.

Shards are built where the documents are read, written as Parquet, and searched there; statistics of the corpus are sums
over shards, so no text and no posting is shuffled. A task passes on k documents for each query, whatever the number of
its shards. Queries go out in blocks of BLOCK_BYTES of text, every query of a block against all shards.

Scores are 64-bit integers, so they don't depend on the order of addition. Null and empty texts have no terms and do not
count as documents. Rows without an id are left out, of the statistics too; each of several rows of one id is a document.
Rows of items with one id are one query, with the terms of all of them; items without an id or terms find nothing.
Equal scores come by ascending id. Empty tables give no rows. Other columns of either table don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from batchloom.llm.common import code_words, slices, starts_of
from batchloom.session import materialize

TOP = 10
#: Bytes of item texts that go to all tasks at once; documents and postings of a shard at most.
BLOCK_BYTES, SHARD_DOCS, SHARD_POSTINGS = 4 << 20, 1 << 16, 1 << 20
#: Intervals that are split at a time, at first and at most.
FIRST_SPLITS, MOST_SPLITS = 8, 1024

# Of ASCII, letters and digits are part of a term, and only A to Z have a lower case.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Terms of the texts: a code for each, the distinct ones, and how many each text has."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    plain = b"".join(x.as_buffer() for x in texts if x.is_valid).translate(_TERM_BYTES)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(plain))
    return code_words(clean)


class Shards:
    """Gathers documents and postings of a task and gives them out as rows of the index."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms
        self.clear()

    def clear(self) -> None:
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.size = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        codes, words, counts = term_words(texts)
        known = np.fromiter((self.terms.get(w, -1) for w in words.to_pylist()), np.int64, len(words))
        term = known[codes] if len(words) else codes
        doc, hit = np.repeat(np.arange(len(ids)), counts), term >= 0
        pair, times = np.unique(term[hit] * max(1, len(ids)) + doc[hit], return_counts=True)
        self.postings.append((pair // max(1, len(ids)), self.docs + pair % max(1, len(ids)), times))
        self.ids.append(ids)
        self.lengths.append(counts)
        self.docs += len(ids)
        self.size += len(pair)

    def full(self) -> bool:
        return self.docs >= SHARD_DOCS or self.size >= SHARD_POSTINGS

    def row(self) -> pa.RecordBatch:
        """Documents in order of their ids, postings by term, then document."""
        ids, lengths = pa.concat_arrays(self.ids), np.concatenate(self.lengths)
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, doc, times = (np.concatenate(x) for x in zip(*self.postings))
        doc = place[doc]
        by = np.lexsort((doc, term))
        own, sizes = np.unique(term, return_counts=True)
        packed = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (lengths[order], doc[by], times[by])]
        sorted_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        counted = [pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())])]
        lists = [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (own, sizes)]
        self.clear()
        return pa.RecordBatch.from_arrays([sorted_ids, *packed, *counted, *lists], names=["ids", "lengths", "docs", "times", "n", "total", "terms", "sizes"])


def build_index(df: DataFrame, doc_id: str, text: str, terms: dict[str, int]) -> DataFrame:
    """Shards of all documents with the posting lists of ``terms``, written to the shared folder."""
    kind = df.schema[doc_id].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(shared.value)
        for batch in batches:
            for piece in slices(batch, "t"):
                shards.add(piece.column(0), piece.column(1))
                if shards.full():
                    yield shards.row()
        if shards.docs:
            yield shards.row()

    chosen = df.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).where(F.col("d").isNotNull())
    schema = f"ids array<{kind}>, lengths binary, docs binary, times binary, n long, total long, terms array<int>, sizes array<int>"
    return materialize(chosen.mapInArrow(run, schema), "postings")


def statistics(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms with repeats, and documents that hold each term, over all shards."""
    total = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).head()
    lists = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    return total[0], total[1], {r["terms"]: r["df"] for r in lists.collect()}


def term_weights(documents: int, frequencies: dict[int, int], terms: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * frequencies.get(t, 0) + 1))) for t in range(terms)], dtype=np.int64)


class Shard:
    """Posting lists of a shard one after another, with impacts and the places of range maxima."""

    def __init__(self, row: dict, weights: np.ndarray, documents: int, total: int):
        self.lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        self.docs = np.frombuffer(row["docs"], np.int32).astype(np.int64)
        times = np.frombuffer(row["times"], np.int32).astype(np.int64)
        terms, sizes = np.array(row["terms"], np.int64), np.array(row["sizes"], np.int64)
        starts = starts_of(sizes)
        self.lists = {t: (a, a + n) for t, a, n in zip(terms.tolist(), starts.tolist(), sizes.tolist())}
        m = 100 - 90 + 90 * self.lengths * documents // max(1, total)
        self.impact = np.repeat(weights[terms], sizes) * (1_000_000_000 * times // (1000 * times + 8 * m[self.docs]))
        # A list's number and the document in one key, ascending over all lists.
        self.width = len(self.lengths) + 1
        self.number = {t: i for i, t in enumerate(terms.tolist())}
        self.key = np.repeat(np.arange(len(sizes)), sizes) * self.width + self.docs
        self.best = [np.arange(len(self.docs), dtype=np.int32)]
        for j in range(int(sizes.max()).bit_length() - 1 if len(sizes) else 0):
            a, b = self.best[j][: -(1 << j)], self.best[j][1 << j :]
            self.best.append(np.where(self.impact[a] >= self.impact[b], a, b))
        # Levels end at different places; one flat array with the start of each.
        self.level = starts_of(np.array([len(x) for x in self.best]))
        self.best = np.concatenate(self.best)

    def maxima(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact of every range [a, b) of postings and its place; 0 for an empty range."""
        size = b - a
        full = size > 0
        j = np.frexp(np.maximum(size, 1))[1] - 1
        at = self.level[j]
        x, y = self.best[at + np.where(full, a, 0)], self.best[at + np.where(full, b - (1 << j), 0)]
        u, v = self.impact[x], self.impact[y]
        return np.where(full, np.maximum(u, v), 0), np.where(u >= v, x, y)

    def search(self, terms: list[int], k: int, least: int = 1) -> list[tuple[int, int]]:
        """(score, document) of the best ``k`` of at least ``least``: highest first, then by document."""
        own = [t for t in terms if t in self.lists]
        if not own:
            return []
        base = np.array([self.number[t] for t in own], np.int64)[:, None] * self.width
        a, b = (np.array([self.lists[t][e] for t in own], np.int64)[:, None] for e in (0, 1))
        bound, split = self._bounds(a, b)
        top: list[tuple[int, int]] = []
        step = FIRST_SPLITS
        while True:
            open_ = bound >= max(least, 1)
            if not open_.all():
                a, b, bound, split = a[:, open_], b[:, open_], bound[open_], split[open_]
            if not len(bound):
                return top
            # The highest bounds are split, the others wait.
            order = np.argpartition(-bound, step - 1)[:step] if step < len(bound) else np.arange(len(bound))
            wait = np.ones(len(bound), bool)
            wait[order] = False
            left, right, doc = a[:, order], b[:, order], split[order]
            at = np.searchsorted(self.key, base + doc)
            there = (at < right) & (self.docs[np.minimum(at, len(self.docs) - 1)] == doc)
            score = np.where(there, self.impact[np.minimum(at, len(self.docs) - 1)], 0).sum(axis=0)
            good = score >= max(least, 1)
            top = sorted([*top, *zip(score[good].tolist(), doc[good].tolist())], key=lambda x: (-x[0], x[1]))[:k]
            if len(top) == k:
                least = max(least, top[-1][0])
            halves_a, halves_b = np.concatenate([left, at + there], axis=1), np.concatenate([at, right], axis=1)
            more, place = self._bounds(halves_a, halves_b)
            a, b = np.concatenate([a[:, wait], halves_a], axis=1), np.concatenate([b[:, wait], halves_b], axis=1)
            bound, split = np.concatenate([bound[wait], more]), np.concatenate([split[wait], place])
            step = min(2 * step, MOST_SPLITS)

    def _bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals given by a range of each list: the sum of maxima, and the document of the largest one."""
        value, place = self.maxima(a, b)
        which = value.argmax(axis=0)
        return value.sum(axis=0), self.docs[place[which, np.arange(a.shape[1])]]


def _item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    """Ids of items and their distinct terms, in blocks of about ``block_bytes`` of text by a hash of the id."""
    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    size = rows.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for block in range(n):
        part = rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == block).toArrow().combine_chunks()
        codes, words, counts = term_words(part.column("t").combine_chunks())
        names = words.to_pylist()
        terms: dict[object, set[str]] = {}
        for i, own in zip(part.column("i").to_pylist(), np.split(codes, np.cumsum(counts)[:-1])):
            terms.setdefault(i, set()).update(names[c] for c in np.unique(own).tolist())
        yield pa.array(list(terms), to_arrow_type(items.schema[item_id].dataType)), [sorted(x) for x in terms.values()]


def _searcher(ids: pa.Array, queries: list[list[int]], weights: np.ndarray, documents: int, total: int, top: int, names: list[str]) -> Callable:
    """What a task does with its shards: the best of all of them for every query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple[int, object]]] = [[] for _ in queries]
        kind = None
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                kind = one.column(0).type.value_type
                shard = Shard(one.drop_columns(["ids"]).to_pylist()[0], weights, documents, total)
                own = one.column(0).flatten()
                for q, terms in enumerate(queries):
                    best = found[q]
                    # Shards share no order of ids: an equal score may still win.
                    hits = shard.search(terms, top, best[-1][0] if len(best) == top else 1)
                    if hits:
                        best += [(s, own[d].as_py()) for s, d in hits]
                        best.sort(key=lambda x: (-x[0], x[1]))
                        del best[top:]
        if kind is not None:
            sizes = np.array([len(x) for x in found], np.int64)
            which = pa.array(np.repeat(np.arange(len(found)), sizes))
            made = [pa.array([x[e] for best in found for x in best], t) for e, t in ((1, kind), (0, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids.take(which), *made], names=names)

    return run


def search(
    df: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, top: int = TOP, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(``item_id``, rank, ``doc_id``, score) of the ``top`` highest-scoring documents above 0 of every item."""
    if doc_id == item_id:
        raise ValueError("the ids of documents and items need different names")
    kinds = [items.schema[item_id].dataType.simpleString(), df.schema[doc_id].dataType.simpleString()]
    schema = f"`{item_id}` {kinds[0]}, `{doc_id}` {kinds[1]}, score long"
    found = df.sparkSession.createDataFrame([], schema)
    for ids, words in _item_blocks(items, item_id, item_text, block_bytes):
        terms = {w: i for i, w in enumerate(sorted({w for own in words for w in own}))}
        if not terms:
            continue
        index = build_index(df, doc_id, text, terms)
        documents, total, frequencies = statistics(index)
        weights = term_weights(documents, frequencies, len(terms))
        # A term without weight adds nothing to any score.
        queries = [[terms[w] for w in own if weights[terms[w]] > 0] for own in words]
        run = _searcher(ids, queries, weights, documents, total, top, [item_id, doc_id, "score"])
        found = found.unionAll(index.select("ids", "lengths", "docs", "times", "terms", "sizes").mapInArrow(run, schema))
    by = Window.partitionBy(F.col(f"`{item_id}`")).orderBy(F.desc("score"), F.col(f"`{doc_id}`"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.select(F.col(f"`{item_id}`"), "rank", F.col(f"`{doc_id}`"), "score")
