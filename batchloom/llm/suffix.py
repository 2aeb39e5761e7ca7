"""Removal of repeated byte strings by difference-cover suffix sorting, spread by content.

A byte goes if some string of ``length`` bytes that covers it also starts earlier: in a document of smaller
id, or in the same document further left. Strings are judged on the input and never cross documents.

One suffix array of a corpus would be sorted as a whole. Here the corpus is first cut so that no repeat
crosses a cut: every string (window) belongs to the least of the ``GRAM``-byte pieces in it, by hash, the
leftmost of equals. That depends on the string alone, so equal strings belong to equal pieces, and
neighbouring strings mostly share theirs: a *block* is a stretch of text whose windows belong to one
piece. Then

1. Blocks with equal bytes have equal windows throughout. All but the first such block are repeats as a
   whole: first among the texts a task reads, so that a text with very many copies sends one block for
   each task, then over all.
2. Pieces with one kind of block left are done: no window of theirs is in another place.
3. The other blocks are brought together by piece and their windows are compared exactly: tasks leave out
   the ends of blocks whose windows have hashes of their own, sort all suffixes of what is left by the
   difference-cover algorithm (sort the triples at two of three positions, recurse on their names, merge
   the remaining suffixes) and compare adjacent prefixes of ``length`` bytes. Of equal windows, all but
   the earliest are repeats.

The number of kinds of a common piece grows with the corpus. Equal windows are as far from their piece, so
blocks of pieces with many kinds are cut into runs of windows of about one distance, which are dealt out by the
bytes that all windows of a run hold, and of pieces with very many kinds into single windows. A run that is
alone, or equal to the first of its group, needs no sorting. Spans are gathered by document and applied to its text.

Texts are bytes of UTF-8; null texts are empty. Rows that repeat an id count as one document: the text
that is least as bytes stands for it. Null ids are documents before all others and get one row.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import gather, map_texts, mix64, slices, starts_of
from batchloom.session import materialize

LENGTH, GRAM = 100, 28
#: Blocks that a task holds before it drops those it has seen; bytes of blocks compared at a time, whose arrays
#: should stay in a core's cache.
HELD_BLOCKS, SORTED_BYTES = 1 << 19, 1 << 18
#: Bytes of text that are cut into blocks at a time; as many for the same reason.
SEGMENT = 1 << 18
#: Kinds of blocks of a piece above which its windows are dealt out in runs of RUN; one by one above HOTTEST times as many.
HOT_KINDS, RUN, HOTTEST = 2000, 8, 10
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
    """Integers in the order of the triples, whose parts have at most ``bits`` bits (31 at most)."""
    if bits <= 21:
        return (a << 42) | (b << 21) | c
    return (np.unique((a << 31) | b, return_inverse=True)[1] << 31) | c


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, for positive integers (difference cover modulo 3)."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), dtype=np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(4, np.int64)])
    # With a dummy where needed, every suffix at 0 modulo 3 is followed by a sampled one.
    end = n + (n % 3 == 1)
    ones, twos = np.arange(1, end, 3), np.arange(2, end, 3)
    sample = np.concatenate([ones, twos])
    bits = max(int(s.max()), n).bit_length()
    triple = _packed(s[sample], s[sample + 1], s[sample + 2], bits)
    distinct, name = np.unique(triple, return_inverse=True)
    if len(distinct) < len(sample):
        order = suffix_array(name + 1)
    else:
        order = np.argsort(name)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort((s[zeros] << 31) | rank[zeros + 1], kind="stable")]
    # Suffixes at 0 find their place among those at 1 and at 2 by keys that both have.
    first = sorted_sample[sorted_sample % 3 == 1]
    second = sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted((s[first] << 31) | rank[first + 1], (s[zeros] << 31) | rank[zeros + 1])
    both = np.concatenate([second, zeros])
    key = _packed(s[both], s[both + 1], rank[both + 2], bits)
    before = before + np.searchsorted(key[: len(second)], key[len(second) :])
    out = np.empty(n, dtype=np.int64)
    place = before + np.arange(len(zeros))
    out[place] = zeros
    rest = np.ones(n, dtype=bool)
    rest[place] = False
    out[rest] = sorted_sample
    return out


_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    bases = (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, base)), dtype=np.uint64) for base in bases)


def _range_hash(data: np.ndarray):
    """A function of starts and stops, or of slices of them, that hashes these ranges of ``data`` (64 bits, by content)."""
    power, back = _powers(1 << len(data).bit_length())
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * power[: len(data)], out=total[1:])
    return lambda a, b: mix64((total[b] - total[a]) * back[: len(total)][a])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values that stand side by side."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    extra = width - span
    return np.minimum(values[: len(values) - extra], values[extra:]) if extra else values


def blocks_of(data: np.ndarray, lengths: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Blocks of the texts that lie in ``data`` one after another: text, first and last window, piece,
    hash of the piece and hash of the block; positions count from the start of ``data``.
    """
    empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if len(data) < length:
        return empty
    hashed = _range_hash(data)
    spots = np.arange(len(data) - gram + 1, dtype=np.uint64)
    ranks = (hashed(slice(0, len(spots)), slice(gram, None)) & np.uint64(0xFFFFFFFF00000000)) | spots
    piece = (_least(ranks, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = starts_of(lengths)
    inside = gather(starts, np.maximum(lengths - length + 1, 0))
    if not len(inside):
        return empty
    own = piece[inside]
    text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - length + 1, 0))
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = inside[np.append(at[1:], len(inside)) - 1]
    first, own, text = inside[at], own[at], text[at]
    key = hashed(own, own + gram)
    # The distance of the piece is part of what a block is.
    kind = mix64(hashed(first, last + length) + (own - first).astype(np.uint64) * _BASE + (last - first).astype(np.uint64))
    return [text, first, last, own, key, kind]


def _segments(batch: pa.RecordBatch, length: int):
    """(ids, offsets, bytes) of texts, about SEGMENT bytes at a time; long texts are cut, their segments
    overlapping so that every window is in one of them.
    """
    for part in slices(batch, "text", SEGMENT):
        ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data = part.column(1).cast(pa.binary()).to_pylist()
        if len(data) > 1 or len(data[0]) <= 2 * SEGMENT:
            yield ids, np.zeros(len(ids), np.int64), data
        else:
            for at in range(0, len(data[0]) - length + 1, SEGMENT):
                yield ids, np.array([at]), [data[0][at : at + SEGMENT + length - 1]]


BLOCK = "key long, kind long, doc long, first long, last long, piece long, spread long"


def _merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of window starts with those that touch in one document as one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], first[at], last[np.append(at[1:], len(doc)) - 1] if len(at) else last


def _local_firsts(parts: list[list[np.ndarray]], names: list[str]):
    """Blocks met first, as they are, and the spans of those met again (piece -1)."""
    key, kind, doc, first, last, piece = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((first, doc, kind, key))
    key, kind, doc, first, last, piece = (x[order] for x in (key, kind, doc, first, last, piece))
    again = np.zeros(len(key), dtype=bool)
    again[1:] = (key[1:] == key[:-1]) & (kind[1:] == kind[:-1])
    new = ~again
    yield _batch([key[new].astype(np.int64), kind[new].astype(np.int64), doc[new], first[new], last[new], piece[new], key[new].astype(np.int64)], names)
    doc, first, last = _merged(doc[again], first[again], last[again])
    none = np.zeros(len(doc), dtype=np.int64)
    yield _batch([none, none, doc, first, last, none - 1, mix64(doc.astype(np.uint64)).astype(np.int64)], names)


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _blocks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Blocks of all texts (doc, text); positions count from the start of the document."""
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for ids, offsets, texts in _segments(batch, length):
                lengths = np.array([len(t) for t in texts], dtype=np.int64)
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                text, first, last, piece, key, kind = blocks_of(data, lengths, length, gram)
                base = (starts_of(lengths) - offsets)[text]
                held.append([key, kind, ids[text], first - base, last - base, piece - base])
                n += len(text)
                if n >= HELD_BLOCKS:
                    yield from _local_firsts(held, names)
                    held, n = [], 0
        if n:
            yield from _local_firsts(held, names)

    return docs.mapInArrow(run, BLOCK)


FOUND = "doc long, first long, last long, key long, piece long"


def _settle(blocks: DataFrame) -> DataFrame:
    """Spans of blocks that were met before (piece -1), and blocks of pieces that have several kinds.

    Blocks come by piece, sorted; a task looks at one piece after another.
    """
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(n, "spread").sortWithinPartitions("key", "kind", "doc", "first")
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches):
        # Of the piece at the end of the last batch: its hash, its last kind, how many kinds it has had,
        # and its first block while there is one kind only.
        at_key, at_kind, n_kinds, waiting = None, None, 0, None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(6)]
            span = rows[5] < 0
            if span.any():
                yield _batch([rows[i][span] for i in (2, 3, 4, 0, 5)], names)
                rows = [r[~span] for r in rows]
            key, kind, doc, first, last, piece = rows
            if not len(key):
                continue
            new_key, new_kind = np.ones(len(key), dtype=bool), np.ones(len(key), dtype=bool)
            new_key[1:] = key[1:] != key[:-1]
            new_kind[1:] = new_key[1:] | (kind[1:] != kind[:-1])
            goes_on = at_key == key[0]
            new_kind[0] = not goes_on or at_kind != kind[0]
            at = np.flatnonzero(new_key)
            kinds = np.add.reduceat(new_kind.astype(np.int64), at)
            kinds[0] += n_kinds if goes_on else 0
            if goes_on and waiting is not None and kinds[0] > 1:
                yield _batch([np.array([x]) for x in waiting], names)
                waiting = None
            yield _batch([doc[~new_kind], first[~new_kind], last[~new_kind], key[~new_kind], np.full((~new_kind).sum(), -1)], names)
            keep = new_kind & np.repeat(kinds > 1, np.diff(np.append(at, len(key))))
            yield _batch([x[keep] for x in (doc, first, last, key, piece)], names)
            at_key, at_kind, n_kinds = key[-1], kind[-1], kinds[-1]
            if n_kinds > 1:
                waiting = None
            elif new_kind[at[-1]]:
                waiting = [x[at[-1]] for x in (doc, first, last, key, piece)]

    return dealt.drop("spread").mapInArrow(run, FOUND)


PIECES = "key long, part long, doc long, first long, data binary, windows int"


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of blocks (doc, key, first, last, piece, run), by key and part.

    Blocks are whole where ``run`` is 0. Others are cut where the distance of a window to the piece is a
    multiple of ``run``, and parted by that multiple and a hash of the bytes that windows of these distances share.
    """
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "first", "last", "piece", "run")).alias("blocks"))
    both = docs.join(lists, "doc").select("text", "doc", "blocks")
    names = [c.split()[0] for c in PIECES.split(", ")]

    def make():
        from xxhash import xxh3_64_intdigest

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for text, doc, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                for b in blocks:
                    key, first, last, piece, run = b["key"], b["first"], b["last"], b["piece"], b["run"]
                    if not run:
                        out.append((key, -1, doc, first, data[first : last + length], last - first + 1))
                        continue
                    while first <= last:
                        multiple = (piece - first) // run
                        common = piece - multiple * run  # the last window of these distances
                        end = min(last, common)
                        part = xxh3_64_intdigest(data[common : common - run + 1 + length], multiple) >> 1
                        out.append((key, part, doc, first, data[first : end + length], end - first + 1))
                        first = end + 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
            columns = list(zip(*out)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        return work

    return map_texts(both, "text", make, PIECES)


def repeated_windows(data: list[bytes], doc: np.ndarray, first: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Of all windows of the blocks, one after another: is it equal to an earlier one (by doc, start)?"""
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    block = np.repeat(np.arange(len(data)), windows)
    out = np.zeros(len(block), dtype=bool)
    # Equal windows have equal hashes: of every block, only what lies between windows whose hash is met again matters.
    window_offsets = starts_of(windows)
    at = gather(starts_of(sizes), windows)
    hashes = _range_hash(flat)(at, at + length)
    met = np.flatnonzero(_met_again(hashes))
    if not len(met):
        return out
    new = np.ones(len(met), dtype=bool)
    new[1:] = block[met[1:]] != block[met[:-1]]
    lowest, highest = met[new], met[np.append(np.flatnonzero(new)[1:], len(met)) - 1]
    windows = highest - lowest + 1
    sizes = windows + length - 1
    of_all = gather(lowest, windows)
    starts = starts_of(sizes + 1)
    # A zero ends every block; bytes are raised by one above it.
    symbols = np.ones(int((sizes + 1).sum()), dtype=np.int64)
    symbols[gather(starts, sizes)] = flat[gather(at[lowest], sizes)].astype(np.int64) + 2
    order = suffix_array(symbols)
    window_start = gather(starts, windows)
    of = np.full(len(symbols), -1, dtype=np.int64)
    of[window_start] = np.arange(len(window_start))
    order = of[order]
    order = order[order >= 0]  # windows in the order of their suffixes
    # Adjacent prefixes, byte by byte.
    padded = np.concatenate([flat_bytes(symbols), np.zeros(length, np.uint8)])
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    a, b = window_start[order[:-1]], window_start[order[1:]]
    live = np.arange(len(same))
    for k in range(length):
        equal = padded[a[live] + k] == padded[b[live] + k]
        if not equal.all():
            same[live[~equal]] = False
            live = live[equal]
    block = block[of_all]
    where = first[block] + of_all - window_offsets[block]
    group = np.concatenate([[0], np.cumsum(~same)])
    ranked = np.lexsort((where[order], doc[block[order]], group))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = group[ranked[1:]] == group[ranked[:-1]]
    out[of_all[order[ranked]]] = again
    return out


def _met_again(values: np.ndarray) -> np.ndarray:
    """Is there another such value?"""
    order = np.argsort(values)
    equal = values[order[1:]] == values[order[:-1]]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


def flat_bytes(symbols: np.ndarray) -> np.ndarray:
    """Symbols as bytes; the end of a block is lost, as no window reaches it."""
    return ((symbols - 2) & 255).astype(np.uint8)


def _compare(pieces: DataFrame, length: int) -> DataFrame:
    """Spans (doc, first, last) of windows that are equal to an earlier one of their piece and part."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(n, "key", "part").sortWithinPartitions("key", "part", "doc", "first")

    def run(batches):
        held, size, at, group = [], 0, None, []
        for batch in batches:
            again = []
            for key, part, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (key, part) != at:
                    if len(group) > 1:  # no window of a block is in it again
                        held += group
                        size += sum(len(r[2]) for r in group)
                    if size >= SORTED_BYTES:
                        yield spans(*zip(*held))
                        held, size = [], 0
                    at, group = (key, part), []
                elif part >= 0 and row[2] == group[0][2]:  # equal to the first, throughout
                    again.append((row[0], row[1], row[1] + row[3] - 1))
                    continue
                group.append(row)
            if again:
                yield _batch(list(_merged(*np.array(again, dtype=np.int64).T)), ["doc", "first", "last"])
        if len(group) > 1:
            held += group
        if held:
            yield spans(*zip(*held))

    def spans(doc, first, data, windows):
        doc, first, windows = (np.array(x, dtype=np.int64) for x in (doc, first, windows))
        again = repeated_windows(data, doc, first, windows, length)
        block = np.repeat(np.arange(len(data)), windows)[again]
        where = (np.arange(len(again)) - np.repeat(starts_of(windows), windows))[again] + first[block]
        return _batch(list(_merged(doc[block], where, where)), ["doc", "first", "last"])

    return dealt.mapInArrow(run, "doc long, first long, last long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, first, last): runs of starts of windows of (doc, text) that also start earlier."""
    found = materialize(_settle(_blocks(docs.select("doc", "text"), length, gram)), "blocks")
    mixed = found.where("piece >= 0")
    run = F.when(F.col("kinds") > HOTTEST * HOT_KINDS, 1).otherwise(min(RUN, length - gram + 1))
    hot = mixed.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT_KINDS).select("key", run.alias("run"))
    wanted = mixed.join(hot, "key", "left").withColumn("run", F.coalesce("run", F.lit(0)))
    compared = _compare(_cut(docs, wanted, length), length)
    return found.where("piece < 0").select("doc", "first", "last").unionAll(compared)


APPLIED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, text) with one text for each id; a null id is the least of all."""
    least = np.iinfo(np.int64).min
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(int(least))).alias("doc"), value.alias("text"))


def _cut_out(text: str, spans: list | None, length: int) -> tuple[bytes, bytes, int]:
    """The bytes of a text, those that stay, and the number of runs that go."""
    data = text.encode()
    if not spans:
        return data, data, 0
    bounds = sorted((s["first"], s["last"] + length) for s in spans)
    runs = [list(bounds[0])]
    for a, b in bounds[1:]:
        if a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return data, b"".join([*kept, data[at:]]), len(runs)


def remove_repeats(df: DataFrame, doc_id: str, text: str, length: int = LENGTH, gram: int = GRAM, bytes_as: str | None = None) -> DataFrame:
    """What stays of every document: ``doc_id``, n_bytes, n_removed, n_spans, kept_sha256.

    ``bytes_as`` names a further column with the bytes that stay; a removed span may cut a character.
    """
    docs = _documents(df, doc_id, text)
    if df.groupBy(F.col(f"`{doc_id}`")).count().where("count > 1").take(1):
        docs = docs.groupBy("doc").agg(F.min("text").alias("text"))
    spans = repeated_spans(docs, length, gram)
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    both = docs.join(lists, "doc", "left").select("doc", "text", "spans")
    names = ["doc", *(c.split()[0] for c in APPLIED.split(", ")), *([bytes_as] if bytes_as else [])]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [_cut_out(t, s, length) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [
                batch.column(0),
                pa.array([len(d) for d, _, _ in rows], pa.int64()),
                pa.array([len(d) - len(k) for d, k, _ in rows], pa.int64()),
                pa.array([n for _, _, n in rows], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for _, k, _ in rows], pa.string()),
            ]
            if bytes_as:
                columns.append(pa.array([k for _, k, _ in rows], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=names)

        return work

    schema = f"doc long, {APPLIED}" + (f", `{bytes_as}` binary" if bytes_as else "")
    out = map_texts(both, "text", make, schema)
    doc = F.when(F.col("doc") > int(np.iinfo(np.int64).min), F.col("doc"))
    return out.select(doc.alias(doc_id), *names[1:])
