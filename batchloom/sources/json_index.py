"""Large JSON files in parallel: a structural index cuts the records of one file in as many tasks as it has splits.

Spark's text source splits files at commas, which no multi-byte character and no escape contains, so every split is a whole
number of fragments. What a fragment means depends on what stands before it: whether a string is open, and how deep
it is nested. Both are sums over splits:

1. *Index.* Each split reports how often the string state flips and, for either state at its start, how the depth
   changes and how many commas stand at each relative depth. One row for a split.
2. *States.* Prefix sums over the splits of a file give the state at the start of each, and the number of records before.
   Spark's driver lists the same splits to plan the scan, so they fit there and can be sent to all tasks.
3. *Cut.* Tasks cut their splits at the commas of depth 1. Records inside one split are done; the first and last piece
   of a split are joined with their neighbours, which are the only texts that are shuffled.

A record must fit in a row, a file need not. Values that are no strings come as their compact JSON text. Files that end inside a string or a bracket abort by name, as do files with
another top level than expected, empty places between commas, and text after the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.session import materialize
from batchloom.sources.files import NameFilter, folder_reader, matching

INDEX = "path string, block long, fragments long, first string, solid long, flips long, change array<long>, levels array<array<long>>, commas array<array<long>>"
PIECES = "number long, block long, piece string, whole boolean, head boolean, tail boolean"

#: Rows and bytes that a task passes on at a time.
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20

_BACKSLASH, _QUOTE, _COMMA = b"\\"[0], b'"'[0], b","[0]
_STEP = np.zeros(256, np.int64)
_STEP[[*b"[{"]], _STEP[[*b"]}"]] = 1, -1
_SIGN = _STEP != 0
_SIGN[_COMMA] = True


def _signs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas, whether an odd number of quotes stands before each, and the number of quotes."""
    quotes = np.flatnonzero(text == _QUOTE)
    slashes = np.flatnonzero(text == _BACKSLASH)
    if len(slashes) and len(quotes):
        # A quote after an odd run of backslashes is part of the string.
        heads = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        length = np.diff(heads, append=len(slashes))
        after = (slashes[heads] + length)[length % 2 == 1]
        quotes = quotes[~np.isin(quotes, after)]
    signs = np.flatnonzero(_SIGN[text])
    return signs, np.searchsorted(quotes, signs) & 1, len(quotes)


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(path, start of the split, fragments, text) of the rows of a split in a batch, in order.

    Every text but the first of a file begins with the comma that the source has taken away.
    """
    before = None
    for batch in batches:
        block = batch.column("block").to_numpy()
        codes = batch.column("path").dictionary_encode()
        path = codes.indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (path[1:] != path[:-1])])) if len(block) else []
        for a, b in zip(starts, [*starts[1:], len(block)]):
            name, at = codes.dictionary[int(path[a])].as_py(), int(block[a])
            part = batch.column("value").slice(a, b - a)
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), part), ",")[0].as_buffer().to_pybytes()
            first = before != (name, at) and at == 0
            before = name, at
            yield name, at, b - a, whole if first else b"," + whole


@dataclass
class _Split:
    """What the index says of a split; lists have an entry for either string state at its start."""

    first: str = ""
    fragments: int = 0
    solid: int = 0
    flips: int = 0
    change: list[int] = field(default_factory=lambda: [0, 0])
    commas: list[dict[int, int]] = field(default_factory=lambda: [{}, {}])

    def add(self, fragments: int, data: bytes) -> None:
        text = np.frombuffer(data, np.uint8)
        self.first = self.first or data.lstrip(b" \t\r\n\xef\xbb\xbf")[:1].decode("utf-8", "replace")
        self.fragments += fragments
        self.solid += int((text > 32).sum())
        signs, odd, quotes = _signs(text)
        for state in (0, 1):
            outside = signs[(odd + self.flips + state) % 2 == 0]
            depth = self.change[state] + np.cumsum(_STEP[text[outside]])
            at, times = np.unique(depth[text[outside] == _COMMA], return_counts=True)
            for level, n in zip(at.tolist(), times.tolist()):
                if level <= 1:  # a split starts at depth 0 or more
                    self.commas[state][level] = self.commas[state].get(level, 0) + n
            self.change[state] = int(depth[-1]) if len(depth) else self.change[state]
        self.flips += quotes


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    splits: dict[tuple[str, int], _Split] = {}
    for name, at, fragments, data in _by_split(batches):
        splits.setdefault((name, at), _Split()).add(fragments, data)
    rows = [
        {"path": p, "block": b, "fragments": s.fragments, "first": s.first, "solid": s.solid, "flips": s.flips, "change": s.change,
         "levels": [list(c) for c in s.commas], "commas": [list(c.values()) for c in s.commas]}
        for (p, b), s in splits.items()
    ]
    lists = pa.list_(pa.list_(pa.int64()))
    kinds = [("path", pa.string()), ("block", pa.int64()), ("fragments", pa.int64()), ("first", pa.string()), ("solid", pa.int64()), ("flips", pa.int64()), ("change", pa.list_(pa.int64())), ("levels", lists), ("commas", lists)]
    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


@dataclass(frozen=True)
class _Start:
    """A split: its fragments, the state at its start, and the number of the record that it starts in."""

    fragments: int
    inside: int
    depth: int
    number: int


@dataclass
class _File:
    """The numbers of a file's records, from ``first`` to before ``end``; commas of ``level`` part them."""

    first: int
    level: int
    last_block: int
    end: int = 0


def _states(rows: list, opening: str) -> tuple[dict[tuple[str, int], _Start], dict[str, _File]]:
    """How every split starts, and where the records of every file begin and end."""
    starts: dict[tuple[str, int], _Start] = {}
    files: dict[str, _File] = {}
    by_file: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["block"])):
        by_file.setdefault(r["path"], []).append(r)
    base = 0
    for path, splits in by_file.items():
        sign = next((s["first"] for s in splits if s["first"]), "")
        if sign and sign not in opening:
            raise ValueError(f"{path} is no JSON of the expected form: it begins with {sign!r}")
        # An object where arrays are expected is a single record: no comma has depth -1.
        file = files[path] = _File(base, 1 if sign == opening[0] else -1, splits[-1]["block"])
        inside = depth = cuts = 0
        for s in splits:
            starts[path, s["block"]] = _Start(s["fragments"], inside, depth, base + cuts)
            cuts += dict(zip(s["levels"][inside], s["commas"][inside])).get(file.level - depth, 0)
            depth += s["change"][inside]
            inside = (inside + s["flips"]) % 2
        if inside or depth:
            raise ValueError(f"{path} is no JSON: it ends inside {'a string' if inside else 'a bracket'}")
        blank = sum(s["solid"] for s in splits) == (2 if file.level == 1 else 0)
        file.end = base = base + (0 if blank and not cuts else cuts + 1)
    return starts, files


def _cutter(starts: dict[tuple[str, int], _Start], files: dict[str, _File]):
    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        now, start, file = None, None, None
        inside = depth = number = seen = 0
        closed = False
        rest: list[bytes] = []

        def piece(done: bool) -> tuple:
            """What has been gathered; it is whole if it began and is ``done`` in this split."""
            began = number > start.number or now[1] == 0
            # A file of one object is a record as it stands, without brackets of its own to lose.
            head, tail = (file.level == 1 and number == n for n in (file.first, file.end - 1))
            return number, now[1], b"".join(rest), began and done, head, tail

        def close() -> Iterator[tuple]:
            if now is not None:
                if seen != start.fragments:
                    raise ValueError(f"{now[0]} was split in another way while it was read")
                if file.end > file.first:
                    yield piece(now[1] == file.last_block)

        for name, at, fragments, data in _by_split(batches):
            if (name, at) != now:
                yield from close()
                if (name, at) not in starts:
                    raise ValueError(f"{name} was split in another way while it was read")
                now, start, file = (name, at), starts[name, at], files[name]
                inside, depth, number, seen, rest = start.inside, start.depth, start.number, 0, []
                closed = at > 0 and not depth
            seen += fragments
            text = np.frombuffer(data, np.uint8)
            signs, odd, quotes = _signs(text)
            outside = signs[(odd + inside) % 2 == 0]
            deep = depth + np.cumsum(_STEP[text[outside]])
            ends = np.flatnonzero(deep == 0)
            if closed or len(ends):
                if data[0 if closed else outside[ends[0]] + 1 :].strip():
                    raise ValueError(f"{name} is no JSON: there is text after its end")
                closed = True
            a = 0
            for c in outside[(text[outside] == _COMMA) & (deep == file.level)].tolist():
                rest.append(data[a:c])
                yield piece(True)
                number, rest, a = number + 1, [], c + 1
            rest.append(data[a:])
            depth = int(deep[-1]) if len(deep) else depth
            inside = (inside + quotes) % 2
        yield from close()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in pieces(batches):
            rows.append(row)
            size += len(row[2])
            if size >= PIECE_BYTES or len(rows) >= PIECE_ROWS:
                yield _piece_batch(rows)
                rows, size = [], 0
        if rows:
            yield _piece_batch(rows)

    return run


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    number, block, piece, *flags = zip(*rows)
    texts = pa.array(piece, pa.binary()).cast(pa.string())
    arrays = [pa.array(number, pa.int64()), pa.array(block, pa.int64()), texts, *(pa.array(x, pa.bool_()) for x in flags)]
    return pa.RecordBatch.from_arrays(arrays, names=["number", "block", "piece", "whole", "head", "tail"])


def read_json_pieces(spark: SparkSession, folder: str, names: NameFilter, opening: str, recursive: bool = True) -> DataFrame:
    """(number, piece): every record of all files, numbered by file in order of the paths, then by place.

    ``opening`` lists the brackets that a file may begin with. Of a file that begins with the first, records stand between
    the commas, and a piece is a record between such brackets, as JSON text; any other file is a single record, which gets
    them as well. The pieces are written to the shared folder once.
    """
    reader = folder_reader(spark, names, recursive).option("lineSep", ",")
    rows = matching(reader.text(folder), names)
    rows = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    starts, files = _states(rows.mapInArrow(_index, INDEX).collect(), opening)
    cut = materialize(rows.mapInArrow(_cutter(starts, files), PIECES), "json")
    parts = F.sort_array(F.collect_list(F.struct("block", "piece")))
    flags = F.max("head").alias("head"), F.max("tail").alias("tail")
    joined = cut.where("not whole").groupBy("number").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("piece"), *flags)
    pieces = cut.where("whole").select("number", "piece", "head", "tail").unionByName(joined)
    left = F.when(F.col("head"), F.regexp_replace("piece", r"^\x{FEFF}", "")).otherwise(F.concat(F.lit(opening[0]), F.col("piece")))
    closing = {"[": "]", "{": "}"}[opening[0]]
    return pieces.select("number", F.when(F.col("tail"), left).otherwise(F.concat(left, F.lit(closing))).alias("piece"))


def only_one(values: Column, what: str) -> Column:
    """The one value of an array or a map; anything else aborts."""
    return F.when(F.size(values) == 1, values).otherwise(F.raise_error(F.lit(f"bad JSON: there is no {what} between two commas")))
