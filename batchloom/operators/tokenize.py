"""Text to token ids under per-field limits and a per-record budget.

A tokenizer works in two steps. ``units`` gives something whose entries are the tokens-to-be, cheap
to count and to cut (the text itself for code points, the array of words for a vocabulary), and
``ids`` turns what is left after truncation into integers. Long records that are cut to a few
thousand tokens therefore never become long id arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.functions.arrays import head, no_tokens, tail
from batchloom.functions.text import WORD_PATTERN, required, words
from batchloom.session import materialize
from batchloom.spec import DatasetSpec

# Entries of a vocabulary that travel to the executors (some 10 MB); the rest of it is joined.
MAX_SHIPPED_VOCABULARY = 500_000

# Words of a vocabulary, in bytes, that may travel where ids are asked for in place.
MAX_SENT_BYTES = 1 << 28


# A word is hot if more rows have it, and if they are more than this share of all rows: there are at most MAX_HOT.
HOT_ROWS, MAX_HOT = 100_000, 10_000


# Words that a Python worker has in hand at a time, if no record has more.
MAX_PART_WORDS = 1 << 18

# The same for texts that a tokenizer object is given, in bytes: their ids are Python objects for a while.
MAX_PART_BYTES = 1 << 20


@dataclass(frozen=True)
class SpecialTokens:
    """Ids a tokenizer reserves. ``tokenize`` adds the first two to a field only if it is asked to;
    rows are padded with 0 unless ``collate`` is given ``pad_id``."""

    bos_id: int | None = None
    eos_id: int | None = None
    pad_id: int | None = None

    def added(self) -> int:
        return (self.bos_id is not None) + (self.eos_id is not None)

    def around(self, ids: Column) -> Column:
        """Ids between the two."""
        ends = [F.array() if i is None else F.array(F.lit(i)) for i in (self.bos_id, self.eos_id)]
        return F.concat(ends[0].cast("array<int>"), ids, ends[1].cast("array<int>"))


class Tokenizer:
    """Interface: column expressions from text to units, and from units to ids."""

    special = SpecialTokens()

    def units(self, text: Column) -> Column:
        raise NotImplementedError

    def ids(self, units: Column) -> Column:
        raise NotImplementedError

    def size(self, units: Column) -> Column:
        return F.size(units)

    def first(self, units: Column, n: Column) -> Column:
        return head(units, n)

    def last(self, units: Column, n: Column) -> Column:
        return tail(units, n)

    def encode(self, text: Column) -> Column:
        """All ids of a text."""
        return self.ids(self.units(text))

    def count(self, text: Column) -> Column:
        """Number of ids of a text."""
        return self.size(self.units(text))

    def finish(self, df: DataFrame, fields: Sequence[str], seq: str) -> DataFrame:
        """Replace the units in ``fields`` by ids. Row-local unless a tokenizer overrides it."""
        return df.withColumns({f: self.ids(F.col(f)) for f in fields})


class CodepointTokenizer(Tokenizer):
    """One id per Unicode code point."""

    def __init__(self, special: SpecialTokens = SpecialTokens()):
        self.special = special

    def units(self, text: Column) -> Column:
        return text

    def ids(self, units: Column) -> Column:
        codes = F.transform(F.split(units, ""), lambda c: F.ascii(c))
        return F.when(F.length(units) == 0, no_tokens()).otherwise(codes)

    def size(self, units: Column) -> Column:
        return F.char_length(units)

    def first(self, units: Column, n: Column) -> Column:
        return F.left(units, n.cast("int"))

    def last(self, units: Column, n: Column) -> Column:
        return F.right(units, n.cast("int"))


def build_vocabulary(
    texts: DataFrame, text: str, size: int, pattern: str = WORD_PATTERN, first_id: int = 1
) -> DataFrame:
    """(token, id) of the ``size`` most frequent words; ties go to the smaller word.

    Words are counted before the shuffle, so a word that fills a third of the corpus costs one row
    per task. Words too rare to be chosen are dropped by a count read off the table of counts, so
    what is sorted and ranked is ``size`` rows and the ties of the last place.
    """
    token = F.explode(words(F.col(text), pattern)).alias("token")
    counts = texts.select(token).groupBy("token").agg(F.count("token").alias("count"))
    # One row per distinct count; the words counted that often or more.
    table = counts.groupBy("count").agg(F.count("token").alias("n"))
    at_least = F.sum("n").over(Window.orderBy(F.desc("count")))
    enough = table.select("count", at_least.alias("at_least")).where(F.col("at_least") >= size)
    cutoff = enough.agg(F.coalesce(F.max("count"), F.lit(0)).alias("cutoff")).scalar()
    top = counts.where(F.col("count") >= cutoff).orderBy(F.desc("count"), "token").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "token"))
    return top.select("token", (rank - 1 + first_id).cast("int").alias("id"))


class VocabularyTokenizer(Tokenizer):
    """Words looked up in a vocabulary ``(token, id)`` of distinct words; others get ``unknown_id``.

    The vocabulary is stored once. The ``max_shipped`` entries of the lowest ids, which are the most
    frequent words where ids are ranks, are sent to the executors and looked up column-wise on Arrow
    batches: ids never leave their row. If the vocabulary is larger, words not found there are counted, and
    joined with the rest of it by ``finish``: frequent ones in place, the others once for each record. ``finish`` writes
    the records once and numbers them there, so that what is joined goes back by that number, and the result depends
    on the words alone, not on the other columns or on ``max_shipped``.
    """

    def __init__(
        self,
        vocabulary: DataFrame,
        unknown_id: int = 0,
        pattern: str = WORD_PATTERN,
        max_shipped: int = MAX_SHIPPED_VOCABULARY,
        special: SpecialTokens = SpecialTokens(),
    ):
        self.special = special
        self.unknown_id = unknown_id
        self.pattern = pattern
        self._entries = materialize(vocabulary.select("token", F.col("id").cast("int").alias("id")), "vocabulary")
        # Asks for one row more than may be shipped, so the answer is bounded either way.
        rows = self._entries.orderBy("id").limit(max_shipped + 1).toArrow()
        self._rest = None
        if rows.num_rows > max_shipped:
            first = rows.column("id")[max_shipped].as_py()
            self._rest = self._entries.where(F.col("id") >= first)
            rows = rows.slice(0, max_shipped)
        if self._rest is None:
            self._lookup = _vocabulary_lookup(vocabulary.sparkSession, rows, unknown_id)
        else:
            self._lookup = _vocabulary_split(vocabulary.sparkSession, rows)
        self._whole = None

    def units(self, text: Column) -> Column:
        return words(text, self.pattern)

    def ids(self, units: Column) -> Column:
        """Ids in place. A vocabulary that is otherwise joined is sent as a whole for this, up to
        MAX_SENT_BYTES of words."""
        return self._complete()(units)

    def _complete(self):
        if self._rest is None:
            return self._lookup
        if self._whole is None:
            if self._entries.agg(F.sum(F.octet_length("token"))).head()[0] > MAX_SENT_BYTES:
                raise ValueError(f"a vocabulary of over {MAX_SENT_BYTES} bytes is only joined; use tokenize() or finish()")
            self._whole = _vocabulary_lookup(
                self._entries.sparkSession, self._entries.orderBy("id").toArrow(), self.unknown_id
            )
        return self._whole

    def finish(self, df: DataFrame, fields: Sequence[str], seq: str) -> DataFrame:
        return super().finish(df, fields, seq) if self._rest is None else self._joined(df, fields)

    def _joined(self, df: DataFrame, fields: Sequence[str]) -> DataFrame:
        """Ids of fields whose words are looked up in part and joined in part, split by frequency.

        What is looked up in place is written once, with a number for the record, which is all that the other words
        carry: each of them once for a record, however often it occurs. Words stay there, and the fields meet what was
        joined as integers. Hot words are few by their definition: what they are, or that they are in no vocabulary, is
        sent to the tasks. Of the others only the words that the vocabulary has are joined, each a single row.
        """
        others = [c for c in df.columns if c not in fields]
        nothing = F.array().cast("array<string>")
        units = F.concat(*(F.coalesce(F.col(f), nothing) for f in fields))
        sizes = F.struct(*(F.when(F.col(f).isNotNull(), F.size(f)).alias(f) for f in fields))
        split = df.select(*others, sizes.alias("__sizes"), self._lookup(units).alias("__split"))
        stage = materialize(split.withColumn("__row", F.monotonically_increasing_id()), "words")
        places = stage.select("__row", F.posexplode("__split.left").alias("__slot", "token"))
        numbered = self._numbered(places).select("__row", _slot(F.col("__slot"), 0, F.col("id")).alias("__id"))
        joined = numbered.groupBy("__row").agg(F.collect_list("__id").alias("__joined"))
        left = F.size("__split.left").alias("__left")
        kept = stage.select(*others, "__sizes", "__row", "__split.found", "__split.slots", left)
        # Every slot has an entry of its own, which gives way to one that was joined.
        every = F.transform(F.array_repeat(F.lit(1), F.col("__left")), lambda _, at: _slot(at, 1, F.lit(self.unknown_id)))
        every = F.when(F.col("__joined").isNull(), every).otherwise(F.array_sort(F.concat("__joined", every)))
        merged = kept.join(joined, "__row", "left")

        def without_own(every: Column) -> Column:
            return F.filter(every, lambda e, at: (at == 0) | (_slot_of(F.get(every, at - 1)) != _slot_of(e)))

        def filled(ids: Column) -> Column:
            return F.zip_with("found", "slots", lambda i, s: F.coalesce(i, F.get(ids, s), F.lit(self.unknown_id)))

        # What every entry asks for is bound once for a record; a column could be put in its place and computed for each.
        ids = F.transform(_bound(every, without_own), _id_of)
        merged = merged.withColumn("__all", _bound(ids, filled))
        start: Column = F.lit(1)
        cut = {}
        for field in fields:
            size = F.col(f"__sizes.`{field}`")
            cut[field] = F.slice("__all", start, size)
            start = start + F.coalesce(size, F.lit(0))
        return merged.select(*(cut[c].alias(c) if c in cut else F.col(c) for c in df.columns))

    def _numbered(self, places: DataFrame) -> DataFrame:
        """The rows of ``places`` whose word the rest of the vocabulary has, with its ``id``."""
        counts = places.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        hot_rows = max(HOT_ROWS, places.count() // MAX_HOT)
        hot = F.col("n") > hot_rows
        # The vocabulary meets distinct words. Those that it does not have end here, unless they are hot.
        known = materialize(counts.join(self._rest, "token", "left").where(hot | F.col("id").isNotNull()), "words")
        sent = F.broadcast(known.where(hot).select("token", F.col("id").alias("__hot_id"), F.lit(True).alias("__hot")))
        marked = places.join(sent, "token", "left")
        others = [c for c in places.columns if c != "token"]
        in_place = marked.where("__hot AND __hot_id IS NOT NULL").select(*others, F.col("__hot_id").alias("id"))
        cold = marked.where("__hot IS NULL").join(known.where(~hot).select("token", "id"), "token")
        return in_place.unionAll(cold.select(*others, "id"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slot(slot: Column, rank: int, ids: Column) -> Column:
    """Slot, rank and id in one integer, in this order; 32 bits are the id."""
    return F.shiftleft(slot.cast("bigint") * 2 + rank, 32) + ids.cast("bigint") + (1 << 31)


def _slot_of(packed: Column) -> Column:
    return F.shiftright(packed, 33)


def _id_of(packed: Column) -> Column:
    return (packed.bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int")


def _shipped(spark: SparkSession, rows: pa.Table) -> Callable[[], tuple[pa.Array, pa.Array]]:
    """Words and ids of ``rows`` on the executors, made once per Python worker."""
    shipped = spark.sparkContext.broadcast(
        (rows.column("token").to_pylist(), rows.column("id").to_pylist())
    )
    cache: dict[str, tuple[pa.Array, pa.Array]] = {}

    def table() -> tuple[pa.Array, pa.Array]:
        if not cache:
            tokens, ids = shipped.value
            cache["table"] = (pa.array(tokens, pa.string()), pa.array(ids, pa.int32()))
        return cache["table"]

    return table


def _vocabulary_lookup(spark: SparkSession, rows: pa.Table, missing: int):
    """Word arrays to id arrays; words that are not in ``rows`` become ``missing``."""
    table = _shipped(spark, rows)

    @F.arrow_udf("array<int>")
    def lookup(batch: pa.Array) -> pa.Array:
        tokens, ids = table()
        flat = batch.flatten()
        place = pc.index_in(flat.cast(pa.string()), value_set=tokens)
        found = pc.fill_null(ids.take(place), pa.scalar(missing, pa.int32()))
        return pa.ListArray.from_arrays(_offsets(_sizes(batch)), _one_chunk(found), mask=batch.is_null())

    return lookup


def _vocabulary_split(spark: SparkSession, rows: pa.Table):
    """Word arrays to ``found``, ids or null for words that are not in ``rows``; ``left``, these words, each once; and
    ``slots``, the index in ``left`` of every word that is there."""
    table = _shipped(spark, rows)

    @F.arrow_udf("found array<int>, slots array<int>, left array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, ids = table()
        for batch in batches:
            for part in _parts(batch, _sizes(batch), MAX_PART_WORDS):
                yield _split(part, tokens, ids)

    return split


def _split(batch: pa.Array, tokens: pa.Array, ids: pa.Array) -> pa.Array:
    sizes = _sizes(batch)
    flat = _one_chunk(batch.flatten().cast(pa.string()))
    place = _one_chunk(pc.index_in(flat, value_set=tokens))
    at = np.flatnonzero(pc.and_(place.is_null(), flat.is_valid()).to_numpy(zero_copy_only=False))
    words = _one_chunk(flat.take(pa.array(at))).dictionary_encode()
    n_words = max(len(words.dictionary), 1)
    row = np.repeat(np.arange(len(sizes)), sizes)[at]
    # Words of a record in one order, each once.
    pairs, which = np.unique(row * n_words + words.indices.to_numpy(), return_inverse=True)
    first = np.searchsorted(pairs // n_words, np.arange(len(sizes) + 1))
    slots, absent = np.zeros(len(flat), np.int32), np.ones(len(flat), bool)
    slots[at], absent[at] = which - first[row], False
    offsets = _offsets(sizes)
    lists = [
        pa.ListArray.from_arrays(offsets, _one_chunk(ids.take(place))),
        pa.ListArray.from_arrays(offsets, pa.array(slots, mask=absent)),
        pa.ListArray.from_arrays(pa.array(first, pa.int32()), words.dictionary.take(pa.array(pairs % n_words))),
    ]
    return pa.StructArray.from_arrays(lists, ["found", "slots", "left"])


def _sizes(batch: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _parts(batch: pa.Array, sizes: np.ndarray, most: int) -> Iterator[pa.Array]:
    """Rows of ``batch`` in their order, in parts of at most ``most`` units, or of one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        end = max(int(np.searchsorted(ends, before + most, "right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def _one_chunk(values: Any) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def _id_lists(lists: Iterable[Iterable[int]]) -> pa.Array:
    return pa.array([ids if isinstance(ids, list) else list(ids) for ids in lists], pa.list_(pa.int32()))


class ObjectTokenizer(Tokenizer):
    """Any Python tokenizer, made by ``factory`` once per Python worker.

    ``factory`` returns a function from a list of texts to a list of id lists. It runs where the
    data is, on parts of Arrow batches: texts of MAX_PART_BYTES at a time, or a longer one by itself.
    """

    def __init__(
        self,
        factory: Callable[[], Callable[[list[str]], list[list[int]]]],
        special: SpecialTokens = SpecialTokens(),
    ):
        self.special = special
        made: list[Callable[[list[str]], list[list[int]]]] = []

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                if not made:
                    made.append(factory())
                sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                for part in _parts(batch, sizes, MAX_PART_BYTES):
                    ids = _id_lists(made[0](part.to_pylist()))
                    if len(ids) != len(part):
                        raise ValueError(f"the tokenizer gave {len(ids)} lists for {len(part)} texts")
                    yield ids

        self._encode = encode

    def units(self, text: Column) -> Column:
        return self._encode(text)

    def ids(self, units: Column) -> Column:
        return units


# What to do with a field when nothing of the record budget is left.
ON_EXHAUSTED = ("keep", "empty")


def tokenize(
    df: DataFrame,
    spec: DatasetSpec,
    tokenizer: Tokenizer,
    on_exhausted: str = "keep",
    keep: Sequence[str] = ("seq_id",),
    add_special: bool = False,
) -> DataFrame:
    """Tokenize the fields of ``spec``: (keep…, field…, field_len…, total_len).

    ``add_special`` puts the tokenizer's BOS and EOS ids around every field, within its limits.

    Fields are cut in their order. A field without a maximum gets what the earlier ones left of
    ``max_seq_len``; one with a maximum gets the smaller of the two. A budget of exactly nothing
    does not cut (``on_exhausted="keep"``, as a maximum of 0 means none to a tokenizer); ``"empty"``
    makes ``max_seq_len`` a hard limit. Without ``max_seq_len`` nothing is cut.
    """
    if on_exhausted not in ON_EXHAUSTED:
        raise ValueError(f"on_exhausted must be one of {ON_EXHAUSTED}")
    if not keep:
        raise ValueError("keep needs the id column")
    fields = list(spec.field_names)
    absent = [f for f in fields if f not in df.columns]
    if absent:
        raise ValueError(f"fields {absent} are not in the data: {df.columns}")
    df = df.select(
        *keep, *(tokenizer.units(required(F.col(f), f)).alias(f) for f in fields)
    )
    used: Column = F.lit(0)
    extra = tokenizer.special.added() if add_special else 0
    for field in spec:
        units, length = F.col(field.name), f"{field.name}_len"
        size = tokenizer.size(units)
        if not spec.max_seq_len or field.side == "none":
            df = df.withColumn(length, size.cast("int"))
        else:
            budget = F.lit(spec.max_seq_len) - used
            if field.max_len:
                budget = F.least(F.lit(field.max_len), budget)
            left_over = size if on_exhausted == "keep" else F.lit(0)
            room = F.greatest(budget - extra, F.lit(0))
            kept = F.when(budget <= 0, left_over).otherwise(F.least(size, room))
            df = df.withColumn(length, kept.cast("int"))
            cut = tokenizer.last if field.side == "left" else tokenizer.first
            df = df.withColumn(field.name, cut(units, F.col(length)))
        used = used + F.col(length) + F.lit(extra)
    lengths = [f"{f}_len" for f in fields]
    df = df.withColumn("total_len", used.cast("int"))
    out = tokenizer.finish(df, fields, keep[0])
    if extra:
        out = out.withColumns(
            {f: tokenizer.special.around(F.col(f)) for f in fields} | {n: F.col(n) + F.lit(extra) for n in lengths}
        )
    return out.select(*keep, *fields, *lengths, "total_len")


def map_records(
    df: DataFrame, function: Callable[[dict], dict], schema: T.StructType | str, order_by: str | None = None
) -> DataFrame:
    """Apply a Python function to every record, in parallel; records travel in Arrow batches.

    With ``order_by`` the result comes in that order when it is read.
    """

    def run(batches):
        for batch in batches:
            rows = [function(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(parsed)
    out = df.mapInArrow(run, schema=parsed)
    return out.orderBy(order_by) if order_by else out
