"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in normal form: lower case, every run of other characters than letters and digits as
one space. An item of n characters may occur with up to ``int(rate * n)`` edits. Cut into one piece more
than that, at least one piece occurs unchanged. The pieces of a block of items form an automaton that is
broadcast; each task finds all their hits in one pass over its texts, and only the stretches of text
around a hit are verified, by Myers' bit-parallel edit distance on Python's long integers. The same
principle holds for the halves of an item and their halves: of some piece that occurs, every larger part
around it keeps to one edit less than it has pieces. So a hit is first verified with its neighbour, then
with two more, and few get as far as the whole item. What does is verified together where it overlaps.

Items are taken in blocks of about ``block_bytes`` by a hash of their id, each in one pass over the
documents: what a task holds does not grow with the benchmark. There is no shuffle of texts.

Null and empty texts match nothing. Items of fewer than ``min_chars`` characters in normal form are matched
without edits and as whole words (scripts that set no spaces have no such bounds). A short item may be a
common phrase: ``drop_contaminated`` measures in how many documents each of the short ones is, and leaves out those
that are found too often. Ids of documents and items may be of any type. Repeated items and rows each get their own result rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from batchloom.llm.common import fresh, map_texts, slices
from batchloom.session import materialize

#: Edits allowed for each character of an item.
RATE = 0.1
#: Items below are matched without edits.
MIN_CHARS = 40
#: A short item in more documents than this number and this share of all is a phrase and no leak.
PHRASE_DOCUMENTS, PHRASE_SHARE = 5, 0.001
BLOCK_BYTES = 1 << 20
#: Letters of scripts without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal_text(texts: pa.Array) -> pa.Array:
    """Lower case, with one space for every run of other characters than letters and digits."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")


def pieces_of(length: int, rate: float) -> list[tuple[int, int]]:
    """Bounds of the error budget plus one pieces of an item, of lengths as even as can be."""
    n = int(rate * length) + 1
    cuts = [i * length // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def best_match(pattern: str, masks: dict[str, int], text: str, budget: int, enough: int = -1) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to a substring of ``text`` and where the first such ends.

    ``masks`` has the positions of every character in the pattern as bits. None above ``budget``; the
    search ends at a distance of ``enough`` or less.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, budget + 1, -1
    for i, c in enumerate(text):
        match = masks.get(c, 0)
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        right_plus = minus | (full & ~(diagonal | plus))
        right_minus = plus & diagonal
        if right_plus & top:
            score += 1
        elif right_minus & top:
            score -= 1
        # The match may begin anywhere, so the row above the first one stays 0.
        right_plus = (right_plus << 1) & full
        right_minus = (right_minus << 1) & full
        plus = right_minus | (full & ~(diagonal | right_plus))
        minus = right_plus & diagonal
        if score < best:
            best, end = score, i + 1
            if best <= enough:
                break
    return (best, end) if best <= budget else None


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    return masks


def _whole(text: str, start: int, stop: int) -> bool:
    """Does this stretch of a normal text begin and end between words?"""

    def between(at: int) -> bool:
        pair = text[at - 1 : at + 1] if 0 < at < len(text) else " "
        return " " in pair or _UNSPACED.search(pair) is not None

    return between(start) and between(stop)


class Matcher:
    """The automaton of a block of items; those below ``min_chars`` have no edits."""

    def __init__(self, items: list[tuple[object, str]], rate: float, min_chars: int = MIN_CHARS):
        import ahocorasick

        rates = [rate if len(text) >= min_chars else 0.0 for _, text in items]
        self.short = [len(text) < min_chars for _, text in items]
        self.items = [(item, text, int(r * len(text)), _masks(text)) for (item, text), r in zip(items, rates)]
        self.parts: list[list[list[tuple[int, int, int, str, dict[str, int]]]]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            bounds = pieces_of(len(text), rates[k])
            for j, (a, b) in enumerate(bounds):
                pieces.setdefault(text[a:b], []).append((k, j))
            self.parts.append(self._around(text, bounds))
        self.bounds = [pieces_of(len(text), r) for (_, text), r in zip(items, rates)]
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()

    @staticmethod
    def _around(text: str, bounds: list[tuple[int, int]]) -> list:
        """For every piece, the parts of the item around it, small ones first, without the whole:
        start, stop, budget, text and masks.
        """
        out: list[list] = [[] for _ in bounds]
        spans = [(0, len(bounds))]
        while spans:
            low, high = spans.pop()
            if high - low < 2:
                continue
            middle = (low + high) // 2
            spans += [(low, middle), (middle, high)]
            if high - low < len(bounds):
                a, b = bounds[low][0], bounds[high - 1][1]
                part = (a, b, high - low - 1, text[a:b], _masks(text[a:b]))
                for j in range(low, high):
                    out[j].insert(0, part)
        return out

    def _holds(self, text: str, k: int, j: int, end: int) -> bool:
        """Do the parts around piece ``j``, which ends before ``end``, keep to their budgets?"""
        stop = self.bounds[k][j][1]
        for a, b, budget, part, masks in self.parts[k][j]:
            around = text[max(0, end - stop + a - budget) : end - stop + b + budget]
            if best_match(part, masks, around, budget, budget) is None:
                return False
        return True

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(index of the item, distance, end of the best match in the normal text) for items found."""
        if not len(self.automaton):
            return []
        starts: dict[int, list[int]] = {}
        exact: dict[int, int] = {}
        for last, places in self.automaton.iter(text):
            for k, j in places:
                if self.short[k]:
                    if k not in exact and _whole(text, last + 1 - len(self.items[k][1]), last + 1):
                        exact[k] = last + 1
                elif self._holds(text, k, j, last + 1):
                    starts.setdefault(k, []).append(last + 1 - self.bounds[k][j][1])
        found = [(k, 0, end) for k, end in exact.items()]
        for k, begin in starts.items():
            _, pattern, budget, masks = self.items[k]
            begin.sort()
            best, low, high = None, begin[0], begin[0]
            for b in [*begin[1:], math.inf]:
                if b - high <= len(pattern) + 2 * budget and b != math.inf:
                    high = b
                    continue
                left = max(0, low - budget)
                hit = best_match(pattern, masks, text[left : high + len(pattern) + budget], budget, 0)
                if hit and (best is None or hit[0] < best[0]):
                    best = hit[0], left + hit[1]
                low = high = b
            if best:
                found.append((k, *best))
        return found


def _blocks(items: DataFrame, item_id: str, text: str, least: int, block_bytes: int):
    """Lists of (id, normal text) of items of ``least`` characters or more, each of about ``block_bytes``."""
    size = items.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).head()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64(F.col(f"`{item_id}`"), F.col(f"`{text}`")), F.lit(n))
    for b in range(n):
        rows = items.where(block == b).select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).toArrow()
        normal = normal_text(rows.column("t").combine_chunks().fill_null("")) if rows.num_rows else pa.array([], pa.string())
        pairs = list(zip(rows.column("i").to_pylist(), normal.to_pylist()))
        yield [(i, t) for i, t in pairs if len(t) >= max(1, least)]


def find_items(
    df: DataFrame,
    doc_id: str,
    text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    rate: float = RATE,
    min_chars: int = MIN_CHARS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(``doc_id``, ``item_id``, distance, budget, end) of every item that a text holds.

    One row for a document and an item, for its best occurrence; ``end`` is a position in the normal text.
    """
    if doc_id == item_id:
        raise ValueError("the ids of documents and items need different names")
    kinds = [df.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    schema = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, distance int, budget int, end long"
    chosen = df.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    item_type = to_arrow_type(items.schema[item_id].dataType)
    found = None
    for block in _blocks(items, item_id, item_text, 1, block_bytes):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            matcher = Matcher(shared.value, rate, min_chars)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows: list[tuple[int, int, int, int]] = []
                for row, value in enumerate(normal_text(batch.column(1)).to_pylist()):
                    rows += ((row, *hit) for hit in matcher.find(value))
                row, k, distance, end = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
                ids = pa.array([matcher.items[i][0] for i in k.tolist()], item_type)
                budget = pa.array([matcher.items[i][2] for i in k.tolist()], pa.int32())
                made = [batch.column(0).take(pa.array(row)), ids, pa.array(distance, pa.int32()), budget, pa.array(end)]
                return pa.RecordBatch.from_arrays(made, names=[doc_id, item_id, "distance", "budget", "end"])

            return work

        part = map_texts(chosen, "t", make, schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(
    df: DataFrame,
    text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    rate: float = RATE,
    min_chars: int = MIN_CHARS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``df`` whose text holds no item, with their columns as they are."""
    leaks = _without_phrases(df, text, items, item_text, min_chars, block_bytes)
    for block in _blocks(leaks, item_id, item_text, 1, block_bytes):
        df = df.where(_holds_none(df.sparkSession.sparkContext.broadcast(block), rate, min_chars)(F.col(f"`{text}`")))
    return df


def _without_phrases(df: DataFrame, text: str, items: DataFrame, item_text: str, min_chars: int, block_bytes: int) -> DataFrame:
    """``items`` but for the short ones that are phrases; one pass over ``df`` if there are short ones."""

    @F.pandas_udf("string")
    def normal(part: pd.Series) -> pd.Series:
        return pd.Series(normal_text(pa.array(part, pa.string(), from_pandas=True).fill_null("")).to_pylist(), dtype=object)

    form = fresh(items, "normal form")
    known = items.withColumn(form, normal(F.col(f"`{item_text}`")))
    short = known.select(F.col(f"`{form}`").alias("item")).where(F.length("item").between(1, min_chars - 1)).distinct()
    if short.isEmpty():
        return items
    docs = df.select(F.lit(1).alias("document"), F.col(f"`{text}`").alias("text"))
    hits = find_items(docs, "document", "text", short.withColumn("copy", F.col("item")), "item", "copy", 0.0, min_chars, block_bytes)
    common = max(PHRASE_DOCUMENTS, PHRASE_SHARE * docs.count())
    phrases = materialize(hits.groupBy("item").count().where(F.col("count") > common), "phrases")
    return known.join(phrases, F.col(f"`{form}`") == F.col("item"), "left_anti").drop(form)


def _holds_none(shared, rate: float, min_chars: int):
    """A condition on texts: none of the items of a block is in them."""

    @F.arrow_udf("boolean")
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value, rate, min_chars)
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], names=["t"])
            free = [not matcher.find(t) for piece in slices(batch, "t") for t in normal_text(piece.column(0)).to_pylist()]
            yield pa.array(free, pa.bool_())

    return clean
