"""Quality rules: what a text shows by itself, and lines that many documents of a host share.

One pass over the texts gives the figures of every document and, for each of its distinct lines, a hash of
the line in normal form (lower case, single spaces; digits stay, so that rows of numbers differ) and its words.
This narrow table is written to the shared folder. Lines, and documents themselves, are counted by distinct documents
within their host in one aggregation, partly before the shuffle. Lines in more than ``floor`` documents and more than
``percent`` of their host's are removed, and a document that keeps less than ``min_kept`` of its words is rejected. The join of lines with frequent lines has at most one row for a key
on one side, so that a line that a third of all documents share can be split over tasks.

Null texts count as empty, null hosts as the host with the empty name. Documents without words fail the
rules. Repeated rows of one id count as one document and each get a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import code_words, hash_strings, map_texts, sums_of
from batchloom.session import materialize

SYMBOLS = b"#*$%&|<>"
#: A line in more distinct documents of one host than this number and this share of the host is boilerplate.
FLOOR, PERCENT = 5, 5
#: A document must keep this share of its words.
MIN_KEPT = 0.5
MIN_WORDS, MAX_REPEATED = 50, 50

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def normal_lines(lines: pa.Array) -> pa.Array:
    """Lines in the form in which they are compared over documents."""
    return pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(lines), "[ \t\n\v\f\r]+", " "))


def count_symbols(texts: pa.Array) -> np.ndarray:
    """Characters of every text that are one of SYMBOLS."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    wanted = np.zeros(256, dtype=bool)
    wanted[list(SYMBOLS)] = True
    data = texts.buffers()[2]
    if data is None or not lengths.sum():
        return np.zeros(len(texts), dtype=np.int64)
    first = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset]
    flat = np.frombuffer(data, dtype=np.uint8)[first : first + lengths.sum()]
    place = np.searchsorted(np.cumsum(lengths), np.flatnonzero(wanted[flat]), side="right")
    return np.bincount(place, minlength=len(texts)).astype(np.int64)


def repeated_words(codes: np.ndarray, counts: np.ndarray, kinds: int) -> np.ndarray:
    """Words of every text that lie in a window of three words found twice or more in that text."""
    n = len(codes)
    covered = np.zeros(n, dtype=bool)
    if n >= 3:
        text = np.repeat(np.arange(len(counts)), counts)
        if kinds < 1 << 21:
            key = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
        else:
            pair = np.unique(codes[:-2] * kinds + codes[1:-1], return_inverse=True)[1]
            key = pair * kinds + codes[2:]
        spot = np.flatnonzero(text[:-2] == text[2:])
        order = spot[np.argsort(key[spot], kind="stable")]  # texts stay in order within a key
        same = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        window = np.zeros(n, dtype=bool)
        window[order[1:][same]] = True
        window[order[:-1][same]] = True
        covered = window.copy()
        covered[1:] |= window[:-1]
        covered[2:] |= window[:-2]
    return sums_of(covered.astype(np.int64), counts)


def _texts_figures(texts: pa.Array) -> list[pa.Array]:
    """The five figures, then hashes and word counts of the distinct normal lines of every text."""
    codes, words, counts = code_words(texts)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = pc.split_pattern(texts, "\n")
    n_lines = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    line, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    line_words = code_words(distinct)[2]
    text = np.repeat(np.arange(len(texts)), n_lines)
    worded = line_words[line] > 0
    text, line = text[worded], line[worded]
    kinds = max(1, len(distinct))
    own = np.unique(text * kinds + line)
    n_worded = np.bincount(text, minlength=len(texts))
    n_dup = n_worded - np.bincount(own // kinds, minlength=len(texts))
    # Lines that are one in normal form count once in a document, with the words of all of them.
    normal = normal_lines(distinct).dictionary_encode()
    hashes = hash_strings(normal.dictionary).astype(np.int64)
    form = normal.indices.to_numpy().astype(np.int64)[line]
    forms = max(1, len(hashes))
    pair, which = np.unique(text * forms + form, return_inverse=True)
    held = np.bincount(which, weights=line_words[line], minlength=len(pair)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(pair // forms, minlength=len(texts)))]).astype(np.int32)
    figures = [
        counts,
        sums_of(chars[codes], counts),
        count_symbols(texts),
        n_dup,
        repeated_words(codes, counts, len(words)),
    ]
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v, pa.int64())) for v in (hashes[pair % forms] if len(hashes) else pair, held)]
    return [*(pa.array(f, pa.int64()) for f in figures), *lists]


def document_figures(df: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """row, doc_id, host, the figures, line_hash and line_words of every row."""
    chosen = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"),
        F.col(f"`{text}`").alias("text"),
    )

    def make():
        names = ["row", "doc_id", "host", *(f.split()[0] for f in FIGURES.split(", ")), "line_hash", "line_words"]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = _texts_figures(batch.column(3))
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *made], names=names)

        return work

    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, host string, {FIGURES}, line_hash array<long>, line_words array<long>"
    return map_texts(chosen, "text", make, schema)


def frequent_lines(figures: DataFrame, floor: int = FLOOR, percent: int = PERCENT) -> DataFrame:
    """(host, line_hash, n_documents) of lines in more than ``floor`` documents and ``percent`` of their host's."""
    # A row without a line stands for the document, so the host's size is counted along.
    every = F.concat("line_hash", F.array(F.lit(None).cast("long")))
    lines = figures.select("host", "doc_id", F.explode(every).alias("line_hash"))
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counted = lines.groupBy("host", "line_hash").agg(F.countDistinct(known).alias("n_documents")).where(F.col("n_documents") > floor)
    hosts = counted.where(F.col("line_hash").isNull()).select("host", F.col("n_documents").alias("n_host"))
    found = counted.where(F.col("line_hash").isNotNull()).join(hosts, "host")
    return found.where(100 * F.col("n_documents") > percent * F.col("n_host")).drop("n_host")


def apply_rules(
    df: DataFrame,
    doc_id: str,
    text: str,
    host: str,
    floor: int = FLOOR,
    percent: int = PERCENT,
    min_kept: float = MIN_KEPT,
) -> DataFrame:
    """The figures and the verdict for every row.

    Returns ``doc_id`` (under its name), host, the five figures, n_removed_words, base_failed and kept.
    """
    figures = materialize(document_figures(df, doc_id, text, host), "lines")
    frequent = materialize(frequent_lines(figures, floor, percent), "frequent")
    lines = figures.select("row", "host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l"))
    lines = lines.select("row", "host", F.col("l.line_hash").alias("line_hash"), F.col("l.line_words").alias("words"))
    removed = lines.join(frequent, ["host", "line_hash"]).groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    out = figures.drop("line_hash", "line_words").join(removed, "row", "left")
    gone = F.coalesce("n_removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    names = [f.split()[0] for f in FIGURES.split(", ")]
    return out.select(
        F.col("doc_id").alias(doc_id),
        "host",
        *names,
        gone.alias("n_removed_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("n_words") - gone >= min_kept * F.col("n_words"))).alias("kept"),
    )


def remove_lines(
    df: DataFrame, doc_id: str, text: str, host: str, floor: int = FLOOR, percent: int = PERCENT, into: str = "cleaned"
) -> DataFrame:
    """``df`` with ``into``: the text without the lines that are frequent in its host, else unchanged."""
    figures = materialize(document_figures(df, doc_id, text, host), "lines")
    lines = figures.select("doc_id", "host", F.explode("line_hash").alias("line_hash"))
    hits = lines.join(frequent_lines(figures, floor, percent), ["host", "line_hash"])
    # The frequent lines of one document are no more than its lines.
    gone = hits.groupBy(F.col("doc_id").alias("hit doc"), F.col("host").alias("hit host")).agg(F.collect_set("line_hash").alias("hit lines"))
    key_id = df[f"`{doc_id}`"].eqNullSafe(gone["`hit doc`"])
    key_host = F.coalesce(df[f"`{host}`"].cast("string"), F.lit("")) == gone["`hit host`"]
    whole = df.join(gone, key_id & key_host, "left")

    @F.pandas_udf("string")
    def cleaned(texts, hashes):
        out = []
        for value, found in zip(texts, hashes):
            if value is None or found is None or not len(found):
                out.append(value)
                continue
            parts, drop = value.split("\n"), set(found)
            form = hash_strings(normal_lines(pa.array(parts))).astype(np.int64).tolist()
            out.append("\n".join(p for p, h in zip(parts, form) if h not in drop))
        import pandas as pd

        return pd.Series(out, dtype=object)

    return whole.select(*(df[f"`{c}`"] for c in df.columns if c != into), cleaned(df[f"`{text}`"], gone["`hit lines`"]).alias(into))
