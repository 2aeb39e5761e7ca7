"""Byte-level BPE encoding and decoding in batched merge rounds.

A vocabulary file in the JSON format of the ``tokenizers`` library is read once on the driver (its size
is that of the vocabulary) and broadcast. A task splits its texts into words, and merges the words it
has not met yet all at once: the symbols of all of them lie in one flat array, the rank of every
adjacent pair is found by binary search over the sorted pair keys, and each round merges the pair of the
lowest rank in every word. Words that are done leave the array. There is no shuffle.

Null texts count as empty and have no ids. Texts of any length are encoded whole. Ids unknown to the
vocabulary decode to nothing, as the library does.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import fresh, map_texts, pick

#: Words that are merged at a time, so that their symbols stay in the processor's cache.
MERGE_WORDS = 20_000
#: Words that a Python worker keeps with their ids. Beyond that it keeps those met first, which are mostly
#: the frequent ones.
CACHE_WORDS, KEPT_WORDS = 400_000, 100_000
NEVER = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """Byte symbols, sorted pair keys with rank and product, and the bytes of every id."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    products: np.ndarray
    tokens: np.ndarray
    added: dict[str, int]
    patterns: tuple[str, str]
    words: dict[str, bytes] = field(default_factory=dict)


# Fixed value: how byte-level vocabularies split text into words.
WORDS = r"'(?:s|t|re|ve|m|ll|d)| ?{letters}+| ?{numbers}+| ?[^{outside}]+|{space}+(?!{dark})|{space}+"


@cache
def word_patterns() -> tuple[str, str]:
    """The split for ``re``, fast but for code points of 16 bits only, and for ``regex``, for all text.

    ``re`` knows no Unicode properties, so that letters, numbers and white space are listed as ranges.
    """
    ranges = []
    for name in ("L", "N", "White_Space"):
        fits, found = regex.compile(rf"\p{{{name}}}").match, []
        for point in range(0x10000):
            if fits(chr(point)):
                if found and found[-1][1] == point - 1:
                    found[-1][1] = point
                else:
                    found.append([point, point])
        ranges.append("".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in found))
    letters, numbers, space = ranges
    fast = WORDS.format(
        letters=f"[{letters}]", numbers=f"[{numbers}]", outside="".join(ranges), space=f"[{space}]", dark=f"[^{space}]"
    )
    whole = WORDS.format(
        letters=r"\p{L}", numbers=r"\p{N}", outside=r"\p{White_Space}\p{L}\p{N}", space=r"\p{White_Space}", dark=r"\P{White_Space}"
    )
    return fast, whole


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file. Settings that this module does not follow are refused by name."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or odd or spec.get("normalizer"):
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary {odd}")
    if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
        raise ValueError(f"{path}: another pre-tokenizer than byte-level words")
    letters = _byte_letters()
    back = {letter: b for b, letter in enumerate(letters)}
    vocab = model["vocab"]
    tokens = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]))
    for token, i in vocab.items():
        tokens[i] = bytes(back[c] for c in token)
    added = {}
    for token in spec.get("added_tokens", []):
        if token.get("lstrip") or token.get("rstrip") or token.get("single_word"):
            raise ValueError(f"{path}: added token {token['content']!r} takes text beside it")
        added[token["content"]] = token["id"]
        tokens[token["id"]] = token["content"].encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    first = {}
    for rank, (a, b) in enumerate(pairs):
        first.setdefault((vocab[a] << 32) | vocab[b], (rank, vocab[a + b]))
    keys = np.array(sorted(first), dtype=np.int64)
    ranks, products = (np.array([first[k][i] for k in keys.tolist()], dtype=np.int64) for i in (0, 1))
    byte_ids = np.array([vocab[letter] for letter in letters], dtype=np.int64)
    return Vocabulary(byte_ids, keys, ranks, products, np.array(tokens, dtype=object), added, word_patterns())


def _find(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and product of pairs; NEVER for those that do not merge."""
    if not len(vocabulary.keys):
        return np.full(len(left), NEVER), np.zeros(len(left), dtype=np.int64)
    key = (left << 32) | right
    slot = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
    known = vocabulary.keys[slot] == key
    return np.where(known, vocabulary.ranks[slot], NEVER), vocabulary.products[slot]


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(words)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    symbol = vocabulary.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    rank = np.full(len(symbol), NEVER, dtype=np.int64)
    product = np.zeros(len(symbol), dtype=np.int64)
    dirty = np.arange(len(symbol))
    while len(symbol):
        dirty = dirty[dirty < len(symbol) - 1]
        rank[-1] = NEVER
        found, made = _find(vocabulary, symbol[dirty], symbol[dirty + 1])
        rank[dirty] = np.where(word[dirty] == word[dirty + 1], found, NEVER)
        product[dirty] = made
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(word)))
        best = np.minimum.reduceat(rank, first)
        done = best == NEVER
        if done.any():
            gone = np.repeat(done, size)
            packed, at = symbol[gone].astype("<u4").tobytes(), 0
            for w, n in zip(word[first[done]].tolist(), (4 * size[done]).tolist()):
                out[w] = packed[at : at + n]
                at += n
            stay = ~gone
            symbol, word, rank, product = symbol[stay], word[stay], rank[stay], product[stay]
            best, size = best[~done], size[~done]
            if not len(symbol):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        # Of pairs that overlap (a letter repeated), every second one from the left of each run merges.
        run = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 1]))
        turn = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
        hit = hit[turn % 2 == 0]
        symbol[hit] = product[hit]
        stay = np.ones(len(symbol), dtype=bool)
        stay[hit + 1] = False
        place = np.cumsum(stay) - 1
        symbol, word, rank, product = symbol[stay], word[stay], rank[stay], product[stay]
        touched = place[hit]
        mark = np.zeros(len(symbol) + 1, dtype=bool)
        mark[touched] = mark[touched - 1] = True
        dirty = np.flatnonzero(mark[:-1])
    return out


def _trim(cache: dict) -> None:
    if len(cache) > CACHE_WORDS:
        for key in list(cache)[KEPT_WORDS:]:
            del cache[key]


class Encoder:
    """Texts to ids in one process; words that were merged before are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        fast, whole = vocabulary.patterns
        self.fast, self.whole = re.compile(fast).findall, regex.compile(whole).findall
        self.wide = re.compile("[\U00010000-\U0010ffff]").search
        special = sorted(vocabulary.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _words(self, text: str) -> list[str]:
        split = self.whole if self.wide(text) else self.fast
        if self.special is None or not self.special.search(text):
            return split(text)
        parts = self.special.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else split(part))]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known = self.vocabulary.words
        _trim(known)
        known.update((w, np.array([i], dtype="<u4").tobytes()) for w, i in self.vocabulary.added.items())
        split = [self._words(t) for t in texts]
        new = [w for w in set().union(*split) if w not in known]
        for i in range(0, len(new), MERGE_WORDS):
            some = new[i : i + MERGE_WORDS]
            known.update(zip(some, merge_words([w.encode() for w in some], self.vocabulary)))
        return [b"".join(map(known.__getitem__, words)) for words in split]


def decode_packed(packed: bytes, vocabulary: Vocabulary) -> str:
    """Text of ids; bytes that are no UTF-8 become replacement characters."""
    ids = np.frombuffer(packed, dtype="<u4")
    ids = ids[ids < len(vocabulary.tokens)]
    return b"".join(vocabulary.tokens[ids].tolist()).decode("utf-8", "replace")


def _shared(spark: SparkSession, vocabulary: Vocabulary | str):
    """The parts of a vocabulary for the tasks, as plain arrays: their size is that of the file.

    Tasks of one Python worker share the words they have met.
    """
    whole = load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    return spark.sparkContext.broadcast(vars(whole) | {"words": {}})


def encode(
    df: DataFrame, text: str, vocabulary: Vocabulary | str, into: str = "ids", verified: str | None = None
) -> DataFrame:
    """``df`` with the ids of ``text`` as ``into`` (array of int); a column of that name is replaced.

    ``verified`` names a column that says whether the ids decode to the text.
    """
    extra = [into] if verified is None else [into, verified]
    shared, rest = _shared(df.sparkSession, vocabulary), [c for c in df.columns if c not in extra]

    def make():
        vocabulary = Vocabulary(**shared.value)
        encoder = Encoder(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(key)).to_pylist()
            packed = encoder.packed(texts)
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
            names = [n for n in batch.schema.names if n != key]
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != key]
            made = [pa.ListArray.from_arrays(pa.array(ends), flat)]
            if verified is not None:
                made.append(pa.array([decode_packed(p, vocabulary) == t for p, t in zip(packed, texts)], pa.bool_()))
            return pa.RecordBatch.from_arrays([*keep, *made], names=[*names, *extra])

        return work

    key = fresh(df, "text to encode")
    chosen = pick(df, *rest).withColumn(key, F.col(f"`{text}`"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != key)
    more = [f"`{into}` array<int>"] if verified is None else [f"`{into}` array<int>", f"`{verified}` boolean"]
    return map_texts(chosen, key, make, ", ".join([f for f in [fields, *more] if f]))


def decode(df: DataFrame, ids: str, vocabulary: Vocabulary | str, into: str = "decoded") -> DataFrame:
    """``df`` with the text of the array ``ids`` as ``into``; null arrays give empty text."""
    shared = _shared(df.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def decoded(column):
        vocabulary = Vocabulary(**shared.value)
        return column.map(
            lambda row: "" if row is None else decode_packed(np.asarray(row, dtype="<u4").tobytes(), vocabulary)
        )

    return df.withColumn(into, decoded(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, doc_id: str, text: str, vocabulary: Vocabulary | str) -> DataFrame:
    """Encode every text, decode it again: count and digest of the ids, digest and match of the text.

    Returns ``doc_id`` (under its name), n_tokens, ids_sha256, decoded_sha256 and same_text. Arrays of
    ids stay in the task.
    """
    shared = _shared(df.sparkSession, vocabulary)

    def make():
        vocabulary = Vocabulary(**shared.value)
        encoder = Encoder(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            packed = encoder.packed(texts)
            back = [decode_packed(p, vocabulary) for p in packed]
            columns = [
                batch.column(0),
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                pa.array([a == b for a, b in zip(texts, back)]),
            ]
            names = [doc_id, "n_tokens", "ids_sha256", "decoded_sha256", "same_text"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        return work

    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean"
    return map_texts(pick(df, doc_id, text), text, make, schema)
