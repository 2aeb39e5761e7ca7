"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its shingles of five words, each labelled with how often it has occurred
before, so that the labelled shingles of one text are all different. An element of the sketch is the
``TAKEN`` labelled shingles of least hash *in the order in which they stand in the text*: it is equal for
two texts only if they share these shingles in the same order, and so follows their edit similarity, not
that of unordered sets. ``ROWS`` elements form a band; texts that agree in a band are candidates.

The similarity of two texts is that of their alignment: shingles matched in order, over all shingles of
both (a Jaccard similarity that respects order and repetition). Only matches within the band of
positions that the threshold allows are looked at, and the longest chain of them is found.

How the work stays small:

1. Equal word sequences collapse into classes first; one text of each class takes part in what follows.
2. Every member of a bucket is compared with the bucket's leader, the member that shares most buckets with
   others, as the original of many edited copies does. Verified pairs are joined to components.
3. Every pair of members of a bucket that is in different components then is settled as well, whatever the
   two have to do with the leader. The texts of buckets with more than one component are joined by prefixes:
   the shingles of each are put in one order, rare ones first, and of two similar texts the first shingle in
   both stands among the first fifth of either. Rows of that join that cannot be a link are dropped by exact
   bounds: what is left behind the common shingle, and the least difference that the parity bitmaps of both
   texts show. The pairs left are aligned. Pairs within a component could not change the classes: no group of
   near copies is expanded into all pairs.

What is lost is what MinHash loses, pairs that meet in no band: of similarity 0.8 less than one pair in
10,000 by the formula at ``BANDS``.

Only texts that share a bucket with another one travel. Words are what stands between ASCII white space, in
lower case. A text of fewer than five words is one shingle. Null texts and texts without words are like
no other: each is a class of its own. Repeated ids are one document.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import code_words, hash_strings, map_texts, mix64, slices, starts_of
from batchloom.llm.components import connected_components
from batchloom.llm.sketch import sketch, with_maybe
from batchloom.session import materialize

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles in an element, elements in a band, bands. Two texts of similarity s agree in an element with
#: about s ** TAKEN, and meet in some band with 1 - (1 - s ** (TAKEN * ROWS)) ** BANDS: 0.9999 at 0.8.
TAKEN, ROWS, BANDS = 2, 2, 20
#: Counters by which rare shingles come first (how many they are decides the cost alone), and 64-bit words
#: of the parity bitmap of a text.
COUNTERS, WORDS = 1 << 18, 8
_BLOCK = 1 << 15


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the labelled shingles of every text, one text after another, and how many each has."""
    codes, words, counts = code_words(pc.utf8_lower(texts))
    hashed = mix64(hash_strings(words))
    word = hashed[codes] if len(words) else np.zeros(0, np.uint64)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    value = np.zeros(len(word), dtype=np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    for k in range(SHINGLE):
        inside = len(word) - k
        if inside <= 0:
            break
        same = text[k:] == text[:inside]
        value[:inside] = np.where(same, mix64(value[:inside] * np.uint64(0x9E3779B97F4A7C15) + word[k:]), value[:inside])
    place = np.arange(len(word)) - np.repeat(starts_of(counts), counts)
    first = place < np.repeat(n, counts)
    value, text = value[first], text[first]
    # Occurrence labels: a stable sort puts equal shingles of a text beside each other, in text order.
    order = np.lexsort((value, text))
    v, t = value[order], text[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    label = np.arange(len(v)) - np.repeat(at, np.diff(np.append(at, len(v))))
    labels = np.zeros(len(v), dtype=np.uint64)
    labels[order] = label.astype(np.uint64)
    return np.where(labels > 0, mix64(value + labels * np.uint64(0xD6E8FEB86659FD93)), value), n


def band_keys(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The key of every band for every text with shingles: shape (texts, BANDS)."""
    keys = np.zeros((len(n), BANDS), dtype=np.uint64)
    full = np.flatnonzero(n)
    starts, sizes = starts_of(n)[full], n[full]
    if not len(full):
        return keys
    place = (np.arange(len(hashes)) - np.repeat(starts, sizes)).astype(np.uint64)
    # Low bits tell the position, so that a minimum also says where it stands.
    width = np.uint64(max(24, int(sizes.max() - 1).bit_length() + 1))
    low = (np.uint64(1) << width) - np.uint64(1)
    top = np.uint64(np.iinfo(np.uint64).max)
    for band in range(BANDS):
        key = np.full(len(full), band, dtype=np.uint64)
        for row in range(ROWS):
            seed = mix64(np.array([band * ROWS + row + 1], dtype=np.uint64))[0]
            value = np.empty(len(hashes), dtype=np.uint64)
            for i in range(0, len(hashes), _BLOCK):
                value[i : i + _BLOCK] = (mix64(hashes[i : i + _BLOCK] ^ seed) & ~low) | place[i : i + _BLOCK]
            spots = []
            for _ in range(TAKEN):
                least = np.minimum.reduceat(value, starts)
                spot = np.where(least == top, -1, (least & low).astype(np.int64))
                spots.append(spot)
                value[(starts + np.maximum(spot, 0))] = top
            ordered = np.sort(np.stack(spots), axis=0)
            for spot in ordered:
                part = np.where(spot < 0, np.uint64(0), hashes[starts + np.maximum(spot, 0)])
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part)
        keys[full, band] = key
    return keys


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Of two sequences of different hashes: those matched in order over those in either; 0 below threshold.

    Texts as similar as ``threshold`` differ by at most (1 - threshold) / (1 + threshold) of their joint
    length, so a match can stand no further apart than that.
    """
    if not len(a) or not len(b) or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    need = threshold * total / (1 + threshold) - 1e-9
    near = np.abs(i - j) <= total - 2 * need
    i, j = i[near], j[near]
    if len(i) < need:
        return 0.0
    chain: list[int] = []
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        matched = len(j)
    else:
        for x in j.tolist():
            at = bisect_left(chain, x)
            chain[at : at + 1] = [x]
        matched = len(chain)
    value = matched / (total - matched)
    return value if matched >= need else 0.0


def _sequence_keys(texts: pa.Array) -> list[np.ndarray]:
    """Two 64-bit keys of the word sequence of every text."""
    codes, words, counts = code_words(pc.utf8_lower(texts))
    word = hash_strings(words)[codes] if len(words) else np.zeros(0, np.uint64)
    place = (np.arange(len(codes)) - np.repeat(starts_of(counts), counts)).astype(np.uint64)
    out = []
    for seed in (np.uint64(11), np.uint64(13)):
        value = mix64(mix64(word ^ seed) + place)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        ends = np.cumsum(counts)
        out.append(total[ends] - total[ends - counts])
    return out


def _sketch(df: DataFrame) -> DataFrame:
    """(id, n, k1, k2, keys) of (id, text): shingles, keys of the word sequence, and band keys."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1)
            hashes, n = shingles(texts)
            keys = band_keys(hashes, n)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].ravel().astype(np.int64)))
            whole = [pa.array(k.astype(np.int64)) for k in _sequence_keys(texts)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *whole, lists], names=["id", "n", "k1", "k2", "keys"])

        return work

    kind = df.schema["id"].dataType.simpleString()
    return map_texts(df, "text", make, f"id {kind}, n long, k1 long, k2 long, keys array<long>")


def _compared(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of texts with their similarity, 0 below the threshold."""
    kind = texts.schema["id"].dataType.simpleString()
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    whole = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text_a"):
                both = [shingles(piece.column(k).fill_null("")) for k in (2, 3)]
                parts = [np.split(h, np.cumsum(n)[:-1]) for h, n in both]
                value = [similarity(x, y, threshold) for x, y in zip(*parts)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(value, pa.float64())], names=["a", "b", "similarity"])

    return whole.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def _links(compared: DataFrame) -> DataFrame:
    return compared.where("similarity > 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def _open_texts(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """(id, component) of the members of all buckets that hold more than one component."""
    placed = buckets.join(components.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("band", "key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    return placed.join(mixed.select("band", "key"), ["band", "key"], "left_semi").select("id", "component").distinct()


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % COUNTERS


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How many shingles of ``texts`` fall on each of COUNTERS counters."""

    def run(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                total += np.bincount(_counters(shingles(piece.column(0))[0]), minlength=COUNTERS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["counter", "n"])

    counted = texts.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    return out


def parity_bitmaps(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of every text, which of 64 * WORDS bits an odd number of its shingles has: shape (texts, WORDS).

    Shingles in both texts cancel out, so two bitmaps differ in no more bits than the texts in shingles.
    """
    bits = 64 * WORDS
    text = np.repeat(np.arange(len(n)), n)
    odd = np.bincount(text * bits + (hashes % np.uint64(bits)).astype(np.int64), minlength=len(n) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(n), WORDS)


def prefixes(hashes: np.ndarray, n: np.ndarray, frequency: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingles of every text, as many as are needed to meet any similar one: text, place, hash."""
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, frequency[_counters(hashes)], text))
    place = np.arange(len(hashes)) - np.repeat(starts_of(n), n)
    first = place < np.repeat(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, n)
    return text[first], place[first], hashes[order][first]


def _open_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ``texts`` (id, component, text) in different components that may be similar; none that is fails."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(_frequencies(texts))
    kind = texts.schema["id"].dataType.simpleString()
    bitmap = [f"bits{i}" for i in range(WORDS)]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, n = shingles(batch.column(2))
            text, place, shingle = prefixes(hashes, n, shared.value, threshold)
            maps = parity_bitmaps(hashes, n)[text]
            ids = [batch.column(i).take(pa.array(text)) for i in (0, 1)]
            numbers = [pa.array(v) for v in (shingle.astype(np.int64), n[text], place, *maps.T.copy())]
            return pa.RecordBatch.from_arrays([*ids, *numbers], names=["id", "component", "shingle", "n", "place", *bitmap])

        return work

    schema = f"id {kind}, component {kind}, shingle long, n long, place long, " + ", ".join(f"{b} long" for b in bitmap)
    rows = materialize(map_texts(texts.select("id", "component", "text"), "text", make, schema), "prefixes")

    def side(end: str) -> DataFrame:
        return rows.select("shingle", *(F.col(c).alias(f"{c}_{end}") for c in rows.columns if c != "shingle"))

    n = F.col("n_x") + F.col("n_y")
    need = n * (threshold / (1 + threshold)) - 1e-6
    apart = (F.col("component_x") != F.col("component_y")) & (F.col("id_x") < F.col("id_y"))
    sizes = (F.col("n_x") >= threshold * F.col("n_y")) & (F.col("n_y") >= threshold * F.col("n_x"))
    behind = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) >= need
    differ = sum((F.bit_count(F.col(f"{b}_x").bitwiseXOR(F.col(f"{b}_y"))) for b in bitmap[1:]), F.bit_count(F.col("bits0_x").bitwiseXOR(F.col("bits0_y"))))
    met = side("x").join(side("y"), "shingle").where(apart & sizes & behind & (differ <= n - 2 * need))
    return met.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with these ids. A Bloom sketch of the ids keeps the other texts from travelling."""
    wanted = materialize(ids, "wanted")
    merged, chunks = sketch(wanted.select(F.xxhash64("id").alias("h")), "h", wanted.count(), 1)
    near = with_maybe(docs.withColumn("h", F.xxhash64("id")), "h", merged, chunks).where("maybe")
    return near.select("id", "text").join(wanted, "id", "left_semi")


def near_duplicates(df: DataFrame, doc_id: str, text: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of near-duplicates, and the verified links between different texts.

    The first table has one row for every document: ``doc_id``, ``representative`` (the least id with the
    same words) and ``class_id`` (the least id of the class). The second has ``a``, ``b`` (representatives)
    and their similarity; links within a component that were not needed to find it are not listed.
    """
    docs = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("id").isNotNull())
    sketches = materialize(_sketch(docs), "sketches")
    first = sketches.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("first"))
    kept = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id"))
    members = sketches.join(first, ["k1", "k2"], "left").groupBy("id").agg(F.min(kept).alias("representative"))
    members = materialize(members, "members")
    # Of equal texts, the first stands for all.
    alone = sketches.where("n > 0").join(members.where("id = representative").select("id"), "id", "left_semi")
    rows = alone.select("id", "n", F.posexplode("keys").alias("band", "key"))
    sizes = F.col("n_a") >= threshold * F.col("n_b"), F.col("n_b") >= threshold * F.col("n_a")

    counts = rows.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = materialize(rows.join(counts, ["band", "key"]), "buckets")
    popular = buckets.groupBy("id").agg(F.sum("m").alias("popular"))
    ranked = buckets.drop("m").join(popular, "id")
    leaders = ranked.groupBy("band", "key").agg(F.max(F.struct("popular", "id", "n")).alias("l"))
    star = buckets.drop("m").join(leaders, ["band", "key"])
    star = star.select(F.col("l.id").alias("a"), F.col("id").alias("b"), F.col("l.n").alias("n_a"), F.col("n").alias("n_b"))
    star = materialize(star.where(F.col("a") != F.col("b")).where(sizes[0] & sizes[1]).select("a", "b").distinct(), "pairs")
    texts = materialize(_texts_of(docs, buckets.select("id").distinct()), "texts")
    links = _links(materialize(_compared(star, texts, threshold), "compared"))
    found = materialize(connected_components(links, "a", "b"), "components")

    # What is left to compare: texts in one bucket but in different components.
    left = materialize(texts.join(_open_texts(buckets, found), "id"), "open")
    seen = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = materialize(_open_pairs(left, threshold).join(seen, ["a", "b"], "left_anti"), "pairs")
    links = links.unionAll(_links(materialize(_compared(cross, texts, threshold), "compared")))
    classes = connected_components(links, "a", "b").withColumnRenamed("node", "representative")
    out = members.join(classes, "representative", "left")
    return (
        out.select(F.col("id").alias(doc_id), "representative", F.coalesce("component", "representative").alias("class_id")),
        links,
    )


def keep_one(df: DataFrame, doc_id: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with one document, that of the least id, of each class; rows without an id stay."""
    classes, _ = near_duplicates(df, doc_id, text, threshold)
    gone = classes.where(F.col(f"`{doc_id}`") != F.col("class_id")).select(F.col(f"`{doc_id}`").alias("gone"))
    return df.join(gone, df[f"`{doc_id}`"] == gone["gone"], "left_anti")
