"""Toxicity by the nearest labelled examples under TF-IDF cosine, found in a block-max inverted index.

Examples are a bounded, documented sample of labelled rows. The vector of a text has all its words: 1 + ln(occurrences),
times the inverse document frequency over all documents, times DULL for words that don't speak for toxicity (by their
log-likelihood ratio in the sample). So a text is judged by what it says where it says something, and by all its words
where it doesn't: a copy of a toxic example is found whatever its words are. Words that no example holds count in the
length of a vector like words of a single document.

Examples that are alike lie in one block. Postings know the largest weight of a term in each block; terms that are dull
and in many examples have no postings but a dense row, bounded by the lengths of both sides (Cauchy-Schwarz). A block is
scored exactly only if its bound reaches NEAR and the least cosine that still counts. The neighbours of a text
are the ``k`` nearest examples of a cosine of NEAR or more, and all that tie with the last to TIE; the search is exact.

The vote of the neighbours, weighted by squared cosine, is calibrated on examples, each without itself, with the
classes weighted as they are among all labelled rows. Texts without a neighbour get the share of toxic ones among the
examples without any.

The index (bounded by the sample) is broadcast; documents are scored where they are read, many at a time. Null and
empty texts have no neighbour. Each of several rows of one id gets its own result, an empty table none; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import gather, labelled_sample, map_texts, slices, starts_of
from batchloom.llm.langid import letter_words

#: Examples of each class in the index, neighbours that vote, examples in a block.
EXAMPLES, NEIGHBOURS, BLOCK = 3000, 15, 64
#: A word speaks for toxicity if it is in so many examples, has this log-likelihood ratio, and is in toxic ones so many times
#: as often as in others (words of a language that toxic texts prefer are not toxic); others weigh DULL of it.
MIN_DOCUMENTS, MIN_RATIO, MIN_LIFT, DULL = 4, 12.0, 3.0, 0.005
#: The least cosine of a neighbour; neighbours as near as the last one to this tie with it.
NEAR, TIE = 0.5, 0.02
#: A dull term in more than one of so many examples has a dense row.
HEAVY = 10
THRESHOLD = 0.3
#: Examples that the votes are calibrated on.
CALIBRATED = 1000
#: Texts, and their postings, that are compared with the index at a time, and blocks of each that are scored first.
TOGETHER, POSTINGS, SEEDS = 256, 1 << 20, 2
#: Of bounds against rounding.
SLACK = 1e-5


@dataclass
class ToxicIndex:
    """Weights of terms, postings in blocks of examples, dense rows of heavy terms, and the calibration."""

    terms: dict[str, int]
    weight: np.ndarray
    unknown: float
    signal: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    heavy: np.ndarray
    heavy_rows: np.ndarray
    heavy_max: np.ndarray
    first_entry: np.ndarray
    entry_block: np.ndarray
    entry_max: np.ndarray
    first_posting: np.ndarray
    posting_row: np.ndarray
    posting_weight: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    without: float = 0.0


Vectors = tuple[np.ndarray, np.ndarray, np.ndarray]


def text_vectors(texts: pa.Array, terms: dict[str, int], weight: np.ndarray, unknown: float) -> Vectors:
    """(text, term, weight) of the known terms of every text; with the unknown ones, vectors have length 1."""
    codes, words, counts = letter_words(texts)
    known = np.fromiter((terms.get(w, -1) for w in words.to_pylist()), np.int64, len(words))
    kinds = max(1, len(words))
    pair, times = np.unique(np.repeat(np.arange(len(texts)), counts) * kinds + codes, return_counts=True)
    text, term = pair // kinds, known[pair % kinds] if len(pair) else pair
    raw = (1 + np.log(times)) * (np.where(term >= 0, weight[term], unknown) if len(weight) else unknown)
    length = np.sqrt(np.bincount(text, raw**2, minlength=len(texts)))
    own = term >= 0
    return text[own], term[own], (raw / length[text])[own]


def _word_counts(sample: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float, float]:
    """Words of the sample, in how many toxic and other texts each is, and the number of both.

    Examples of equal text count once, so that a text that was copied does not make its words terms.
    """
    distinct = sample.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.min("key").alias("key"))
    once = sample.join(distinct.select("key"), "key", "left_semi")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, words, counts = letter_words(batch.column(0))
            kinds = max(1, len(words))
            toxic = np.repeat(np.asarray(batch.column(1).to_pylist(), dtype=bool), counts)
            own, at = np.unique(np.repeat(np.arange(len(counts)), counts) * kinds + codes, return_index=True)
            word = own % kinds
            bad = np.bincount(word[toxic[at]], minlength=len(words))
            return pa.RecordBatch.from_arrays(
                [words, pa.array(bad, pa.int64()), pa.array(np.bincount(word, minlength=len(words)) - bad, pa.int64())],
                names=["word", "bad", "good"],
            )

        return work

    counted = map_texts(once.select("text", (F.col("label") == 1).alias("toxic")), "text", make, "word string, bad long, good long")
    found = counted.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).orderBy("word").toArrow()
    totals = once.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("b"), F.count("*").alias("n")).head()
    bad, good = (found.column(c).to_numpy().astype(float) for c in ("bad", "good"))
    return found.column("word").to_pylist(), bad, good, float(totals["b"]), float(totals["n"] - totals["b"])


def speaks(bad: np.ndarray, good: np.ndarray, all_bad: float, all_good: float) -> np.ndarray:
    """Which words are in toxic texts more often than by chance, by their log-likelihood ratio."""
    if not all_bad or not all_good:
        return np.zeros(len(bad), bool)
    share = (bad + good) / (all_bad + all_good)

    def part(seen: np.ndarray, rows: float) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / (rows * share)), 0.0)

    ratio = 2 * (part(bad, all_bad) + part(good, all_good))
    return (bad + good >= MIN_DOCUMENTS) & (bad * all_good >= MIN_LIFT * good * all_bad) & (ratio >= MIN_RATIO)


def _document_frequencies(df: DataFrame, text: str, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and the number of documents; a task adds up what it reads."""
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        found = np.zeros(len(place) + 1, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, "t"):
                codes, words, counts = letter_words(piece.column(0))
                kinds = max(1, len(words))
                own = np.unique(np.repeat(np.arange(len(counts)), counts) * kinds + codes) % kinds
                known = np.fromiter((place.get(w, -1) for w in words.to_pylist()), np.int64, len(words))
                term = known[own] if len(own) else own
                found[:-1] += np.bincount(term[term >= 0], minlength=len(place))
                found[-1] += piece.num_rows
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(found[held])], names=["term", "n"])

    counted = df.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1)
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return out[:-1], int(out[-1])


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, examples: int = EXAMPLES) -> ToxicIndex:
    """Index about ``examples`` labelled documents of each class, chosen by a hash of ``key``.

    ``documents`` are all documents, for the document frequencies; ``labels`` has the keys that may be
    learned from, with ``label`` 0 or 1.
    """
    sample, all_counts = labelled_sample(documents, labels, key, text, label, examples)
    words, bad, good, all_bad, all_good = _word_counts(sample)
    terms = {w: i for i, w in enumerate(words)}
    frequency, n = _document_frequencies(documents, text, terms)
    signal = speaks(bad, good, all_bad, all_good)
    weight = (np.log((1 + n) / (1 + frequency)) + 1) * np.where(signal, 1.0, DULL)
    unknown = (np.log((1 + n) / 2) + 1) * DULL if n else DULL
    shared = sample.sparkSession.sparkContext.broadcast((terms, weight, unknown))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, term, value = text_vectors(batch.column(2), *shared.value)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((term, pa.int64()), (value, pa.float64()))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["key", "label", "terms", "values"])

        return work

    kind = sample.schema["key"].dataType.simpleString()
    rows = map_texts(sample.select("key", "label", "text"), "text", make, f"key {kind}, label long, terms array<long>, values array<double>").orderBy("key").toArrow()
    sizes = pc.list_value_length(rows.column("terms")).to_numpy().astype(np.int64)
    flat = [rows.column(c).combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0) for c in ("terms", "values")]
    vectors = np.repeat(np.arange(len(sizes)), sizes), flat[0].astype(np.int64), flat[1]
    ids, labels_of = rows.column("key").to_pylist(), rows.column("label").to_numpy()
    del rows, flat, words, bad, good, frequency
    return build(ids, labels_of, vectors, terms, weight, unknown, signal, all_counts)


def build(
    ids: list, labels: np.ndarray, vectors: Vectors, terms: dict[str, int], weight: np.ndarray, unknown: float, signal: np.ndarray, all_counts: dict
) -> ToxicIndex:
    """The index of examples given by their vectors, calibrated. ``all_counts``: labelled rows of each class."""
    n = len(ids)
    row, term, value = vectors
    # Examples of the same heaviest terms become neighbours in the order of the index.
    by = np.lexsort((term, -np.round(value, 9), row))
    rank = np.arange(len(by)) - starts_of(np.bincount(row, minlength=n))[row[by]]
    lead = np.full((n, 6), -1, np.int64)
    lead[row[by][rank < 6], rank[rank < 6]] = term[by][rank < 6]
    del by, rank
    order = np.lexsort(lead.T[::-1]) if n else np.zeros(0, np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    row = place[row]
    labels = np.asarray(labels, np.int64)[order]
    held = {c: int((labels == c).sum()) for c in (0, 1)}
    share = [all_counts.get(c, 0) / max(1, held[c]) for c in (0, 1)]  # what an example stands for

    width = max(1, len(terms))
    heavy = np.full(width, -1, np.int64)
    many = np.bincount(term, minlength=width) * HEAVY > n
    many[: len(signal)] &= ~signal
    heavy[many] = np.arange(many.sum())
    dense = np.zeros((n, int(many.sum())), np.float32)
    at = heavy[term]
    dense[row[at >= 0], at[at >= 0]] = value[at >= 0]
    blocks = max(1, -(-n // BLOCK))
    longest = np.zeros(blocks)
    np.maximum.at(longest, np.arange(n) // BLOCK, np.sqrt((dense.astype(float) ** 2).sum(axis=1)))

    light = np.flatnonzero(at < 0)
    light = light[np.lexsort((row[light], term[light]))]
    key = term[light] * blocks + row[light] // BLOCK
    first = np.flatnonzero(np.diff(key, prepend=-1))
    peak = np.maximum.reduceat(value[light], first) if len(first) else np.zeros(0)
    del at
    index = ToxicIndex(
        terms, weight, float(unknown), signal, np.array(ids, dtype=object)[order], labels, np.array([share[c] for c in labels.tolist()]),
        heavy, dense, longest,
        np.searchsorted(key[first], np.arange(width + 1) * blocks), key[first] % blocks, peak,
        np.append(first, len(light)), row[light].astype(np.int32), value[light],
    )
    del key, light, first, peak
    by = np.argsort(row, kind="stable")
    row, term, value = row[by], term[by], value[by]
    del by
    _calibrate(index, (row, term, value))
    return index


def neighbours(index: ToxicIndex, vectors: Vectors, n: int, k: int = NEIGHBOURS, but: np.ndarray | None = None) -> Vectors:
    """(text, row of the example, cosine) for the neighbours of ``n`` texts: by text, nearest first.

    ``but`` gives a row for each text that does not count.
    """
    blocks = len(index.heavy_max)
    doc, term, value = vectors
    column = index.heavy[term]
    dense = np.zeros((n, index.heavy_rows.shape[1]), np.float32)
    dense[doc[column >= 0], column[column >= 0]] = value[column >= 0]
    light = column < 0
    doc, term, value = doc[light], term[light], value[light]
    count = index.first_entry[term + 1] - index.first_entry[term]
    entry = gather(index.first_entry[term], count)
    doc, value, block = np.repeat(doc, count), np.repeat(value, count), index.entry_block[entry]
    tile = doc * blocks + block
    bound = np.bincount(tile, value * index.entry_max[entry], n * blocks).astype(float).reshape(n, blocks)
    bound += np.sqrt((dense.astype(float) ** 2).sum(axis=1))[:, None] * index.heavy_max + SLACK

    def score(wanted: np.ndarray) -> Vectors:
        """Exact cosines of NEAR or more in the wanted blocks of each text."""
        tiles = np.flatnonzero(wanted)
        number = np.full(n * blocks, -1, np.int64)
        number[tiles] = np.arange(len(tiles))
        here = np.flatnonzero(number[tile] >= 0)
        e = entry[here]
        size = index.first_posting[e + 1] - index.first_posting[e]
        at = gather(index.first_posting[e], size)
        spot = np.repeat(number[tile[here]], size) * BLOCK + index.posting_row[at] % BLOCK
        total = np.bincount(spot, np.repeat(value[here], size) * index.posting_weight[at], len(tiles) * BLOCK).astype(float).reshape(-1, BLOCK)
        of, in_block = tiles // blocks, tiles % blocks
        for b in np.unique(in_block).tolist():
            rows = index.heavy_rows[b * BLOCK : (b + 1) * BLOCK]
            mine = in_block == b
            total[mine, : len(rows)] += dense[of[mine]] @ rows.T
        t, i = np.nonzero(total >= NEAR - SLACK)
        found = of[t], in_block[t] * BLOCK + i, total[t, i]
        if but is None:
            return found
        other = found[1] != but[found[0]]
        return tuple(x[other] for x in found)

    def least(found: Vectors) -> np.ndarray:
        """The least cosine that counts for each text, by what has been found."""
        by = np.lexsort((-found[2], found[0]))
        sizes = np.bincount(found[0], minlength=n)
        out = np.full(n, NEAR)
        full = sizes >= k
        out[full] = np.maximum(NEAR, found[2][by][starts_of(sizes)[full] + k - 1] - TIE)
        return out

    seeds = np.zeros((n, blocks), bool)
    few = min(SEEDS, blocks)
    np.put_along_axis(seeds, np.argpartition(-bound, few - 1, axis=1)[:, :few], True, axis=1)
    found = score(seeds & (bound >= NEAR))
    rest = score(~seeds & (bound >= least(found)[:, None]))
    found = tuple(np.concatenate(x) for x in zip(found, rest))
    near = found[2] >= least(found)[found[0]] - SLACK
    found = tuple(x[near] for x in found)
    by = np.lexsort((found[1], -np.round(found[2], 6), found[0]))
    return tuple(x[by] for x in found)


def _votes(index: ToxicIndex, found: Vectors, n: int) -> np.ndarray:
    """Share of toxic neighbours by squared cosine, as a logarithm of odds with a quarter of a vote each way; nan without any."""
    doc, row, cosine = found
    weight = cosine**2 * index.weights[row] / max(1e-9, index.weights.mean()) if len(row) else cosine
    total = np.bincount(doc, weight, minlength=n)
    toxic = np.bincount(doc, weight * (index.labels[row] == 1), minlength=n)
    return np.where(np.bincount(doc, minlength=n) > 0, np.log((toxic + 0.25) / (total - toxic + 0.25)), np.nan)


def _parts(index: ToxicIndex, vectors: Vectors, n: int) -> Iterator[tuple[int, int, Vectors]]:
    """Texts in groups of up to TOGETHER and about POSTINGS: first, last, and vectors with texts counted from the first."""
    doc, term, _ = vectors
    postings = index.first_posting[index.first_entry[term + 1]] - index.first_posting[index.first_entry[term]]
    upto = np.cumsum(np.bincount(doc, postings, minlength=n))
    a = 0
    while a < n:
        b = min(n, a + TOGETHER, max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + POSTINGS, side="right"))))
        lo, hi = np.searchsorted(doc, [a, b])
        yield a, b, (doc[lo:hi] - a, term[lo:hi], vectors[2][lo:hi])
        a = b


def _calibrate(index: ToxicIndex, vectors: Vectors) -> None:
    """Slope and shift of the vote by logistic regression on examples, each without itself, and the share without neighbours.

    CALIBRATED of them at equal steps are enough for three numbers.
    """
    n = len(index.labels)
    some = np.unique(np.linspace(0, n - 1, min(CALIBRATED, n)).astype(np.int64)) if n else np.zeros(0, np.int64)
    row, term, value = vectors
    number = np.full(n, -1, np.int64)
    number[some] = np.arange(len(some))
    own = number[row] >= 0
    chosen = number[row[own]], term[own], value[own]
    x = np.full(len(some), np.nan)
    for a, b, part in _parts(index, chosen, len(some)):
        x[a:b] = _votes(index, neighbours(index, part, b - a, but=some[a:b]), b - a)
    y, w = index.labels[some], index.weights[some]
    bare = np.isnan(x)
    index.without = float((w[bare & (y == 1)].sum() + 0.5) / (w[bare].sum() + 5))
    x, y, w = x[~bare], y[~bare], w[~bare]
    if len(x) < 20 or len(set(y.tolist())) < 2:
        return
    w = w / w.mean()
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        g = np.array([(w * (p - y) * x).sum() + 0.01 * (slope - 1), (w * (p - y)).sum() + 0.01 * shift])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - float(step[0]), shift - float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    if slope > 0:
        index.slope, index.shift = slope, shift


def judge(index: ToxicIndex, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of every text: the probability, the number of terms that speak for toxicity, and the nearest three examples."""
    n = len(texts)
    vectors = text_vectors(texts, index.terms, index.weight, index.unknown)
    score, names = np.full(n, index.without), [""] * n
    for a, b, part in _parts(index, vectors, n) if len(index.labels) else ():
        found = neighbours(index, part, b - a)
        vote = _votes(index, found, b - a)
        voted = ~np.isnan(vote)
        score[a:b][voted] = 1 / (1 + np.exp(-(index.slope * vote[voted] + index.shift)))
        first = np.searchsorted(found[0], np.arange(b - a))
        last = np.searchsorted(found[0], np.arange(b - a), side="right")
        for i, (x, y) in enumerate(zip(first.tolist(), last.tolist()), a):
            names[i] = ",".join(str(k) for k in index.ids[found[1][x : min(y, x + 3)]])
    loud = np.bincount(vectors[0][index.signal[vectors[1]]], minlength=n) if len(index.signal) else np.zeros(n, np.int64)
    return score, loud, names


def score(df: DataFrame, doc_id: str, text: str, index: ToxicIndex, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``keep`` columns, score, predicted, and as evidence: n_terms, neighbours (ids as text)."""
    shared = df.sparkSession.sparkContext.broadcast(vars(index))
    made = ["score", "predicted", "n_terms", "neighbours"]
    columns = [doc_id, *(c for c in keep if c != doc_id and c not in made)]
    hidden = "text to score"
    chosen = df.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{text}`").alias(hidden))

    def make():
        index = ToxicIndex(**shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            value, loud, names = judge(index, batch.column(batch.num_columns - 1))
            arrays = [pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(loud.astype(np.int32)), pa.array(names, pa.string())]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            return pa.RecordBatch.from_arrays([*kept, *arrays], names=[*batch.schema.names[:-1], *made])

        return work

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != hidden)
    return map_texts(chosen, hidden, make, f"{fields}, score double, predicted int, n_terms int, neighbours string")
