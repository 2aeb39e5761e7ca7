"""Document quality: random-indexing word vectors, pooled, into a small calibrated neural network.

Every token (a run of letters and digits, or a run of other signs) has a sparse random index vector that
follows from its hash. The vector of a token is the sum of the index vectors of its neighbours over **all**
documents. All tokens, frequent ones too, are hashed to ``ROWS`` rows, so that the table has ``ROWS`` x ``SIZE``
numbers whatever the corpus: a row is the mix of the tokens that share it, above all of the frequent ones. Tasks add up their own table and Spark adds the tables. A document is the mean and the spread of the
vectors of its tokens, and how often a token is repeated at once, how varied and how long the text is.

A network of two layers is trained with numpy on a bounded, documented sample of labelled rows; a
temperature for its logits is fitted on a part that it was not trained on. Table and network are broadcast
and documents are scored where they are read. Null and empty texts have no tokens and are scored from the
zero vector.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import code_words, gather, hash_strings, labelled_sample, map_texts, mix64, slices, starts_of, sums_of

#: Hashed rows of the vector table, numbers in a vector, entries of an index vector, neighbours each way.
ROWS, SIZE, ENTRIES, REACH = 4096, 32, 2, 2
#: Labelled rows of each class that the network is trained on, and its hidden units.
SAMPLE, HIDDEN = 8000, 24
THRESHOLD = 0.7
N_FEATURES = 2 * SIZE + 3
_PARTS = re.compile(r"[^\W_]+|[\W_]+")


@dataclass
class QualityModel:
    """The vector table, scaling of the features, the network and its temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed row and exact code of every token, and the number of tokens of every text."""
    codes, words, counts = code_words(texts)
    split = [_PARTS.findall(w) for w in words.to_pylist()]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    flat = pa.array([t for s in split for t in s], pa.string()).dictionary_encode()
    part = flat.indices.to_numpy().astype(np.int64)
    row = (mix64(hash_strings(flat.dictionary)) % np.uint64(ROWS)).astype(np.int64)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    code = part[gather(starts_of(sizes)[codes], sizes[codes])]
    return row[code], code, sums_of(sizes[codes], counts)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every row's index vector."""
    seed = np.arange(ROWS * ENTRIES, dtype=np.uint64).reshape(ROWS, ENTRIES)
    place = (mix64(seed + np.uint64(1)) % np.uint64(SIZE)).astype(np.int64)
    return place, np.where(mix64(seed + np.uint64(1 << 40)) & np.uint64(1), 1.0, -1.0)


def _context_table(batch_texts: pa.Array, place: np.ndarray, sign: np.ndarray) -> np.ndarray:
    row, _, counts = tokens(batch_texts)
    text = np.repeat(np.arange(len(counts)), counts)
    table = np.zeros(ROWS * SIZE)
    for reach in range(1, REACH + 1):
        together = text[reach:] == text[:-reach]
        left, right = row[:-reach][together], row[reach:][together]
        for a, b in ((left, right), (right, left)):
            for e in range(ENTRIES):
                table += np.bincount(a * SIZE + place[b, e], weights=sign[b, e], minlength=ROWS * SIZE)
    return table.reshape(ROWS, SIZE)


def word_vectors(df: DataFrame, text: str) -> np.ndarray:
    """The table of token vectors, from all texts; rows of length 1."""

    def run(batches):
        place, sign = _index_vectors()
        table = np.zeros((ROWS, SIZE))
        for batch in batches:
            for piece in slices(batch, "t"):
                table += _context_table(piece.column(0), place, sign)
        full = np.flatnonzero(np.abs(table).sum(axis=1))
        columns = [pa.array(full.astype(np.int64)), *(pa.array(table[full, i]) for i in range(SIZE))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", *(f"v{i}" for i in range(SIZE))])

    schema = "row long, " + ", ".join(f"v{i} double" for i in range(SIZE))
    parts = df.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)
    summed = parts.groupBy("row").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(SIZE))).toArrow()
    out = np.zeros((ROWS, SIZE))
    if summed.num_rows:
        out[summed.column(0).to_numpy()] = np.stack([summed.column(i + 1).to_numpy() for i in range(SIZE)], axis=1)
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(length > 0, out / np.maximum(length, 1e-12), 0.0).astype(np.float32)


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES for every text."""
    row, code, counts = tokens(texts)
    n = np.maximum(counts, 1)[:, None]
    out = np.zeros((len(counts), N_FEATURES))
    # Sums over distinct (text, row) pairs: fewer than tokens.
    pair, times = np.unique(np.repeat(np.arange(len(counts)), counts) * ROWS + row, return_counts=True)
    owner, own = pair // ROWS, vectors[pair % ROWS].astype(np.float64)
    per_text = np.bincount(owner, minlength=len(counts))
    mean = sums_of(own * times[:, None], per_text) / n
    square = sums_of(own**2 * times[:, None], per_text) / n
    out[:, :SIZE] = mean
    # The floor keeps rounding, which depends on the slice, out of the root.
    out[:, SIZE : 2 * SIZE] = np.sqrt(np.maximum(square - mean**2, 1e-6))
    if len(code):
        text = np.repeat(np.arange(len(counts)), counts)
        again = np.zeros(len(code), dtype=np.int64)
        again[1:] = (code[1:] == code[:-1]) & (text[1:] == text[:-1])
        out[:, -3] = sums_of(again, counts) / n[:, 0]
        out[:, -2] = per_text / np.sqrt(n[:, 0])
    out[:, -1] = np.log1p(counts)
    return out


def _logits(model: QualityModel, x: np.ndarray) -> np.ndarray:
    hidden = np.tanh(((x - model.mean) / model.scale) @ model.w1 + model.b1)
    return hidden @ model.w2 + model.b2


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray, epochs: int = 400, seed: int = 7) -> QualityModel:
    """Fit the network on four fifths of the rows and its temperature on the rest."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = QualityModel(
        vectors, mean, scale, rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), 0.0, 1.0
    )
    if len(set(y.tolist())) < 2:
        model.w2 = np.zeros(HIDDEN)
        model.b2 = 0.0 if not len(y) else float(6 * y[0] - 3)
        return model
    held = rng.random(len(y)) < 0.2
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), dtype=bool)
    a, b, w = (x[~held] - mean) / scale, y[~held], weight[~held] / weight[~held].mean()
    state = [model.w1, model.b1, model.w2, np.zeros(1)]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    for step in range(1, epochs + 1):
        hidden = np.tanh(a @ state[0] + state[1])
        p = 1 / (1 + np.exp(-(hidden @ state[2] + state[3][0])))
        d = w * (p - b) / len(b)
        back = np.outer(d, state[2]) * (1 - hidden**2)
        grads = [a.T @ back + 2e-4 * state[0], back.sum(axis=0), hidden.T @ d + 2e-4 * state[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            state[i] = state[i] - 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = state[0], state[1], state[2], float(state[3][0])
    part = held if held.any() else ~held
    z, t, v = _logits(model, x[part]), y[part], weight[part]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [(v * np.logaddexp(0, np.where(t == 1, -z, z) / g)).sum() for g in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> QualityModel:
    """Vectors from all ``documents``; network from about ``sample`` labelled documents of each class.

    ``labels`` has the keys that may be learned from. They are chosen by a hash of ``key``; each weighs as
    many rows as it stands for.
    """
    vectors = word_vectors(documents, text)
    chosen, counts = labelled_sample(documents, labels, key, text, label, sample)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features(batch.column(2), shared.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["key", "label", "x"])

        return work

    kind = chosen.schema["key"].dataType.simpleString()
    rows = map_texts(chosen, "text", make, f"key {kind}, label long, x array<double>").toArrow().sort_by("key")
    y = rows.column("label").to_numpy().astype(np.int64)
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(len(y), N_FEATURES)
    held = {c: max(1, int((y == c).sum())) for c in set(y.tolist())}
    weight = np.array([counts[c] / held[c] for c in y.tolist()])
    return train(x, y, weight, vectors)


def score(df: DataFrame, doc_id: str, text: str, model: QualityModel, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``keep`` columns, score (probability of label 1) and predicted for every row."""
    columns = [doc_id, *(c for c in keep if c != doc_id and c not in ("score", "predicted"))]
    shared = df.sparkSession.sparkContext.broadcast(vars(model))
    hidden = "text to score"
    chosen = df.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{text}`").alias(hidden))

    def make():
        model = QualityModel(**shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features(batch.column(batch.num_columns - 1), model.vectors)
            value = 1 / (1 + np.exp(-np.clip(_logits(model, x) / model.temperature, -40, 40)))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            made = [pa.array(value), pa.array((value >= threshold).astype(np.int32))]
            return pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:-1], "score", "predicted"])

        return work

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != hidden)
    return map_texts(chosen, hidden, make, f"{fields}, score double, predicted int")
