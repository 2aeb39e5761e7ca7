"""Toxicity and quality: exact neighbours, calibrated scores, odd rows."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from batchloom.llm import quality, toxicity


def words(rng, n, extra=()):
    out = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(300)) for _ in range(n)]
    for w in extra:
        out.insert(rng.randrange(len(out) + 1), w)
    return " ".join("".join(c for c in w if c.isalpha()) + "qxyz"[int(w[-1]) % 4 :] if w[-1].isdigit() else w for w in out)


def toxic_rows(n=400, seed=1):
    rng = random.Random(seed)
    bad = ["idiot", "scum", "moron", "trash"]
    out = []
    for i in range(n):
        label = int(rng.random() < 0.25)
        extra = [rng.choice(bad) for _ in range(rng.randrange(1, 5))] if label else []
        out.append((i, words(rng, rng.randrange(10, 60), extra), label))
    return out


ODD = [(9000, None), (9001, ""), (9002, "!!! 12"), (9003, "idiot " * 5000), (None, "you scum, you moron")]
SCHEMA = "doc_id long, text string, score string"


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(*o, "x") for o in ODD] + [(3, rows[3][1], "x")], SCHEMA)
    labelled = spark.createDataFrame([(i, y, "x") for i, _, y in rows[:250]], "doc_id long, toxic long, text string")
    index = toxicity.fit(docs, labelled, "doc_id", "text", "toxic")
    assert {"idiot", "scum", "moron", "trash"} <= set(index.terms)
    out = toxicity.score(docs, "doc_id", "text", index, keep=("score",)).collect()
    assert len(out) == len(rows) + len(ODD) + 1
    by = {r.doc_id: r for r in out}
    held = rows[250:]
    assert np.mean([by[i].predicted == y for i, _, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert by[9003].predicted == 1 and by[None].predicted == 1 and by[9003].neighbours
    assert by[9000].score == by[9001].score == by[9002].score < 0.3
    assert toxicity.score(docs.limit(0), "doc_id", "text", index).count() == 0


def dense_vectors(texts, terms, weight, unknown):
    """TF-IDF rows of length 1 over the known terms, word by word."""
    import math
    import re
    from collections import Counter

    out = np.zeros((len(texts), len(terms)))
    for i, text in enumerate(texts):
        own = Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
        raw = {w: (1 + math.log(c)) * (weight[terms[w]] if w in terms else unknown) for w, c in own.items()}
        length = math.sqrt(sum(v * v for v in raw.values()))
        for w, v in raw.items():
            if w in terms:
                out[i, terms[w]] = v / length
    return out


def real_texts():
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/documents.parquet"
    return pq.read_table(path).column("text").to_pylist() if Path(path).exists() else [words(random.Random(3), 80) for _ in range(200)]


@pytest.mark.parametrize("near,dull", [(0.5, 0.005), (0.1, 1.0), (0.02, 0.3)])
def test_neighbours_are_those_of_all_cosines(monkeypatch, near, dull):
    """On whole texts: postings, dense rows and bounds together give what comparing with every example gives."""
    monkeypatch.setattr(toxicity, "NEAR", near)
    rng = np.random.default_rng(4)
    texts = real_texts()
    texts = [*texts, *texts[:40], "", None]
    examples, queries = texts[20:], texts
    names = sorted({w for t in examples for w in toxicity.letter_words(pa.array([t or ""]))[1].to_pylist()})
    terms = {w: i for i, w in enumerate(names)}
    signal = rng.random(len(names)) < 0.02
    weight = rng.uniform(1, 8, len(names)) * np.where(signal, 1, dull)
    vectors = toxicity.text_vectors(pa.array([t or "" for t in examples]), terms, weight, 9 * dull)
    labels = rng.integers(0, 2, len(examples))
    index = toxicity.build(list(range(len(examples))), labels, vectors, terms, weight, 9 * dull, signal, {0: 450, 1: 450})
    assert index.heavy_rows.shape[1] > 0 and len(index.posting_row) > 0 and 0 <= index.without <= 1
    cosine = dense_vectors(queries, terms, weight, 9 * dull) @ dense_vectors([examples[i] for i in index.ids], terms, weight, 9 * dull).T
    got = toxicity.neighbours(index, toxicity.text_vectors(pa.array([t or "" for t in queries]), terms, weight, 9 * dull), len(queries))
    some = 0
    for i in range(len(queries)):
        row, value = got[1][got[0] == i], got[2][got[0] == i]
        least = max(near, np.sort(cosine[i])[-toxicity.NEIGHBOURS] - toxicity.TIE)
        assert set(np.flatnonzero(cosine[i] >= least + 1e-4)) <= set(row.tolist()) <= set(np.flatnonzero(cosine[i] >= least - 1e-4))
        assert np.allclose(value, cosine[i, row], atol=1e-5) and np.all(np.diff(np.round(value, 5)) <= 1e-5)
        some += len(row)
    assert some > len(queries)


def test_rare_toxic_words_and_copies(spark):
    """Words that speak for toxicity count beyond the first 128, and copies of examples whatever their words are."""
    rng = random.Random(9)
    kinds = [f"bad{''.join(chr(97 + int(c)) for c in str(i))}x" for i in range(200)]
    rows = []
    for i in range(4600):
        toxic = i < 1600
        text = words(rng, 40) + (f" {kinds[i % 200]} {kinds[i % 200]}" if toxic else "")
        rows.append((i, text, int(toxic)))
    plain = [(5000 + i, f"{words(rng, 30)} zq{chr(97 + i)}only zq{chr(97 + i)}once", 1) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + plain] + [(2000 + i, t) for i, t, _ in plain] + [(8000 + k, words(rng, 200) + " " + w) for k, w in enumerate(kinds)] + [(9000 + k, words(rng, 60)) for k in range(100)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, y) for i, _, y in rows + plain], "doc_id long, toxic long")
    index = toxicity.fit(docs, labelled, "doc_id", "text", "toxic")
    assert index.signal.sum() > 128
    out = {r.doc_id: r for r in toxicity.score(docs, "doc_id", "text", index).collect()}
    assert sum(out[8000 + k].predicted for k in range(200)) >= 198
    assert all(out[7000 + i].n_terms == 0 and out[7000 + i].predicted == 1 for i in range(20))
    assert sum(out[9000 + k].predicted for k in range(100)) <= 2


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for label in ([], [(1, "a b", 1)], [(1, "a b", None)]):
        labelled = spark.createDataFrame(label, "doc_id long, text string, y long")
        index = toxicity.fit(docs, labelled, "doc_id", "text", "y")
        assert all(0 <= r.score <= 1 for r in toxicity.score(docs, "doc_id", "text", index).collect())
        model = quality.fit(docs, labelled, "doc_id", "text", "y")
        assert all(0 <= r.score <= 1 for r in quality.score(docs, "doc_id", "text", model).collect())


def quality_rows(n=500, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        label = int(rng.random() < 0.7)
        text = words(rng, rng.randrange(15, 60))
        if not label:
            kind = rng.randrange(3)
            text = text.upper().replace(" ", "!! ") if kind == 0 else text.replace(" ", " | ") if kind == 1 else " ".join([text.split()[0]] * 30)
        out.append((i, text, label))
    return out


def test_quality(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(*o, "x") for o in ODD] + [(3, rows[3][1], "x")], SCHEMA)
    labelled = spark.createDataFrame([(i, y, "x") for i, _, y in rows[:300]], "doc_id long, good long, text string")
    model = quality.fit(docs, labelled, "doc_id", "text", "good")
    out = quality.score(docs, "doc_id", "text", model, keep=("score",)).collect()
    assert len(out) == len(rows) + len(ODD) + 1
    by = {r.doc_id: r for r in out}
    held = rows[300:]
    assert np.mean([by[i].predicted == y for i, _, y in held]) > 0.95
    assert np.mean([(by[i].score - y) ** 2 for i, _, y in held]) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert by[9000].score == by[9001].score
    assert quality.score(docs.limit(0), "doc_id", "text", model).count() == 0


@pytest.mark.parametrize("cut", [1, 7, 100])
def test_features_do_not_depend_on_the_slice(cut):
    texts = [t for _, t, _ in quality_rows(60)] + ["", "a"]
    vectors = np.random.default_rng(1).normal(size=(quality.ROWS, quality.SIZE)).astype(np.float32)
    whole = quality.features(pa.array(texts), vectors)
    parts = [quality.features(pa.array(texts[i : i + cut]), vectors) for i in range(0, len(texts), cut)]
    assert np.allclose(whole, np.concatenate(parts))
