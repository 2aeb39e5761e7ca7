import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from batchloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score long, rank int, ids string"


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    docs = [(d, terms_of(t)) for d, t in docs if d is not None]
    n_all, l_all = sum(1 for _, ws in docs if ws), sum(len(ws) for _, ws in docs)
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, ws in queries.items():
        weight = {w: math.floor(1000 * math.log((2 * n_all + 2) / (2 * sum(w in own for _, own in docs) + 1))) for w in ws}
        scores = []
        for d, own in docs:
            m = 10 + 90 * len(own) * n_all // max(1, l_all)
            s = sum(weight[w] * (10**9 * own.count(w) // (1000 * own.count(w) + 8 * m)) for w in ws if w in own)
            if s > 0:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "ÉTÉ", "été", "naïve", "中文", "x9", "a_b", "K"]
    text = lambda: " ".join(words[min(int(rng.expovariate(0.06)), len(words) - 1)] for _ in range(rng.randrange(1, 60)))
    docs = [(i * 7 % 1000, text()) for i in range(n)]
    docs += [(2000 + i, "w1 w2 rare") for i in range(40)]  # ties
    docs += [docs[5], docs[5], (5000, None), (5001, ""), (5002, "\x00 - \x7f."), (None, "w1 rare rare"), (5003, "w1 " * 50_000 + "rare")]
    items = [(i, text()) for i in range(12)] + [(20, "rare W1, w2"), (21, None), (22, ""), (23, "not-there"), (24, "the"), (24, "rare"), (None, "w3"), (25, "w1 w1 w1")]
    return docs, items


def run(spark, docs, items, kind="long", **options):
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in docs], DOCS).repartition(5)
    queries = spark.createDataFrame(items, f"item_id {kind}, q string")
    out = search.search(df, "doc_id", "text", queries, "item_id", "q", **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("kind", ["long", "int", "smallint"])
def test_against_all_scores(spark, kind):
    docs, items = corpus()
    assert run(spark, docs, items, kind) == brute(docs, items)


def test_blocks_of_items_and_text_ids(spark):
    docs, items = corpus(60)
    assert run(spark, docs, items, block_bytes=400, top=3) == brute(docs, items, 3)
    df = spark.createDataFrame([(f"d{i}", t) for i, t in docs], "d string, t string")
    out = search.search(df, "d", "t", spark.createDataFrame([(f"i{i}", t) for i, t in items], "i string, t string"), "i", "t")
    assert sorted(tuple(r) for r in out.collect()) == brute([(f"d{i}", t) for i, t in docs], [(f"i{i}", t) for i, t in items])


def test_empty_tables(spark):
    docs, items = corpus(20)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None)], items) == []
    with pytest.raises(ValueError, match="names"):
        search.search(spark.createDataFrame([], "i long, t string"), "i", "t", spark.createDataFrame([], "i long, t string"), "i", "t")


def shard_of(docs, queries):
    terms = {w: i for i, w in enumerate(sorted({w for q in queries for w in q}))}
    shards = search.Shards(terms)
    ids = pa.array([d for d, _ in docs], pa.int64())
    shards.add(ids, pa.array([t for _, t in docs], pa.string()))
    row = shards.row().drop_columns(["ids"]).to_pylist()[0]
    weights = search.term_weights(row["n"], dict(zip(row["terms"], row["sizes"])), len(terms))
    return search.Shard(row, weights, row["n"], row["total"]), terms


def test_several_shards_in_a_task(spark):
    docs, items = corpus()
    terms = {w: i for i, w in enumerate(sorted({w for _, t in items for w in terms_of(t)}))}
    rows, shards = [], search.Shards(terms)
    known = [(d, t) for d, t in docs if d is not None]
    for at in range(0, len(known), 50):
        part = known[at : at + 50]
        shards.add(pa.array([d for d, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string()))
        rows.append(shards.row())
    df = {}
    for r in rows:
        for t, n in zip(r.column("terms")[0].as_py(), r.column("sizes")[0].as_py()):
            df[t] = df.get(t, 0) + n
    n, total = (sum(r.column(c)[0].as_py() for r in rows) for c in ("n", "total"))
    weights = search.term_weights(n, df, len(terms))
    ids = pa.array([i for i, _ in items if i is not None and i < 24], pa.int64())
    queries = [[terms[w] for w in set(terms_of(t))] for i, t in items if i is not None and i < 24]
    (out,) = search._searcher(ids, queries, weights, n, total, 10, ["item_id", "doc_id", "score"])(iter(rows))
    got = list(zip(*(c.to_pylist() for c in out.columns)))
    assert [x for x in got] == [(i, d, s) for i, _, d, s in brute(known, [(i, t) for i, t in items if i is not None and i < 24])]


def test_range_maxima_and_pruning():
    rng = random.Random(7)
    common = [f"c{i}" for i in range(5)]
    docs = [(i, " ".join([*rng.choices(common, k=20), *([f"r{i % 400}"] * (1 + i % 3))])) for i in range(8000)]
    shard, terms = shard_of(docs, [[*common, "r7"]])
    a = np.array([rng.randrange(len(shard.docs)) for _ in range(500)])
    own = np.searchsorted([e for _, e in shard.lists.values()], a, side="right")
    b = np.array([rng.randrange(x, list(shard.lists.values())[o][1] + 1) for x, o in zip(a.tolist(), own.tolist())])
    value, place = shard.maxima(a, b)
    for x, y, v, p in zip(a.tolist(), b.tolist(), value.tolist(), place.tolist()):
        assert v == (shard.impact[x:y].max() if y > x else 0) and (y == x or shard.impact[p] == v)
    calls = []
    bounds = shard._bounds
    shard._bounds = lambda a, b: calls.append(a.shape[1]) or bounds(a, b)
    best = shard.search([terms[w] for w in (*common, "r7")], 10)
    assert len(best) == 10 and all(docs[d][0] % 400 == 7 for _, d in best)
    assert sum(calls) < 2000  # intervals, of 8,000 documents
