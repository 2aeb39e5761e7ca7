import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from batchloom.llm import audit, sketch

DOCS = "doc_id long, text string, lang string, id long, part string, mask int"
LABELS = "doc_id long, quality int, toxic int, id int"


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    texts = [None, "", "short", "X Y Z " * 100, "a$ " * 300, " ".join(f"word{i}" for i in range(300)), " ".join(f"Ö{i}" for i in range(250)), "\x0b".join(f"W{i}" for i in range(250)), "q" * 100_000]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(150, 400))) for _ in range(30)]
    rows = [(i, rng.choice(texts) if rng.random() < 0.6 else f"own {i} " + "y" * rng.randrange(9), rng.choice(["en", "de", None, ""]), 5, "z", 1) for i in range(n)]
    hot = [(n + i, "the hot text", "en", 5, "z", 1) for i in range(n // 2)]
    return [*rows, *hot, rows[7], rows[7], (None, "the hot text", "en", 1, "z", 1), (None, None, "de", 1, "z", 1), (3, "another text of id 3", "en", 1, "z", 1)]


def labels_of(rows, seed=4):
    rng = random.Random(seed)
    out = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1]), 0) for r in rows if rng.random() < 0.5]
    return [*out, out[0], (10**9, 1, 1, 0), (None, 1, 1, 0)]


def mask_of(row, least):
    text = row[1] or ""
    words = text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]
    fails.append(row[0] is not None and least[text] < row[0])
    return sum(1 << i for i, f in enumerate(fails) if f)


def brute(rows, labels):
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, _ in labels if t == 1 and d is not None}
    docs = [(r[2] or "", mask_of(r, least), r[0] in good, r[0] in toxic) for r in rows]
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        left = dict(enumerate(docs))
        for step, x in enumerate(order, 1):
            bit = 1 << "ABCDE".index(x)
            here = {i for i, d in left.items() if d[1] & bit}
            for part in {d[0] for d in docs}:
                mine = [i for i in here if docs[i][0] == part]
                failing = [i for i, d in enumerate(docs) if d[0] == part and d[1] & bit]
                kept = sum(1 for i, d in left.items() if d[0] == part and i not in here)
                out[part, "".join(order), step] = [kept, len(mine), len(failing) - len(mine), sum(docs[i][1] == bit for i in failing), sum(docs[i][2] for i in mine), sum(docs[i][3] for i in mine)]
                shapley[part, x] += len(mine)
            left = {i: d for i, d in left.items() if i not in here}
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, rows, labels):
    marked = audit.masks(spark.createDataFrame(rows, DOCS).repartition(5), "doc_id", "text", "lang")
    return audit.audit(audit.mask_counts(marked, spark.createDataFrame(labels, LABELS), "doc_id", "quality", "toxic"), "ABCDE")


def test_against_documents_one_by_one(spark):
    rows = corpus()
    labels = labels_of(rows)
    out = run(spark, rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()} == brute(rows, labels)


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    rows = run(spark, [(None, None, None, 1, "", 1)], []).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and {(r.removed, r.shapley) for r in rows if r.step == 1 and r.filter_order[0] == "A"} == {(1, 120)}


@pytest.mark.parametrize("chunks", [1, 3])
def test_only_possible_repeats_are_left(spark, monkeypatch, chunks):
    monkeypatch.setattr(sketch, "MAX_CHUNKS", chunks)
    texts = [f"text {i % 700}" for i in range(1000)] + ["hot"] * 500
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(6).withColumn("h", F.xxhash64("t"))
    merged, n = sketch.sketch(df, "h", len(texts), 2)
    assert n <= chunks
    rows = sketch.with_maybe(df, "h", merged, n).collect()
    seen = Counter(texts)
    assert len(rows) == 1500 and all(r.maybe for r in rows if seen[r.t] > 1)
    assert sum(not r.maybe for r in rows) > (300 if chunks == 3 else 100)


def test_a_set_loses_no_member(spark):
    ids = spark.range(3000).select((F.col("id") * 7).alias("id"))
    merged, n = sketch.sketch(ids.select(F.xxhash64("id").alias("h")), "h", 3000, 1)
    rows = sketch.with_maybe(spark.range(42000).withColumn("h", F.xxhash64("id")), "h", merged, n).collect()
    assert len(rows) == 42000 and all(r.maybe for r in rows if r.id % 7 == 0 and r.id < 21000)
    assert sum(r.maybe for r in rows) < 3000 + 0.1 * 39000
    merged, n = sketch.sketch(ids.limit(0).select(F.xxhash64("id").alias("h")), "h", 0, 1)
    assert not any(r.maybe for r in sketch.with_maybe(spark.range(9).withColumn("h", F.xxhash64("id")), "h", merged, n).collect())
