import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from batchloom.llm import minhash
from batchloom.llm.components import connected_components


def words_of(text):
    return (text or "").lower().split()


def labelled(text):
    words, seen, out = words_of(text), {}, []
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    for gram in grams:
        seen[gram] = seen.get(gram, -1) + 1
        out.append((gram, seen[gram]))
    return out


def brute_similarity(a, b):
    """Longest common subsequence of labelled shingles by the full table; its upper bound below 0.8."""
    common = len(set(a) & set(b))
    if common < 0.8 * (len(a) + len(b) - common):
        return common / max(1, len(a) + len(b) - common)
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1]) if a and b else 0.0


def vary(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [words[at], "extra"]])
    return " ".join(words)


def corpus():
    rng = random.Random(4)
    out, text = [], lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    for k in range(30):
        base = text(rng.randrange(5, 260))
        out.append(base)
        for _ in range(rng.randrange(5)):
            out.append(vary(rng, base, rng.randrange(1 + len(base.split()) // 25)))
    chain = text(200)  # each like the one before, the last unlike the first
    for _ in range(12):
        out.append(chain)
        chain = vary(rng, chain, 2)
    passage = text(40)
    out += [f"{text(60)} {passage} {text(60)}" for _ in range(40)]  # share a passage, not alike
    out += ["of of of of of of of of of of", "of of of of of of of of of of of", "a b", "A  b\n", "a c", "", None, " \n", out[0].upper(), out[0] + " "]
    rng.shuffle(out)
    return list(enumerate(out))


def brute_classes(rows, threshold):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shingles = {i: labelled(t) for i, t in rows}
    for (i, a), (j, b) in combinations(rows, 2):
        if words_of(a) and (words_of(a) == words_of(b) or brute_similarity(shingles[i], shingles[j]) >= threshold):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: find(i) for i, _ in rows}


def test_similarity_against_the_full_table():
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(60)}" for _ in range(120))
    for edits in (0, 1, 2, 3, 5, 9, 30):
        for _ in range(10):
            pair = [base, vary(rng, base, edits)]
            hashes, n = minhash.shingles(pa.array(pair))
            a, b = np.split(hashes, [n[0]])
            want = brute_similarity(*map(labelled, pair))
            got = minhash.similarity(a, b)
            assert abs(got - want) < 1e-12 if want >= 0.8 else got == 0


def test_keys_do_not_depend_on_the_slice():
    texts = [t or "" for _, t in corpus()]
    hashes, n = minhash.shingles(pa.array(texts))
    keys = minhash.band_keys(hashes, n)
    for i in range(0, len(texts), 7):
        alone = minhash.shingles(pa.array(texts[i : i + 1]))
        assert np.array_equal(minhash.band_keys(*alone)[0], keys[i])


def test_order_matters():
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    hashes, n = minhash.shingles(pa.array([f"{a} {b}", f"{b} {a}"]))
    assert minhash.similarity(*np.split(hashes, [n[0]])) == 0


def test_classes_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    classes, links = minhash.near_duplicates(df, "doc_id", "text")
    assert {r.doc_id: r.class_id for r in classes.collect()} == brute_classes(rows, 0.8)
    texts = dict(rows)
    for r in links.collect():
        assert abs(r.similarity - brute_similarity(labelled(texts[r.a]), labelled(texts[r.b]))) < 1e-9 and r.similarity >= 0.8
    kept = minhash.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(brute_classes(rows, 0.8).values())


def test_copies_of_an_article_that_longer_documents_quote(spark):
    """The leaders of their buckets are longer than the copies by more than a fifth."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(50000)}" for _ in range(n))
    article = text(300)
    rows = list(enumerate([f"{article} {text(85)}" for _ in range(600)] + [vary(rng, article, 3) for _ in range(2)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes, _ = minhash.near_duplicates(df, "doc_id", "text")
    want = brute_classes(rows, 0.8)
    assert want[601] == 600
    assert {r.doc_id: r.class_id for r in classes.collect()} == want


def test_bounds_let_every_similar_pair_through():
    rng = random.Random(10)
    texts = []
    for _ in range(40):
        texts.append(" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(8, 120))))
        texts += [vary(rng, texts[-1], rng.randrange(1, 5)) for _ in range(3)]
    texts = [t for t in texts if t]
    hashes, n = minhash.shingles(pa.array(texts))
    frequency = np.bincount(minhash._counters(hashes), minlength=minhash.COUNTERS)
    text, place, value = minhash.prefixes(hashes, n, frequency, 0.8)
    held = [dict(zip(value[text == i].tolist(), place[text == i].tolist())) for i in range(len(texts))]
    maps = minhash.parity_bitmaps(hashes, n)
    parts = np.split(hashes, np.cumsum(n)[:-1])
    similar = 0
    for i, j in combinations(range(len(texts)), 2):
        if minhash.similarity(parts[i], parts[j]):
            similar += 1
            need = (n[i] + n[j]) * 0.8 / 1.8 - 1e-6
            assert any(min(n[i] - held[i][v], n[j] - held[j][v]) >= need for v in held[i].keys() & held[j].keys())
            assert sum(int(x).bit_count() for x in (maps[i] ^ maps[j]).view(np.uint64)) <= n[i] + n[j] - 2 * need
    assert similar > 20


def test_empty_table_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None)], "doc_id long, text string")
    classes, _ = minhash.near_duplicates(df, "doc_id", "text")
    assert sorted((r.doc_id, r.class_id) for r in classes.collect()) == [(1, 1), (2, 2)]
    assert minhash.keep_one(df, "doc_id", "text").count() == 4
    assert minhash.near_duplicates(df.limit(0), "doc_id", "text")[0].count() == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (20, 30), (30, 20)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r.node: r.component for r in connected_components(df, "x", "y").collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8, 20: 20, 30: 20} | {100 + i: 100 for i in range(41)}
    assert connected_components(df.limit(0), "x", "y").count() == 0
