import random

import pyarrow as pa
import pytest

from batchloom.llm import decontaminate as d


def distance(pattern, text):
    """Least edit distance of the pattern to a substring, and the first end where it is."""
    row = list(range(len(pattern) + 1))
    best = row[-1], 0
    for end, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, (row[-1], end))
    return best


def test_myers_against_the_full_table():
    rng = random.Random(3)
    for _ in range(300):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 60)))
        if rng.random() < 0.5:
            text += pattern[: rng.randrange(len(pattern) + 1)] + "d" + pattern[rng.randrange(len(pattern)) :]
        want = distance(pattern, text)
        got = d.best_match(pattern, d._masks(pattern), text, len(pattern))
        assert got[0] == want[0] and (got[0] == len(pattern) or got[1] == want[1])
        assert d.best_match(pattern, d._masks(pattern), text, want[0] - 1) is None


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        text[at : at + 1] = [] if kind == 0 else [rng.choice("xyz")] if kind == 1 else [text[at], rng.choice("xyz")]
    return "".join(text)


def case():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(9, 30)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "short"), (53, items[3][1]), (None, items[4][1].upper())]
    docs = []
    for k in range(25):
        parts = [" ".join(word() for _ in range(30))]
        for _ in range(rng.randrange(3)):
            text = rng.choice(items[:12])[1]
            parts.append(edited(rng, text, rng.randrange(int(0.16 * len(text)))))
        parts.append("END!! " + " ".join(word() for _ in range(10)))
        docs.append((k, rng.choice(["\n", " ", " -- "]).join(parts), "z"))
    docs += [(90, None, "z"), (91, "", "z"), (92, (items[0][1] + " ") * 300, "z"), (3, docs[3][1], "z"), (None, items[1][1], "z")]
    return items, docs


def test_all_items_within_the_budget_are_found(spark):
    items, docs = case()
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "number long, question string")
    normal = lambda t: d.normal_text(pa.array([t or ""])).to_pylist()[0]
    want = []
    for k, text, _ in docs:
        for i, item in items:
            item = normal(item)
            if len(item) >= d.MIN_CHARS:
                best = distance(item, normal(text))
                if best[0] <= int(d.RATE * len(item)):
                    want.append((str(k), str(i), best[0]))
    for block_bytes in (1 << 20, 700):
        out = d.find_items(df, "doc_id", "text", bench, "number", "question", block_bytes=block_bytes)
        got = [(str(r.doc_id), str(r.number), r.distance) for r in out.collect()]
        assert sorted(got) == sorted(want)
    bad = {w[0] for w in want}
    for block_bytes in (1 << 20, 700):
        left = d.drop_contaminated(df, "text", bench, "number", "question", block_bytes=block_bytes)
        assert left.columns == df.columns
        assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(k) for k, *_ in docs if str(k) not in bad)


def test_empty_tables(spark):
    items, docs = case()
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "number long, question string")
    assert d.find_items(df, "doc_id", "text", bench.limit(0), "number", "question").count() == 0
    assert d.find_items(df.limit(0), "doc_id", "text", bench, "number", "question").count() == 0


def test_short_items_are_matched_as_whole_words(spark):
    texts = ["x Who wrote 'Emma'? y", "who wrote emmas", "who  WROTE emma", "who wrote emna", "他问中国的首都是哪里然后走了", None, *["so and so on"] * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Who wrote Emma?"), (2, "中国的首都是哪里"), (3, "and so"), (4, ""), (5, None)], "number long, question string")
    out = d.find_items(df, "doc_id", "text", bench, "number", "question").collect()
    want = [(0, 1, 0, 0), (2, 1, 0, 0), (4, 2, 0, 0), *((i, 3, 0, 0) for i in range(6, 14))]
    assert sorted((r.doc_id, r.number, r.distance, r.budget) for r in out) == want
    # "and so" is in more documents than a leak would be; longer items count.
    left = d.drop_contaminated(df, "text", bench, "number", "question")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 5, *range(6, 14)]


def test_a_phrase_leaves_the_other_short_items_alone(spark):
    texts = [*["we set it out in the text below, so it goes"] * 30, "x the capital of peru is lima, he said", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "set it out in the text below"), (2, "capital of Peru is Lima"), (2, "capital of Peru is Lima"), (None, "no text has it")], "number long, question string")
    assert len(d.normal_text(pa.array(["set it out in the text below"]))[0].as_py()) > len("capital of peru is lima")
    left = d.drop_contaminated(df, "text", bench, "number", "question")
    assert sorted(r.doc_id for r in left.collect()) == [*range(30), 31, 32]


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "string"])
@pytest.mark.parametrize("own", ["int", "string"])
def test_ids_of_any_type(spark, kind, own):
    items, docs = case()
    df = spark.createDataFrame([(k, t) for k, t, _ in docs], "doc_id long, text string").selectExpr(f"cast(doc_id AS {own}) AS doc_id", "text")
    bench = spark.createDataFrame(items, "number long, question string").selectExpr(f"cast(number AS {kind}) AS number", "question")
    out = d.find_items(df, "doc_id", "text", bench, "number", "question")
    plain = d.find_items(spark.createDataFrame([(k, t) for k, t, _ in docs], "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "number long, question string"), "number", "question")
    assert dict(out.dtypes)["number"] == kind and dict(out.dtypes)["doc_id"] == own
    key = lambda rows: sorted((str(r.doc_id), str(r.number), r.distance, r.end) for r in rows)
    assert key(out.collect()) == key(plain.collect())
