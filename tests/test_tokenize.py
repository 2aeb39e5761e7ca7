import random

import pytest
from pyspark.sql import functions as F

import batchloom as bl
from batchloom.functions.arrays import truncate
from batchloom.operators import tokenize

SPEC = bl.DatasetSpec


def ids(n, start=97):
    return "".join(chr(start + i) for i in range(n))


def records(spark, rows, fields):
    schema = "seq_id bigint, " + ", ".join(f"{f} string" for f in fields)
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)


def run(spark, rows, spec, **options):
    out = bl.tokenize(records(spark, rows, spec.field_names), spec, bl.CodepointTokenizer(), **options)
    return ["|".join("".join(map(chr, r[f])) for f in spec.field_names) for r in out.orderBy("seq_id").collect()]


def test_codepoints(spark):
    texts = ["", "a", "aé中😀\n"]
    out = bl.tokenize(records(spark, [(t,) for t in texts], ["content"]), bl.pretrain_spec(), bl.CodepointTokenizer())
    rows = out.orderBy("seq_id").collect()
    assert [r["content"] for r in rows] == [[ord(c) for c in t] for t in texts]
    assert [r["total_len"] for r in rows] == [len(t) for t in texts]


def test_truncate(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1],), ([],)], "a array<int>")
    for side, n, expected in [
        ("left", 2, [[4, 5], [1], []]),
        ("right", 2, [[1, 2], [1], []]),
        ("none", 2, [[1, 2, 3, 4, 5], [1], []]),
        ("left", None, [[1, 2, 3, 4, 5], [1], []]),
        ("right", 0, [[1, 2, 3, 4, 5], [1], []]),
    ]:
        assert [r[0] for r in df.select(truncate(F.col("a"), n, side)).collect()] == expected
    with pytest.raises(ValueError):
        truncate(F.col("a"), 2, "up")


def test_prompt_and_answer_share_a_budget(spark):
    spec = bl.sft_spec(max_seq_len=8)
    assert run(spark, [(ids(10), ids(5)), (ids(2), ids(9))], spec) == ["efghij|ab", "ab|abcdef"]


def test_an_exhausted_budget(spark):
    spec = SPEC(field_names=["f", "g"], max_seq_len=4)
    rows = [(ids(9), ids(3))]
    assert run(spark, rows, spec) == ["abcd|abc"]
    assert run(spark, rows, spec, on_exhausted="empty") == ["abcd|"]
    with pytest.raises(ValueError):
        run(spark, rows, spec, on_exhausted="shrug")


def test_an_overdrawn_budget_counts_as_exhausted(spark):
    spec = SPEC(
        field_names=["f", "g"], max_seq_len=4, field_max_lengths=[None, 2], field_truncation_sides=["none", "left"]
    )
    assert run(spark, [(ids(9), ids(3))], spec) == ["abcdefghi|abc"]
    assert run(spark, [(ids(9), ids(3))], spec, on_exhausted="empty") == ["abcdefghi|"]


def test_without_a_record_maximum_nothing_is_cut(spark):
    spec = SPEC(field_names=["f"], field_max_lengths=[3])
    assert run(spark, [(ids(9),)], spec) == [ids(9)]


def test_inference_keeps_the_end(spark):
    spec = bl.inference_spec(max_seq_len=104)
    assert run(spark, [(ids(9),)], spec) == ["fghi"]


def test_a_missing_field_aborts(spark):
    df = records(spark, [(None,)], ["content"])
    with pytest.raises(Exception, match="content is missing"):
        bl.tokenize(df, bl.pretrain_spec(), bl.CodepointTokenizer()).collect()
    with pytest.raises(ValueError, match="not in the data"):
        bl.tokenize(df, bl.sft_spec(), bl.CodepointTokenizer())


WORDS = [("b a a c",), ("",), ("a\tzz  b\n",), ("  ",), ("zz",)]


def test_vocabulary_order(spark):
    df = records(spark, WORDS, ["content"])
    vocabulary = bl.build_vocabulary(df, "content", 3)
    assert {r["token"]: r["id"] for r in vocabulary.collect()} == {"a": 1, "b": 2, "zz": 3}


@pytest.mark.parametrize("max_shipped", [10, 1])
@pytest.mark.parametrize("limit", [None, 2])
def test_vocabulary_shipped_or_joined(spark, max_shipped, limit):
    df = records(spark, WORDS, ["content"])
    tokenizer = bl.VocabularyTokenizer(bl.build_vocabulary(df, "content", 2), max_shipped=max_shipped)
    spec = bl.pretrain_spec(max_seq_len=limit, field_truncation_sides=["right"])
    rows = bl.tokenize(df, spec, tokenizer).orderBy("seq_id").collect()
    assert [r["content"] for r in rows] == [
        x[:limit] for x in ([2, 1, 1, 0], [], [1, 0, 2], [], [0])
    ]
    assert [r["content_len"] for r in rows] == [len(r["content"]) for r in rows]


def test_a_frequent_word_joined(spark):
    texts = [("the " * 50 + f"w{i}",) for i in range(60)]
    df = records(spark, texts, ["content"])
    vocabulary = spark.createDataFrame([("the", 5), ("w7", 6)], "token string, id int")
    joined = bl.tokenize(df, bl.pretrain_spec(), bl.VocabularyTokenizer(vocabulary, max_shipped=0))
    assert {r["seq_id"]: r["content"] for r in joined.collect()} == {
        i: [5] * 50 + [6 if i == 7 else 0] for i in range(60)
    }


@pytest.mark.parametrize("max_shipped", [10, 1, 0])
def test_ids_depend_on_the_words_alone(spark, max_shipped):
    """Repeated keys, repeated records and ids in place, whatever part of the vocabulary is joined."""
    df = spark.createDataFrame([(1, "a b c"), (1, "c d"), (2, "c d"), (2, "c d")], "g int, content string")
    vocabulary = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "token string, id int")
    tokenizer = bl.VocabularyTokenizer(vocabulary, max_shipped=max_shipped)
    rows = bl.tokenize(df, bl.pretrain_spec(), tokenizer, keep=("g",)).collect()
    assert sorted((r["g"], r["content"]) for r in rows) == [(1, [1, 2, 3]), (1, [3, 4]), (2, [3, 4]), (2, [3, 4])]
    ids = df.select(tokenizer.encode(F.col("content")).alias("ids"), tokenizer.count(F.col("content")).alias("n"))
    assert sorted((r["ids"], r["n"]) for r in ids.collect()) == [([1, 2, 3], 3)] + [([3, 4], 2)] * 3


@pytest.mark.parametrize("hot_rows", [0, 7, 10**9])
def test_hot_words_are_sent_and_the_others_joined(spark, monkeypatch, hot_rows):
    """Whatever counts as hot, ids are the same; words of the vocabulary are joined once, without copies."""
    monkeypatch.setattr(tokenize, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(tokenize, "MAX_HOT", 10**6)
    rng = random.Random(6)
    names = ["hot", "foreign", *(f"w{i}" for i in range(30)), *(f"x{i}" for i in range(30))]
    texts = [" ".join(rng.choice(names[:2] if rng.random() < 0.4 else names) for _ in range(rng.randrange(40))) for _ in range(80)]
    texts += [texts[3]] * 40 + [""]
    ids = {w: i for i, w in enumerate((w for w in names if w[0] not in "xf"), 1)}
    df = records(spark, [(t,) for t in texts], ["content"])
    vocabulary = spark.createDataFrame(list(ids.items()), "token string, id int")
    tokenizer = bl.VocabularyTokenizer(vocabulary, max_shipped=5, unknown_id=99)
    rows = bl.tokenize(df, bl.pretrain_spec(), tokenizer)
    want = [[ids.get(w, 99) for w in t.split()] for t in texts]
    assert [r["content"] for r in rows.orderBy("seq_id").collect()] == want
    places = spark.createDataFrame([(f"k{i}", w, [0]) for i, t in enumerate(texts) for w in {*t.split()} if ids.get(w, 99) > 5], "__key string, token string, __places array<int>")
    numbered = tokenizer._numbered(places)
    assert numbered.count() == sum(1 for i, t in enumerate(texts) for w in {*t.split()} if 5 < ids.get(w, 99) < 99)
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # nothing is copied over salts


def test_joined_words_are_written_by_record(spark, monkeypatch):
    """A record is written once for all its fields, without a row for each of its words."""
    rng = random.Random(7)
    written = []

    def recorded(df, name="stage"):
        out = materialize(df, name)
        written.append(out.count())
        return out

    materialize = tokenize.materialize
    monkeypatch.setattr(tokenize, "materialize", recorded)
    monkeypatch.setattr(tokenize, "MAX_PART_WORDS", 50, raising=False)
    names = [f"w{i}" for i in range(40)] + [f"x{i}" for i in range(40)]
    texts = [tuple(" ".join(rng.choice(names) for _ in range(rng.randrange(30))) for _ in "fg") for _ in range(90)] + [("", "w3 x3 w3")]
    ids = {f"w{i}": (i - 20) * 10**8 for i in range(40)}
    df = records(spark, texts, ["f", "g"])
    vocabulary = spark.createDataFrame(list(ids.items()), "token string, id int")
    tokenizer = bl.VocabularyTokenizer(vocabulary, unknown_id=-7, max_shipped=3)
    rows = bl.tokenize(df, SPEC(field_names=["f", "g"]), tokenizer)
    assert [(r["f"], r["g"], r["f_len"], r["g_len"]) for r in rows.orderBy("seq_id").collect()] == [
        (*([ids.get(w, -7) for w in t.split()] for t in row), *(len(t.split()) for t in row)) for row in texts
    ]
    assert max(written) <= len(texts)


def test_a_vocabulary_too_large_for_ids_in_place(spark, monkeypatch):
    vocabulary = spark.createDataFrame([("a", 1), ("b", 2)], "token string, id int")
    tokenizer = bl.VocabularyTokenizer(vocabulary, max_shipped=1)
    monkeypatch.setattr("batchloom.operators.tokenize.MAX_SENT_BYTES", 1)
    with pytest.raises(ValueError, match="only joined"):
        tokenizer.encode(F.col("content"))


def test_special_tokens(spark):
    tokenizer = bl.CodepointTokenizer(bl.SpecialTokens(bos_id=6, eos_id=2))
    df = records(spark, [("abcdef",), ("",)], ["content"])
    spec = bl.pretrain_spec(max_seq_len=4, field_truncation_sides=["right"])
    rows = bl.tokenize(df, spec, tokenizer, add_special=True).orderBy("seq_id").collect()
    assert [(r["content"], r["content_len"], r["total_len"]) for r in rows] == [([6, 97, 98, 2], 4, 4), ([6, 2], 2, 2)]
    assert bl.tokenize(df, spec, tokenizer).orderBy("seq_id").first()["content"] == [97, 98, 99, 100]


def test_user_tokenizer(spark):
    def factory():
        table = {"a": 1}
        return lambda texts: [[table.get(c, 9) for c in text] for text in texts]

    spec = bl.pretrain_spec(max_seq_len=3, field_truncation_sides=["left"])
    df = records(spark, [("aab",), ("baaa",), ("",)], ["content"])
    tokenizer = bl.ObjectTokenizer(factory, bl.SpecialTokens(bos_id=6, eos_id=2, pad_id=0))
    assert tokenizer.special.eos_id == 2 and bl.CodepointTokenizer().special.bos_id is None
    rows = bl.tokenize(df, spec, tokenizer).orderBy("seq_id").collect()
    assert [r["content"] for r in rows] == [[1, 1, 9], [1, 1, 1], []]


def test_a_user_tokenizer_is_given_texts_in_parts(spark):
    """Parts of a megabyte, a longer text by itself, empty ones too; two fields, and every list with its text."""

    def factory():
        def run(texts):
            size = sum(len(t.encode()) for t in texts)
            return [(int(t[:4]) if t else -1, size, len(texts)) for t in texts]

        return run

    rng = random.Random(8)
    texts = [f"{i:04d}" + "é" * rng.randrange(3000) if i % 7 else "" for i in range(1500)]
    texts[1000] = "1000" + "a" * (3 << 20)
    df = records(spark, [(t, texts[-1 - i]) for i, t in enumerate(texts)], ["f", "g"]).coalesce(1)
    rows = bl.tokenize(df, SPEC(field_names=["f", "g"]), bl.ObjectTokenizer(factory)).orderBy("seq_id").collect()
    first = [i if t else -1 for i, t in enumerate(texts)]
    assert [(r["f"][0], r["g"][0]) for r in rows] == list(zip(first, first[::-1], strict=True))
    sizes = {tuple(r[f][1:]) for r in rows for f in "fg"}
    assert all(size <= 1 << 20 or (size == 4 + (3 << 20) and n == 1) for size, n in sizes)
    assert len(sizes) > 3  # several texts at a time, not one


def test_a_user_tokenizer_gives_a_list_for_every_text(spark):
    df = records(spark, [("a",), ("b",)], ["content"]).coalesce(1)
    with pytest.raises(Exception, match="1 lists for 2 texts"):
        bl.tokenize(df, bl.pretrain_spec(), bl.ObjectTokenizer(lambda: lambda texts: [[1]])).collect()


def test_subword_tokenizer_object(spark):
    tokenizers = pytest.importorskip("tokenizers")
    corpus = ["low lower lowest", "new newer newest"] * 20

    def train():
        made = tokenizers.Tokenizer(tokenizers.models.BPE(unk_token="<unk>"))
        made.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
        trainer = tokenizers.trainers.BpeTrainer(vocab_size=40, special_tokens=["<unk>"], show_progress=False)
        made.train_from_iterator(corpus, trainer)
        return made

    stored = train().to_str()

    def factory():
        loaded = tokenizers.Tokenizer.from_str(stored)
        return lambda texts: [e.ids for e in loaded.encode_batch(texts, add_special_tokens=False)]

    df = records(spark, [(t,) for t in corpus], ["content"])
    rows = bl.tokenize(df, bl.pretrain_spec(), bl.ObjectTokenizer(factory)).orderBy("seq_id").collect()
    expected = tokenizers.Tokenizer.from_str(stored)
    assert [r["content"] for r in rows] == [expected.encode(t).ids for t in corpus]


def test_map_records(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "seq_id bigint, t string").repartition(4)
    out = bl.map_records(
        df, lambda r: {"seq_id": r["seq_id"], "n": len(r["t"])}, "seq_id bigint, n int", order_by="seq_id"
    )
    assert [tuple(r) for r in out.collect()] == [(i, len(f"t{i}")) for i in range(50)]
