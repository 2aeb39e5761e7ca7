import pytest
from pyspark.sql import functions as F

import batchloom as bl
from batchloom.operators import collate as C
from batchloom.operators.lengths import lengths_of

T, N = True, False


def tokens(spark, rows, schema="prompt array<int>, chosen array<int>"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"seq_id bigint, {schema}")


def collated(spark, rows, size=10, smart=False, **options):
    df = tokens(spark, rows)
    plan = bl.plan_fixed(lengths_of(df), size, smart=smart)
    return bl.collate(df, plan, ["prompt", "chosen"], ["prompt"], **options).orderBy("batch_id", "pos").collect()


HAND = [([1], [2]), ([3], [])]


def test_right(spark):
    rows = collated(spark, HAND)
    assert [r["input_ids"] for r in rows] == [[1, 2], [3, 0]]
    assert [r["attention_mask"] for r in rows] == [[T, T], [T, N]]
    assert [r["labels"] for r in rows] == [[-100, 2], [-100, -100]]


def test_left(spark):
    rows = collated(spark, HAND, padding_side="left")
    assert [r["input_ids"] for r in rows] == [[1, 2], [0, 3]]
    assert [r["attention_mask"] for r in rows] == [[T, T], [N, T]]
    assert [r["labels"] for r in rows] == [[-100, 2], [-100, -100]]


def test_an_empty_row_is_all_padding(spark):
    rows = collated(spark, [([], []), ([5], [6])], padding_side="left")
    assert [r["input_ids"] for r in rows] == [[0, 0], [5, 6]]
    assert rows[0]["attention_mask"] == [N, N]


def test_without_labels(spark):
    assert "labels" not in collated(spark, HAND, with_labels=False)[0].asDict()


def test_fixed_length(spark):
    assert [r["input_ids"] for r in collated(spark, HAND, pad_to=4)] == [[1, 2, 0, 0], [3, 0, 0, 0]]
    with pytest.raises(Exception, match="longer than the fixed length"):
        collated(spark, HAND, pad_to=1)


def test_unknown_side(spark):
    with pytest.raises(ValueError):
        collated(spark, HAND, padding_side="up")


def test_rows_of_a_batch_have_one_width_and_lose_nothing(spark):
    rows = [(list(range(i % 7)), list(range(i % 11))) for i in range(200)]
    out = collated(spark, rows, size=16, smart=True)
    widths = {}
    for r in out:
        assert {len(r["input_ids"]), len(r["attention_mask"]), len(r["labels"])} == {r["pad_to"]}
        assert widths.setdefault(r["batch_id"], r["pad_to"]) == r["pad_to"]
        assert sum(r["attention_mask"]) == r["n_tokens"]
    assert sum(r["n_tokens"] for r in out) == sum(len(p) + len(c) for p, c in rows)
    assert len(out) == 200


def test_some_fields_only(spark):
    df = tokens(spark, [([1] * 9, [2]), ([3], [4, 5])])
    plan = bl.plan_fixed(lengths_of(df), 2)
    rows = bl.collate(df, plan, ["chosen"]).orderBy("pos").collect()
    assert sorted(r["input_ids"] for r in rows) == [[2, 0], [4, 5]]
    narrow = bl.plan_over_fields(plan, df, ["chosen"])
    placed = bl.place_rows(narrow, bl.shard_batches(narrow.batches, 2))
    rows = bl.collate(df, narrow, ["chosen"], placement=placed).collect()
    assert sorted((r["rank"], r["input_ids"]) for r in rows) == [(k, x) for k in (0, 1) for x in ([2, 0], [4, 5])]


def split_case(spark):
    df = tokens(spark, [(list(range(1, 6)),), ([9],), ([],)], "content array<int>")
    return df, bl.plan_max_length(lengths_of(df, key="content"), 2, 2, key="content")


def test_split_records(spark):
    df, plan = split_case(spark)
    rows = bl.collate(df, plan, ["content"]).orderBy("batch_id", "pos").collect()
    assert [(r["batch_id"], r["input_ids"]) for r in rows] == [
        (0, [1, 2]),
        (0, [3, 4]),
        (1, [5]),
        (1, [9]),
        (2, []),
    ]


def test_chunks_keep_the_split_field_alone(spark):
    df = tokens(spark, [([1], [1, 2, 3]), ([7], [8])])
    rows = C.split_records(df, "chosen", 2).orderBy("seq_id", "chunk").collect()
    assert [(r["seq_id"], r["chunk"], r["prompt"], r["chosen"]) for r in rows] == [
        (0, 0, None, [1, 2]),
        (0, 1, None, [3]),
        (1, 0, [7], [8]),
    ]
    plan = bl.plan_max_length(lengths_of(df, key="chosen"), 2, 2, key="chosen")
    assert plan.batches.agg(F.sum("tokens")).first()[0] == 2 + 1 + 2
    with pytest.raises(Exception, match="prompt is missing"):
        bl.collate(df, plan, ["prompt", "chosen"]).collect()


def test_matrices(spark):
    df, plan = split_case(spark)
    rows = bl.batch_matrices(bl.collate(df, plan, ["content"])).orderBy("batch_id").collect()
    assert [r["input_ids"] for r in rows] == [[[1, 2], [3, 4]], [[5], [9]], [[]]]
    assert C.single_batch([rows[0]])["n_rows"] == 2
    with pytest.raises(ValueError):
        C.single_batch(rows)


def test_a_batch_of_many_empty_records_is_spread(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE_ROWS", 16)
    df = tokens(spark, [([],) for _ in range(100)] + [([1, 2],)], "content array<int>")
    plan = bl.plan_capacity(lengths_of(df), 300)
    rows = bl.collate(df, plan, ["content"])
    assert rows.count() == 101
    matrices = bl.batch_matrices(rows, max_cells=33).orderBy("batch_id", "part").collect()
    assert [m["n_rows"] for m in matrices] == [16] * 6 + [5]
    assert sum((m["input_ids"] for m in matrices), []) == [[0, 0]] * 100 + [[1, 2]]


def test_computed_ids_are_made_once_per_record_not_once_per_chunk(spark):
    records = spark.range(4).selectExpr("id AS seq_id", "repeat('ab', 500) AS content").repartition(2, "seq_id")
    df = bl.tokenize(records, bl.pretrain_spec(), bl.CodepointTokenizer())
    rows = C.split_records(df, "content", 10)
    below = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")
    assert "transform(" not in below[0] and below[1].count("transform(") == 1
    assert rows.agg(F.count("*"), F.sum(F.size("content"))).first()[:] == (400, 4000)
