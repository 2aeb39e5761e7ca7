import json
import random

import pytest
from pyspark.sql import Observation

import batchloom as bl
from batchloom.sources import records as R
from batchloom.sources.files import NameFilter, list_files, mirror_paths
from batchloom.sources.tokensets import merge_token_sets, read_token_folder
from batchloom.sinks.writers import token_set_path, write_token_set


@pytest.fixture
def tree(tmp_path):
    for name in ("a.json", "adjson", "b.jsonl", "pre_x.txt", "sub/c.json", "sub/deep/pre_[1].txt"):
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    return str(tmp_path / "tree")


@pytest.mark.parametrize(
    "names,expected",
    [
        (NameFilter(), ["a.json", "adjson", "b.jsonl", "pre_x.txt", "sub/c.json", "sub/deep/pre_[1].txt"]),
        (NameFilter(suffix="json"), ["a.json", "adjson", "sub/c.json"]),
        (NameFilter(prefix="pre"), ["pre_x.txt", "sub/deep/pre_[1].txt"]),
        (NameFilter(contains="d"), ["adjson"]),
        (NameFilter(contains="[1]"), ["sub/deep/pre_[1].txt"]),
        (NameFilter(regex="a.*n|c"), ["a.json", "adjson", "sub/c.json"]),
    ],
)
def test_listing(spark, tree, names, expected):
    rows = list_files(spark, tree, names).collect()
    assert sorted(r["relative_path"] for r in rows) == expected
    assert all(r["length"] == len(r["relative_path"]) for r in rows)


def test_listing_one_level(spark, tree):
    rows = list_files(spark, tree, NameFilter(suffix="json"), recursive=False).collect()
    assert sorted(r["name"] for r in rows) == ["a.json", "adjson"]


def test_listing_reads_no_contents(spark, tree):
    plan = list_files(spark, tree)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        list_files(spark, str(tmp_path / "none")).collect()


def test_one_condition_only():
    with pytest.raises(ValueError):
        NameFilter(suffix="a", prefix="b")


def test_mirror_paths(spark, tree):
    rows = mirror_paths(spark, tree, "/out/", NameFilter(suffix="c.json")).collect()
    assert [r["mirror_path"] for r in rows] == ["/out/sub/c.json"]


LINES = ['{"prompt":"p","chosen":"ü\\n"}', "bad", "{}", "[]", "null", "0", '""', "false", "-0.00", "0e5", "", "  "]


def test_jsonl(spark, tmp_path):
    folder = tmp_path / "data"
    (folder / "deep").mkdir(parents=True)
    (folder / "x.jsonl").write_text("\n".join(LINES) + "\n")
    (folder / "deep" / "y.jsonl").write_text('{"prompt":"q","chosen":"c","more":1}\r\n')
    (folder / "z.json").write_text('{"prompt":"no","chosen":"no"}')
    seen = Observation("lines")
    records = R.read_jsonl(spark, str(folder), ["prompt", "chosen"], observation=seen)
    assert sorted(map(tuple, records.collect())) == [("p", "ü\n"), ("q", "c")]
    assert seen.get == {"lines": 13, "undecodable": 3, "empty": 8}


def test_dataset_by_spec(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "x.jsonl").write_text('{"prompt":"p","chosen":"c","more":1}\n')
    (folder / "x.json").write_text('[{"prompt":"1","chosen":"2"},{"prompt":"3","chosen":"4"}]')
    (folder / "x.txt").write_bytes(b"a\r\nb\rc\n")
    read = lambda spec: sorted(map(tuple, R.read_dataset(spark, spec).collect()))
    assert read(bl.sft_spec(str(folder))) == [("p", "c")]
    assert read(bl.sft_spec(str(folder), file_format="json")) == [("1", "2"), ("3", "4")]
    assert read(bl.pretrain_spec(str(folder))) == [("a\nb\nc\n",)]
    with pytest.raises(Exception, match="question is missing"):
        read(bl.inference_spec(str(folder)))
    with pytest.raises(ValueError):
        R.read_dataset(spark, bl.sft_spec())


def test_bad_json_array_aborts(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"prompt":"1"}, oops]')
    with pytest.raises(Exception):
        R.read_json_arrays(spark, str(tmp_path), ["prompt"]).collect()


def test_strict_lines_abort(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":"1"}\noops\n')
    with pytest.raises(Exception):
        R.read_strict_jsonl(spark, str(tmp_path), ["a"]).collect()


def test_keyed_json(spark, tmp_path):
    value = {"7": {"source": "s", "rationale": "r", "target": "t"}, "8": {"source": "x", "rationale": "y", "target": "z"}}
    (tmp_path / "x.json").write_text(json.dumps(value, indent=1))
    rows = R.read_keyed_json(spark, str(tmp_path), ["source", "rationale", "target"]).collect()
    assert sorted(map(tuple, rows)) == [("7", "s", "r", "t"), ("8", "x", "y", "z")]


def test_lines_are_not_lost_by_their_size(spark, tmp_path):
    """Strings over the limit of the first parser come back whole; long lines that are no JSON are counted."""
    folder = tmp_path / "long"
    folder.mkdir()
    sizes = (1_000_000, 21_000_000, 150_000_000)
    for size in sizes:
        (folder / f"{size}.jsonl").write_text('{"a": "' + "x" * size + '", "n": 1}\n')
    (folder / "bad.jsonl").write_text('{"a": "' + "x" * 21_000_000 + "\n{}\n")
    (folder / "part-0.json").write_text('{"a": "foreign"}\n')
    seen = Observation()
    records = R.read_jsonl(spark, str(folder), ["a", "n"], observation=seen)
    rows = records.selectExpr("length(a) AS size", "n").collect()
    assert sorted(r["size"] for r in rows) == list(sizes) and {r["n"] for r in rows} == {"1"}
    assert seen.get == {"lines": 5, "undecodable": 1, "empty": 1}


def test_numbers_follow_the_files(spark, tmp_path):
    """The same ids for any split size, and files one after another in the order of their paths."""
    folder = tmp_path / "lines"
    folder.mkdir()
    want = []
    for name, n in (("b", 700), ("a", 500), ("c", 1)):
        lines = [f'{{"prompt": "{name}{i}", "chosen": "x"}}' if i % 7 else "no json" for i in range(n)]
        (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    at = 0
    for name, n in (("a", 500), ("b", 700), ("c", 1)):
        want += [(at + i, f"{name}{i}") for i in range(n) if i % 7]
        at += n
    for split in ("128m", "3000", "777"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            records = bl.read_dataset(spark, bl.sft_spec(str(folder), file_format="jsonl"), numbered=True)
            assert sorted((r["seq_id"], r["prompt"]) for r in records.collect()) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbered_records_keep_their_ids(spark):
    records = spark.createDataFrame([(f"t{i}",) for i in range(100)], "content string").repartition(7)
    numbered = bl.number_records(records)
    first = sorted(map(tuple, numbered.collect()))
    assert first == sorted(map(tuple, numbered.repartition(3).collect()))
    assert len({seq for seq, _ in first}) == 100
    with pytest.raises(ValueError):
        bl.number_records(numbered)


def tokens(spark, n, first=0):
    rows = [(first + i, [i] * (i % 4)) for i in range(n)]
    return spark.createDataFrame(rows, "seq_id bigint, content array<int>")


def test_merged_sets(spark):
    merged = merge_token_sets(tokens(spark, 3), tokens(spark, 2, first=5), tokens(spark, 0), tokens(spark, 2))
    assert [tuple(r) for r in merged.orderBy("seq_id").collect()] == [
        (0, []),
        (1, [1]),
        (2, [2, 2]),
        (8, []),
        (9, [1]),
        (10, []),
        (11, [1]),
    ]
    with pytest.raises(ValueError):
        merge_token_sets(tokens(spark, 1), tokens(spark, 1).withColumnRenamed("content", "x"))


def test_sets_with_other_columns_are_refused(spark, tmp_path):
    tokens(spark, 3).write.parquet(f"{tmp_path}/a.tokens.parquet")
    tokens(spark, 3).withColumnRenamed("content", "other").write.parquet(f"{tmp_path}/b.tokens.parquet")
    with pytest.raises(ValueError):
        read_token_folder(spark, str(tmp_path))


def test_folder_of_sets(spark, tmp_path):
    assert token_set_path("/data/chat/") == "/data/chat.tokens.parquet"
    for name, n in (("b", 2), ("a", 3)):
        write_token_set(tokens(spark, n), token_set_path(str(tmp_path / name)))
    (tmp_path / "other.parquet").write_text("not a set")
    merged = read_token_folder(spark, str(tmp_path))
    assert merged.count() == 5
    assert [r["total_len"] for r in merged.orderBy("seq_id").collect()] == [0, 1, 2, 0, 1]


def awkward_records(n, seed=1):
    rng = random.Random(seed)
    bits = ['"', "\\", "[", "]", "{", "}", ",", ":", "\n", "é", "中", "😀", " ", "\\\"", "],[", "x" * 50]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    return [{"source": text(), "more": [text(), {"deep": [text(), [1, {"a": text()}]]}], "target": text() or None} for _ in range(n)]


@pytest.mark.parametrize("split", ["128m", "1000", "113"])
def test_json_files_are_cut_by_an_index(spark, tmp_path, split):
    """Strings with signs and escapes, nested values, multi-byte characters and any layout, in any splits."""
    records = awkward_records(60)
    layouts = [dict(), dict(indent=2), dict(ensure_ascii=False), dict(separators=(",", ":")), dict(indent="\t", ensure_ascii=False)]
    arrays, keyed = tmp_path / "arrays", tmp_path / "keyed"
    want, entries = [], []
    for folder in (arrays, keyed):
        (folder / "sub").mkdir(parents=True)
    for i, layout in enumerate(layouts):
        part = records[i * 12 : i * 12 + 12]
        (arrays / f"{i}.json").write_text("\n " + json.dumps(part, **layout) + "\r\n", encoding="utf-8")
        (keyed / f"{i}.json").write_text(json.dumps({f'{i} ", {k}': r for k, r in enumerate(part)}, **layout), encoding="utf-8")
        want += part
        entries += [(f'{i} ", {k}', r["source"], r["target"]) for k, r in enumerate(part)]
    for i, text in enumerate(["[]", " [ ]\n", "", "  \n", '{"source": "one", "target": "object, [alone]"}', '﻿[{"source": "bom"}]']):
        (arrays / "sub" / f"{i}.json").write_text(text, encoding="utf-8")
    for i, text in enumerate(["{}", "", " { } "]):
        (keyed / "sub" / f"{i}.json").write_text(text, encoding="utf-8")
    want += [{"source": "one", "target": "object, [alone]"}, {"source": "bom", "target": None}]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = R.numbered_json(spark, str(arrays), ["source", "target"], NameFilter(suffix="json"))
        assert sorted(map(tuple, rows.collect())) == [(i, r["source"], r["target"]) for i, r in enumerate(want)]
        assert R.read_json_arrays(spark, str(arrays), ["target"], recursive=False).count() == 60
        rows = R.read_keyed_json(spark, str(keyed), ["source", "target"])
        assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, entries))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_json_file_has_many_tasks(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"a": f"text, {i}"} for i in range(20_000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        reader = spark.read.option("lineSep", ",").text(str(tmp_path))
        assert reader.rdd.getNumPartitions() > 15
        rows = R.numbered_json(spark, str(tmp_path), ["a"], NameFilter(suffix="json")).collect()
        assert sorted(map(tuple, rows)) == [(i, f"text, {i}") for i in range(20_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


BAD_JSON = ['[{"a":"1"', '[{"a":"1"},]', '[{"a":"1"},,{"a":"2"}]', '[{"a":"1}]', '[{"a":"1"}}', '[{"a":"1"}] x', '[{"a":"1"}],[{"a":"2"}]', '[null]', "[1]", "null", "x", '[{"a":"1" oops}]', ']{"a":1}[', '{"a":"1"} {"a":"2"}']


@pytest.mark.parametrize("text", BAD_JSON)
def test_bad_json_aborts(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="JSON|Malformed|malformed"):
        R.read_json_arrays(spark, str(tmp_path), ["a"]).collect()
    keyed = text.replace("[", "{", 1)[::-1].replace("]", "}", 1)[::-1]
    (tmp_path / "bad.json").write_text(keyed)
    with pytest.raises(Exception, match="JSON|Malformed|malformed"):
        R.read_keyed_json(spark, str(tmp_path), ["a"]).collect()


def test_numbered_json_dataset(spark, tmp_path):
    for name, n in (("b", 3), ("a", 2), ("c", 0)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"prompt": f"{name}{i}", "chosen": "x"} for i in range(n)]))
    rows = R.read_dataset(spark, bl.sft_spec(str(tmp_path), file_format="json"), numbered=True)
    assert sorted((r.seq_id, r.prompt) for r in rows.collect()) == [(0, "a0"), (1, "a1"), (2, "b0"), (3, "b1"), (4, "b2")]
