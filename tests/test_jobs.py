"""The whole pipeline as jobs, from a conversation corpus to padded rows."""

import json

import pytest

from batchloom import jobs


@pytest.fixture
def corpus(spark, tmp_path):
    messages = [[(r, f"{r} says {'word ' * (i % 5)}{t}") for t, r in enumerate(["u", "a"] * (1 + i % 3))] for i in range(30)]
    df = spark.createDataFrame([(m,) for m in messages], "messages array<struct<role: string, content: string>>")
    df.write.parquet(str(tmp_path / "raw"))
    return tmp_path, sum(len(m) // 2 for m in messages)


def test_pipeline(spark, corpus, capsys):
    root, pairs = corpus
    jobs.main(["prepare", "conversations", "--input", f"{root}/raw", "--output", f"{root}/chat"])
    spec = {
        "field_names": ["prompt", "chosen"],
        "loss_masked_field_names": ["prompt"],
        "max_seq_len": 80,
        "field_max_lengths": [60, None],
        "field_truncation_sides": ["left", "right"],
        "file_format": "jsonl",
        "folder_path": f"{root}/chat",
    }
    (root / "spec.json").write_text(json.dumps(spec))
    jobs.main(["tokenize", "--spec", f"{root}/spec.json", "--spark-parts"])
    tokens = spark.read.parquet(f"{root}/chat.tokens.parquet")
    assert tokens.count() == pairs
    assert tokens.agg({"total_len": "max"}).first()[0] <= 80

    jobs.main(["count", "--input", f"{root}/chat.tokens.parquet"])
    assert str(tokens.agg({"total_len": "sum"}).first()[0]) in capsys.readouterr().out

    jobs.main(["tokenize", "--input", f"{root}/chat", "--output", f"{root}/sets/more.tokens.parquet", "--spark-parts"])
    tokens.write.parquet(f"{root}/sets/first.tokens.parquet")
    jobs.main(["merge", "--input", f"{root}/sets", "--output", f"{root}/merged"])
    assert spark.read.parquet(f"{root}/merged").count() == 2 * pairs

    for args in (
        ["--policy", "FixedBatchSize", "--batch-size", "4", "--smart"],
        ["--policy", "GPUMemoryRestricted", "--limit", "300", "--order", "pc_desc"],
        ["--policy", "LengthDifferenceRestricted", "--max-token-diff", "9", "--batch-size", "8", "--key", "prompt"],
        ["--policy", "MaxLengthRestricted", "--max-field-length", "1000", "--batch-size", "4", "--key", "chosen"],
    ):
        name = args[1]
        jobs.main(["plan", "--input", f"{root}/chat.tokens.parquet", "--output", f"{root}/{name}", *args])
        jobs.main(
            ["collate", "--tokens", f"{root}/chat.tokens.parquet", "--plan", f"{root}/{name}"]
            + ["--output", f"{root}/{name}.rows", "--world-size", "2"]
        )
        rows = spark.read.parquet(f"{root}/{name}.rows")
        assert rows.dropDuplicates(["batch_id", "pos"]).count() == pairs
        assert rows.where("size(input_ids) != pad_to or size(labels) != pad_to").count() == 0
        assert {r["rank"] for r in rows.select("rank").distinct().collect()} == {0, 1}


def test_unknown_job():
    with pytest.raises(SystemExit):
        jobs.main(["dance"])
