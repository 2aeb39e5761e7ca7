import json

import pytest

from batchloom.operators.shard import task_fields
from batchloom.spec import DatasetSpec, inference_spec, pretrain_spec, sft_spec


def test_defaults():
    spec = DatasetSpec(field_names=["a", "b"])
    assert spec.dataset_name == "default_dataset"
    assert [(f.name, f.max_len, f.side, f.loss_masked) for f in spec] == [
        ("a", None, "right", False),
        ("b", None, "right", False),
    ]
    assert len(spec) == 2


def test_sides_that_are_not_given_do_not_cut():
    spec = DatasetSpec(field_names=["a"], field_truncation_sides=None)
    assert [f.side for f in spec] == ["none"]


@pytest.mark.parametrize(
    "values",
    [
        {"field_names": []},
        {"field_names": ["a", "a"]},
        {"field_names": ["a"], "field_max_lengths": [1, 2]},
        {"field_names": ["a", "b"], "field_truncation_sides": ["left"]},
        {"field_names": ["a"], "field_truncation_sides": ["up"]},
        {"field_names": ["a", "b"], "max_seq_len": 10, "field_max_lengths": [6, 5]},
        {"field_names": ["a"], "file_format": "csv", "folder_path": "/x"},
        {"field_names": ["a"], "file_format": "jsonl"},
        {"field_names": ["a"], "folder_path": "/x"},
    ],
)
def test_refused(values):
    with pytest.raises(ValueError):
        DatasetSpec(**values)


def test_field_maxima_may_be_partly_open():
    spec = DatasetSpec(field_names=["a", "b"], max_seq_len=10, field_max_lengths=[6, None])
    assert [f.max_len for f in spec] == [6, None]


def test_presets():
    spec = sft_spec("/data/chat/")
    assert (spec.dataset_name, spec.max_seq_len, spec.file_format) == ("chat", 4096, "jsonl")
    assert [(f.name, f.max_len, f.side, f.loss_masked) for f in spec] == [
        ("prompt", 3072, "left", True),
        ("chosen", None, "right", False),
    ]
    assert sft_spec(max_seq_len=10).field_max_lengths == (7, None)
    spec = pretrain_spec("/data/text")
    assert (spec.max_seq_len, spec.file_format, [f.side for f in spec]) == (None, "txt", ["none"])
    spec = inference_spec("/data/ask")
    assert [(f.name, f.max_len, f.side) for f in spec] == [("question", 3996, "left")]


def test_unset_options_keep_the_defaults():
    spec = sft_spec("/data/chat", None, file_format=None, field_max_lengths=None)
    assert (spec.max_seq_len, spec.file_format, spec.field_max_lengths) == (4096, "jsonl", (3072, None))


def test_from_file(tmp_path):
    path = tmp_path / "spec.json"
    path.write_text(
        json.dumps(
            {
                "dataset_name": "mine",
                "field_names": ["prompt", "chosen"],
                "loss_masked_field_names": ["chosen"],
                "max_seq_len": 100,
                "field_max_lengths": [60, None],
                "field_truncation_sides": ["left", "right"],
                "file_format": "jsonl",
                "folder_path": "/data/mine",
            }
        )
    )
    spec = DatasetSpec.from_file(str(path))
    assert [(f.name, f.max_len, f.side, f.loss_masked) for f in spec] == [
        ("prompt", 60, "left", False),
        ("chosen", None, "right", True),
    ]
    assert task_fields("sft", spec) == (["prompt", "chosen"], ["chosen"])
    path.write_text(json.dumps({"field_names": ["a"]}))
    with pytest.raises(ValueError, match="folder_path"):
        DatasetSpec.from_file(str(path))


def test_task_fields():
    assert task_fields("sft") == (["prompt", "chosen"], ["prompt"])
    assert task_fields("pt") == (["content"], [])
    with pytest.raises(ValueError):
        task_fields("other")
