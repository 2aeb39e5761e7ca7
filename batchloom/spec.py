"""Dataset specifications: which fields a dataset has and how each one is cut to a token budget.

Specs are configuration. They live on the driver and turn into column expressions.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

# Accepted file formats and truncation sides.
FILE_FORMATS = ("json", "jsonl", "txt")
SIDES = ("left", "right", "none")

SFT_FIELDS = ("prompt", "chosen")
PRETRAIN_FIELDS = ("content",)
INFERENCE_FIELDS = ("question",)
DEFAULT_MAX_SEQ_LEN = 4096
PROMPT_SHARE = 0.75
ANSWER_RESERVE = 100


@dataclass(frozen=True)
class FieldSpec:
    """One field: its own maximum (None: what is left of the record) and the side that is cut."""

    name: str
    max_len: int | None
    side: str
    loss_masked: bool


@dataclass(frozen=True)
class DatasetSpec:
    """Fields of a dataset, the token budget of a record, and where the files are.

    ``max_seq_len`` None means that nothing is truncated, whatever the fields say. A dataset that
    does not come from files leaves ``file_format`` and ``folder_path`` out.
    """

    field_names: Sequence[str]
    dataset_name: str = "default_dataset"
    loss_masked_field_names: Sequence[str] = ()
    max_seq_len: int | None = None
    field_max_lengths: Sequence[int | None] | None = None
    field_truncation_sides: Sequence[str | None] | None = ("right",)
    file_format: str | None = None
    folder_path: str | None = None

    def __post_init__(self) -> None:
        names = tuple(self.field_names or ())
        if not names:
            raise ValueError("field_names is required")
        if len(set(names)) != len(names):
            raise ValueError(f"field_names repeat: {names}")
        maxima = self.field_max_lengths
        maxima = (None,) * len(names) if maxima is None else tuple(maxima)
        sides = self.field_truncation_sides
        if sides is None:
            sides = ("none",) * len(names)
        elif tuple(sides) == ("right",):
            sides = ("right",) * len(names)
        sides = tuple("none" if side is None else side for side in sides)
        for what, values in (("field_max_lengths", maxima), ("field_truncation_sides", sides)):
            if len(values) != len(names):
                raise ValueError(f"{what} needs one entry per field, got {len(values)}")
        bad = [side for side in sides if side not in SIDES]
        if bad:
            raise ValueError(f"unknown truncation sides {bad}, use one of {SIDES}")
        if self.max_seq_len and sum(m for m in maxima if m is not None) > self.max_seq_len:
            raise ValueError("the field maxima add up to more than max_seq_len")
        if self.file_format is not None or self.folder_path is not None:
            if self.file_format not in FILE_FORMATS:
                raise ValueError(
                    f"file format {self.file_format!r} not supported, use one of {FILE_FORMATS}"
                )
            if not self.folder_path:
                raise ValueError("folder_path is required")
        object.__setattr__(self, "field_names", names)
        object.__setattr__(self, "field_max_lengths", maxima)
        object.__setattr__(self, "field_truncation_sides", sides)
        object.__setattr__(self, "loss_masked_field_names", tuple(self.loss_masked_field_names or ()))

    def __iter__(self) -> Iterator[FieldSpec]:
        for name, max_len, side in zip(
            self.field_names, self.field_max_lengths, self.field_truncation_sides
        ):
            yield FieldSpec(name, max_len, side, name in self.loss_masked_field_names)

    def __len__(self) -> int:
        return len(self.field_names)

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> "DatasetSpec":
        known = {name: values[name] for name in cls.__dataclass_fields__ if name in values}
        if "field_names" not in known:
            raise ValueError("field_names is required")
        return cls(**known)

    @classmethod
    def from_file(cls, path: str) -> "DatasetSpec":
        """A spec of a file dataset; format and folder must be in it."""
        with open(path, encoding="utf-8") as source:
            values = json.load(source)
        spec = cls.from_dict(values)
        if spec.folder_path is None:
            raise ValueError("folder_path is required")
        return spec


def _base_name(folder: str | None) -> str:
    return posixpath.basename(folder.rstrip("/")) if folder else "default_dataset"


def _given(**values: Any) -> dict[str, Any]:
    """Options that were really set, so that an unset job option never replaces a default."""
    return {name: value for name, value in values.items() if value is not None}


def sft_spec(
    folder_path: str | None = None, max_seq_len: int | None = None, **overrides: Any
) -> DatasetSpec:
    """Prompt and answer: the prompt gets three quarters and loses its head, the answer the rest."""
    limit = max_seq_len or DEFAULT_MAX_SEQ_LEN
    values = dict(
        dataset_name=_base_name(folder_path),
        field_names=SFT_FIELDS,
        loss_masked_field_names=("prompt",),
        max_seq_len=limit,
        field_max_lengths=(int(PROMPT_SHARE * limit), None),
        field_truncation_sides=("left", "right"),
        file_format="jsonl" if folder_path else None,
        folder_path=folder_path,
    )
    return DatasetSpec(**{**values, **_given(**overrides)})


def pretrain_spec(
    folder_path: str | None = None, max_seq_len: int | None = None, **overrides: Any
) -> DatasetSpec:
    """Plain text, one file per record, not truncated unless sides are given."""
    values = dict(
        dataset_name=_base_name(folder_path),
        field_names=PRETRAIN_FIELDS,
        max_seq_len=max_seq_len,
        field_max_lengths=(None,),
        field_truncation_sides=None,
        file_format="txt" if folder_path else None,
        folder_path=folder_path,
    )
    return DatasetSpec(**{**values, **_given(**overrides)})


def inference_spec(
    folder_path: str | None = None, max_seq_len: int | None = None, **overrides: Any
) -> DatasetSpec:
    """Questions, cut at the head so that room for an answer remains."""
    limit = max_seq_len or DEFAULT_MAX_SEQ_LEN
    values = dict(
        dataset_name=_base_name(folder_path),
        field_names=INFERENCE_FIELDS,
        max_seq_len=limit,
        field_max_lengths=(limit - ANSWER_RESERVE,),
        field_truncation_sides=("left",),
        file_format="jsonl" if folder_path else None,
        folder_path=folder_path,
    )
    return DatasetSpec(**{**values, **_given(**overrides)})
