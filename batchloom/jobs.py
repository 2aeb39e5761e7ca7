"""The pipeline as jobs: ``spark-submit … batchloom/jobs.py <job> …`` or ``python -m batchloom.jobs``.

prepare     raw corpora to prompt / chosen records (JSON lines)
tokenize    a dataset folder to a tokenized set beside it
merge       the tokenized sets of a folder to one
count       tokens of a tokenized set
plan        a tokenized set to a plan of batches beside it
collate     tokens and plan to padded rows, by rank and step
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

import batchloom as bl
from batchloom.operators.collate import plan_over_fields
from batchloom.operators.lengths import lengths_of
from batchloom.operators.shard import TASKS, task_fields
from batchloom.plans.measures import token_total
from batchloom.plans.policies import CAPACITY, DIFFERENCE, FIXED, MAX_LENGTH, ORDERS, POLICIES
from batchloom.session import get_session
from batchloom.sinks import writers
from batchloom.sources.files import ANY_NAME
from batchloom.sources.records import JSONL_OR_PARTS, read_keyed_json, read_parquet, read_strict_jsonl
from batchloom.sources.tokensets import read_token_folder, read_token_set


def _prepared(spark: SparkSession, kind: str, path: str) -> DataFrame:
    if kind == "conversations":
        pairs = bl.conversation_pairs(read_parquet(spark, path, ["messages"]))
        return pairs.select("prompt", "chosen")
    if kind == "questions":
        return bl.question_pairs(read_parquet(spark, path, ["question", "answer"]))
    if kind == "instructions":
        return bl.instruction_pairs(read_strict_jsonl(spark, path, ["instruction", "context", "response"]))
    records = read_keyed_json(spark, path, ["source", "rationale", "target"], ANY_NAME)
    return bl.reasoning_pairs(records)


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    writers.write_jsonl(_prepared(spark, args.kind, args.input), args.output)


def _tokenizer(spark: SparkSession, name: str, vocabulary: str | None) -> bl.Tokenizer:
    if vocabulary:
        return bl.VocabularyTokenizer(spark.read.parquet(vocabulary))
    if name == "codepoint":
        return bl.CodepointTokenizer()
    module, _, function = name.partition(":")
    return bl.ObjectTokenizer(getattr(importlib.import_module(module), function))


def tokenize(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.spec:
        spec = bl.DatasetSpec.from_file(args.spec)
    else:
        preset = {"pt": bl.pretrain_spec, "inference": bl.inference_spec}.get(args.task, bl.sft_spec)
        spec = preset(args.input, args.max_seq_len, **({"file_format": args.file_format} if args.file_format else {}))
    names = JSONL_OR_PARTS if args.spark_parts else None
    records = bl.read_dataset(spark, spec, names=names, numbered=True)
    tokens = bl.tokenize(records, spec, _tokenizer(spark, args.tokenizer, args.vocabulary), args.on_exhausted)
    writers.write_token_set(tokens, args.output or writers.token_set_path(spec.folder_path))


def merge(spark: SparkSession, args: argparse.Namespace) -> None:
    writers.write_token_set(read_token_folder(spark, args.input), args.output)


def count(spark: SparkSession, args: argparse.Namespace) -> None:
    token_total(read_token_set(spark, args.input)).show(truncate=False)


def plan(spark: SparkSession, args: argparse.Namespace) -> None:
    tokens = read_token_set(spark, args.input)
    smart = True if args.smart else None
    knobs = {
        FIXED: {"batch_size": args.batch_size, "smart": smart},
        CAPACITY: {"limit": args.limit, "order": args.order, "seed": args.seed},
        DIFFERENCE: {"max_token_diff": args.max_token_diff, "max_plan_size": args.batch_size},
        MAX_LENGTH: {
            "max_field_length": args.max_field_length,
            "batch_size": args.batch_size,
            "smart": smart,
            "key": args.key,
        },
    }[args.policy]
    key = args.key if args.policy in (DIFFERENCE, MAX_LENGTH) else None
    made = bl.plan(lengths_of(tokens, key=key), args.policy, **knobs)
    writers.write_plan(made, args.output or writers.plan_path(args.input, made.policy, made.knobs))


def collate(spark: SparkSession, args: argparse.Namespace) -> None:
    tokens, made = read_token_set(spark, args.tokens), writers.read_plan(spark, args.plan)
    fields, masked = task_fields(args.task, bl.DatasetSpec.from_file(args.spec) if args.spec else None)
    made = plan_over_fields(made, tokens, fields)
    shards = bl.shard_batches(made.batches, args.world_size, args.accumulation, args.shuffle, args.seed)
    rows = bl.collate(
        tokens,
        made,
        fields,
        masked,
        padding_side=args.padding_side,
        placement=bl.place_rows(made, shards),
        partition_by=writers.ARRANGED,
    )
    writers.write_training_rows(rows, args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = top.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("prepare")
    job.add_argument("kind", choices=("conversations", "questions", "instructions", "reasoning"))
    job.add_argument("--input", required=True)
    job.add_argument("--output", required=True)

    job = jobs.add_parser("tokenize")
    where = job.add_mutually_exclusive_group(required=True)
    where.add_argument("--spec", help="JSON file of a dataset spec")
    where.add_argument("--input", help="dataset folder, read by the preset of --task")
    job.add_argument("--task", choices=(*TASKS, "inference"), default="sft")
    job.add_argument("--max-seq-len", type=int)
    job.add_argument("--file-format")
    job.add_argument("--spark-parts", action="store_true", help="read the part files of `prepare` too")
    job.add_argument("--tokenizer", default="codepoint", help="codepoint, or module:factory")
    job.add_argument("--vocabulary", help="Parquet table (token, id)")
    job.add_argument("--on-exhausted", default="keep")
    job.add_argument("--output")

    for name in ("merge", "count"):
        job = jobs.add_parser(name)
        job.add_argument("--input", required=True)
        if name == "merge":
            job.add_argument("--output", required=True)

    job = jobs.add_parser("plan")
    job.add_argument("--input", required=True, help="tokenized set")
    job.add_argument("--output")
    job.add_argument("--policy", required=True, choices=POLICIES)
    job.add_argument("--batch-size", type=int)
    job.add_argument("--limit", type=int, help="padded tokens per batch")
    job.add_argument("--order", choices=ORDERS)
    job.add_argument("--seed", type=int)
    job.add_argument("--key", help="the field whose length counts")
    job.add_argument("--max-token-diff", type=int)
    job.add_argument("--max-field-length", type=int)
    job.add_argument("--smart", action="store_true", help="sort by length first")

    job = jobs.add_parser("collate")
    job.add_argument("--tokens", required=True)
    job.add_argument("--plan", required=True)
    job.add_argument("--output", required=True)
    job.add_argument("--task", choices=TASKS, default="sft")
    job.add_argument("--spec", help="JSON file of a dataset spec; its fields replace those of the task")
    job.add_argument("--world-size", type=int, default=1)
    job.add_argument("--accumulation", type=int, default=1)
    job.add_argument("--shuffle", action="store_true")
    job.add_argument("--seed", type=int, default=0)
    job.add_argument("--padding-side", choices=("left", "right"), default="right")
    return top


JOBS = {f.__name__: f for f in (prepare, tokenize, merge, count, plan, collate)}


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    JOBS[args.job](get_session(f"batchloom {args.job}"), args)


if __name__ == "__main__":
    main()
