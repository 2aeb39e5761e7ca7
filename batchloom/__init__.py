"""Token-batch preparation on Spark: read, prepare, tokenize, plan, collate, shard, report."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from batchloom.operators.collate import batch_matrices, collate, plan_over_fields, split_records
from batchloom.operators.lengths import lengths_of, sort_by_length
from batchloom.operators.ordinal import with_ordinal
from batchloom.operators.prepare import (
    conversation_pairs,
    instruction_pairs,
    nest_turns,
    project_fields,
    question_pairs,
    reasoning_pairs,
)
from batchloom.operators.shard import accumulation_steps, place_rows, shard_batches, task_fields
from batchloom.operators.tokenize import (
    CodepointTokenizer,
    ObjectTokenizer,
    SpecialTokens,
    Tokenizer,
    VocabularyTokenizer,
    build_vocabulary,
    map_records,
    tokenize,
)
from batchloom.plans.policies import (
    BatchPlan,
    order_batches,
    plan,
    plan_capacity,
    plan_difference,
    plan_fixed,
    plan_max_length,
    rank_lengths,
)
from batchloom.sources.records import number_records, read_dataset
from batchloom.spec import DatasetSpec, inference_spec, pretrain_spec, sft_spec

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("sys", "cloudpickle")]
