"""The registered queries: one per operator, over whole tables.

Each takes (spark, folder of Parquet tables) and gives a DataFrame of scalars, arrays as the md5 of
their comma-joined entries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import batchloom as bl
from batchloom.functions.arrays import truncate
from batchloom.functions.text import word_count
from batchloom.operators import reports
from batchloom.operators.collate import batch_matrices, collate
from batchloom.operators.lengths import lengths_of, sort_by_length
from batchloom.operators.shard import (
    accumulation_steps,
    place_rows,
    shard_batches,
    step_layout,
    with_loss_weight,
)
from batchloom.plans import measures, probe
from batchloom.plans.policies import POLICIES, BatchPlan, order_batches, plan as plan_by_name, rank_lengths
from batchloom.session import scratch_path
from batchloom.sinks.filetree import mirror_files
from batchloom.sinks.mirror import process_to_mirror
from batchloom.sinks.writers import (
    ARRANGED,
    read_plan,
    read_training_set,
    write_jsonl,
    write_plan,
    write_token_set,
    write_training_rows,
    write_training_set,
)
from batchloom.sources.files import NameFilter, list_files
from batchloom.streaming.tokens import stream_token_set
from batchloom.sources.records import (
    read_json_arrays,
    read_dataset,
    read_keyed_json,
    read_parquet,
    read_strict_jsonl,
    read_texts,
)
from batchloom.sources.tokensets import merge_token_sets, read_token_folder, read_token_set

LIMIT = 4000
BATCH = 8
PIECE = 100
SFT_MAX = 1000
PAIR_SHIFT = 1 << 20
DOCS_PER_FILE = 64

Query = Callable[[SparkSession, str], DataFrame]

#: Documents are numbered from 0; fewer than 2^36 of them need a level less to be ranked.
DOC_ID_BITS = 36


# ---- inputs -----------------------------------------------------------------------------------


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents as records: seq_id, content and ``columns``."""
    path = f"{folder}/documents.parquet"
    docs = read_parquet(spark, path, ["doc_id", "text", *columns])
    return docs.select(F.col("doc_id").alias("seq_id"), F.col("text").alias("content"), *columns)


def _word_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("seq_id", word_count(F.col("content")).alias("len"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = bl.conversation_pairs(bl.nest_turns(_table(spark, folder, "conversations")))
    beyond = F.raise_error(F.lit("a conversation is too long, or its number too large, for one id")).cast("bigint")
    fits = (F.col("turn") < PAIR_SHIFT) & (F.col("conv_id") < (1 << 43))
    seq = F.when(fits, F.col("conv_id") * PAIR_SHIFT + F.col("turn")).otherwise(beyond)
    return pairs.select(seq.alias("seq_id"), "prompt", "chosen")


def _pair_tokens(spark: SparkSession, folder: str) -> DataFrame:
    spec = bl.sft_spec(max_seq_len=SFT_MAX)
    return bl.tokenize(_pairs(spark, folder), spec, bl.CodepointTokenizer())


def _document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return bl.tokenize(_documents(spark, folder), bl.pretrain_spec(), bl.CodepointTokenizer())


def _joined(ids: Column) -> Column:
    return F.md5(F.array_join(ids.cast("array<string>"), ","))


def _big(df: DataFrame) -> DataFrame:
    """Integers as BIGINT."""
    return df.select(
        *(F.col(n).cast("bigint").alias(n) if t in ("int", "smallint") else F.col(n) for n, t in df.dtypes)
    )


# ---- preparation ------------------------------------------------------------------------------


def prep_conversation_pairs(spark, folder):
    pairs = bl.conversation_pairs(bl.nest_turns(_table(spark, folder, "conversations")))
    return _big(pairs.select("conv_id", "turn", "prompt", "chosen"))


def prep_question_pairs(spark, folder):
    docs = _table(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("question"), F.col("source").alias("answer")
    )
    return bl.question_pairs(docs, keep=["doc_id"])


def prep_instruction_pairs(spark, folder):
    docs = _table(spark, folder, "documents").select(
        "doc_id",
        F.col("source").alias("instruction"),
        F.col("text").alias("context"),
        F.col("lang").alias("response"),
    )
    return bl.instruction_pairs(docs, keep=["doc_id"])


def prep_reasoning_pairs(spark, folder):
    docs = _table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("source"), F.col("text").alias("rationale"), F.col("source").alias("target")
    )
    return bl.reasoning_pairs(docs, keep=["doc_id"])


def project_fields(spark, folder):
    return bl.project_fields(
        _documents(spark, folder, "lang", "source").withColumnRenamed("seq_id", "doc_id"), ["source", "content"], keep=["doc_id"]
    )


# ---- sources and sinks ------------------------------------------------------------------------


def source_jsonl(spark, folder):
    """Good lines, lines that are not JSON and empty values go out beside files of other kinds; the good
    ones come back."""
    path = scratch_path(spark, "jsonl")
    docs = _table(spark, folder, "documents")
    write_jsonl(docs.select(F.lit("-1").alias("doc_id"), F.col("text").alias("content")), f"{path}/parts")
    good = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content")))
    bad = F.concat(F.lit("not json "), F.regexp_replace("text", "[\r\n]", " "))
    lines = docs.select(
        F.explode(F.array(good, bad, F.lit("{}"), F.lit("null"), F.lit("0.0"), F.lit('""'))).alias("value")
    )
    lines.write.option("compression", "none").text(f"{path}/lines.jsonl")
    spec = bl.sft_spec(path, SFT_MAX, field_names=("doc_id", "content"), loss_masked_field_names=(), file_format="jsonl")
    records = read_dataset(spark, spec, names=NameFilter(suffix="txt"))
    left = read_dataset(spark, spec)
    every = records.unionByName(left)  # nothing in the folder ends with jsonl
    return every.select(F.col("doc_id").cast("bigint").alias("doc_id"), "content")


def _numbered_lines(docs: DataFrame) -> DataFrame:
    """Documents as JSON lines of seven folders, in order over the tasks: a folder is written by as many as its size needs."""
    docs = docs.withColumn("part", F.expr(f"lpad(doc_id div {DOCS_PER_FILE} % 7, 3, '0')"))
    docs = docs.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id")
    return docs.select("part", F.to_json(F.struct(F.col("doc_id").cast("string").alias("prompt"), F.col("text").alias("chosen"))).alias("value"))


def source_numbered(spark, folder):
    """Several files of documents, numbered by file and line whatever the splits: the order is checked."""
    path = scratch_path(spark, "numbered")
    _numbered_lines(_table(spark, folder, "documents")).write.partitionBy("part").text(path)
    records = read_dataset(spark, bl.sft_spec(path, SFT_MAX, file_format="jsonl"), names=NameFilter(suffix="txt"), numbered=True)
    return records.select("seq_id", F.col("prompt").cast("bigint").alias("doc_id"), F.md5("chosen").alias("text"))


def sink_jsonl(spark, folder):
    path = scratch_path(spark, "jsonl")
    docs = _table(spark, folder, "documents")
    write_jsonl(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang"), path)
    records = read_strict_jsonl(spark, path, ["doc_id", "text", "lang"], NameFilter(prefix="part-"))
    return records.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")


def _bucketed(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return docs.withColumn("bucket", F.expr(f"doc_id div {DOCS_PER_FILE}"))


def source_json_array(spark, folder):
    """One JSON array per file, a few documents each."""
    path = scratch_path(spark, "json")
    record = F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"))
    files = _bucketed(spark, folder).groupBy("bucket").agg(F.to_json(F.collect_list(record)).alias("value"))
    files.write.partitionBy("bucket").text(path)
    records = read_json_arrays(spark, path, ["doc_id", "content"], NameFilter(suffix="txt"))
    return records.select(F.col("doc_id").cast("bigint").alias("doc_id"), "content")


def source_json_numbered(spark, folder):
    """JSON arrays of several documents, pretty-printed, cut in splits and numbered by file and place."""
    path = scratch_path(spark, "json")
    record = F.struct(F.col("doc_id").cast("string").alias("prompt"), F.col("text").alias("chosen"))
    rows = F.sort_array(F.collect_list(F.struct("doc_id", record.alias("record"))))
    files = _bucketed(spark, folder).groupBy("bucket").agg(F.to_json(F.transform(rows, lambda r: r["record"]), {"pretty": "true"}).alias("value"))
    files.write.partitionBy("bucket").text(path)
    spec = bl.sft_spec(path, SFT_MAX, file_format="json")
    records = read_dataset(spark, spec, names=NameFilter(suffix="txt"), numbered=True)
    return records.select("seq_id", F.col("prompt").cast("bigint").alias("doc_id"), F.md5("chosen").alias("text"))


def source_keyed_json(spark, folder):
    """One JSON object ``id -> record`` per file, made into pairs."""
    path = scratch_path(spark, "keyed")
    record = F.struct(F.col("lang").alias("source"), F.col("text").alias("rationale"), F.col("source").alias("target"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), record)))
    files = _bucketed(spark, folder).groupBy("bucket").agg(F.to_json(entries).alias("value"))
    files.write.partitionBy("bucket").text(path)
    records = read_keyed_json(spark, path, ["source", "rationale", "target"], NameFilter(contains=".txt"))
    pairs = bl.reasoning_pairs(records, keep=["record_id"])
    return pairs.select(F.col("record_id").cast("bigint").alias("doc_id"), "prompt", "chosen")


def _text_tree(spark: SparkSession, folder: str) -> str:
    """A folder of text files, a few documents each; a document ends with a Windows newline."""
    path = scratch_path(spark, "texts")
    texts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    value = F.concat(F.array_join(F.transform(texts, lambda t: t["text"]), "\r\n"), F.lit("\r"))
    files = _bucketed(spark, folder).groupBy("bucket").agg(value.alias("value"))
    files.write.partitionBy("bucket").text(path)
    return path


def _bucket_of(path: str) -> Column:
    return F.regexp_extract(path, r"bucket=([0-9]+)", 1).cast("bigint")


def source_whole_text(spark, folder):
    texts = read_texts(spark, _text_tree(spark, folder), NameFilter(suffix="txt"), with_path=True)
    return texts.select(_bucket_of("path").alias("bucket"), "content")


def source_file_listing(spark, folder):
    files = list_files(spark, _text_tree(spark, folder), NameFilter(regex=r"part-[0-9]+"))
    return files.select(_bucket_of("relative_path").alias("bucket"), F.col("name").endswith(".txt").alias("is_text"))


def mirror_tree(spark, folder):
    """Every file of a tree is copied with underlined spaces to the same place in another tree."""
    source, target = _text_tree(spark, folder), scratch_path(spark, "mirror")

    def underline(path: str, mirror_path: str) -> None:
        with open(path, encoding="utf-8", newline="") as src:
            text = src.read()
        with open(mirror_path, "w", encoding="utf-8", newline="") as dst:
            dst.write(text.replace(" ", "_"))

    done = process_to_mirror(spark, source, target, underline, NameFilter(suffix=".txt"))
    done.write.mode("overwrite").parquet(scratch_path(spark, "done"))
    copies = read_texts(spark, target, NameFilter(suffix=".txt"), with_path=True)
    return copies.select(
        _bucket_of("path").alias("bucket"), F.md5("content").alias("content")
    )


def mirror_bytes(spark, folder):
    """The same through Spark's file source and a sink that commits: no file is opened by a path."""
    source, target = _text_tree(spark, folder), scratch_path(spark, "mirror")
    mirror_files(spark, source, target, lambda place, content: content.replace(b" ", b"_"), NameFilter(suffix=".txt"))
    copies = read_texts(spark, target, NameFilter(suffix=".txt"), with_path=True)
    return copies.select(_bucket_of("path").alias("bucket"), F.md5("content").alias("content"))


def map_records(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")

    def longest_line(row: dict) -> dict:
        lines = row["text"].split("\n")
        return {"doc_id": row["doc_id"], "n_lines": len(lines), "longest": max(map(len, lines))}

    return bl.map_records(docs, longest_line, "doc_id bigint, n_lines bigint, longest bigint")


def merge_token_sets_query(spark, folder):
    """Two tokenized sets, written and read, under common ids."""
    tokenizer, spec = bl.CodepointTokenizer(), bl.pretrain_spec()
    bench = _table(spark, folder, "benchmark").select(
        F.col("item_id").alias("seq_id"), F.col("text").alias("content")
    )
    sets = []
    for name, records in (("documents", _documents(spark, folder)), ("benchmark", bench)):
        path = scratch_path(spark, name)
        write_token_set(bl.tokenize(records, spec, tokenizer), path)
        sets.append(read_token_set(spark, path))
    merged = merge_token_sets(*sets)
    return merged.select("seq_id", F.col("total_len").cast("bigint").alias("n_tokens"), _joined(F.col("content")).alias("ids"))


def merge_token_folder(spark, folder):
    """Three tokenized sets in one folder, read in one scan under common ids."""
    path, tokenizer, spec = scratch_path(spark, "sets"), bl.CodepointTokenizer(), bl.pretrain_spec()
    bench = _table(spark, folder, "benchmark").select(F.col("item_id").alias("seq_id"), F.col("text").alias("content"))
    sources = _documents(spark, folder, "source").select("seq_id", F.col("source").alias("content"))
    for name, records in (("a", _documents(spark, folder)), ("b", bench), ("c", sources)):
        write_token_set(bl.tokenize(records, spec, tokenizer), f"{path}/{name}.tokens.parquet")
    merged = read_token_folder(spark, path)
    return merged.select("seq_id", F.col("total_len").cast("bigint").alias("n_tokens"), _joined(F.col("content")).alias("ids"))


def sink_plan(spark, folder):
    """A plan written and read again."""
    path = scratch_path(spark, "plan")
    write_plan(bl.plan_capacity(_word_lengths(spark, folder), LIMIT, order="pc_desc"), path)
    plan = read_plan(spark, path)
    return _big(plan.batches.select("batch_id", "plan_pos", "n_records", "max_len", "padded_tokens"))


def sink_training_rows(spark, folder):
    """Pairs tokenized, planned, sharded over 4 ranks, padded, written by rank and read again."""
    token_path, path = scratch_path(spark, "tokens"), scratch_path(spark, "rows")
    write_token_set(_pair_tokens(spark, folder), token_path)
    tokens = read_token_set(spark, token_path)
    plan = bl.plan_fixed(lengths_of(tokens), BATCH)
    placed = place_rows(plan, shard_batches(plan.batches, 4, accumulation=2))
    rows = collate(
        tokens,
        plan,
        ["prompt", "chosen"],
        ["prompt"],
        placement=placed,
        partition_by=ARRANGED,
    )
    write_training_rows(rows, path)
    back = spark.read.parquet(path)
    return _big(
        back.select(
            "rank",
            "micro_step",
            "optimizer_step",
            "batch_id",
            "pos",
            _joined(F.col("input_ids")).alias("ids"),
            _joined(F.col("attention_mask").cast("array<int>")).alias("mask"),
            _joined(F.col("labels")).alias("labels"),
        )
    )


def sink_training_set(spark, folder):
    """A plan and its padded rows written as one version, read back and held against each other by batch."""
    path = scratch_path(spark, "set")
    tokens = _pair_tokens(spark, folder)
    plan = bl.plan_fixed(lengths_of(tokens), BATCH)
    placed = place_rows(plan, shard_batches(plan.batches, 4, accumulation=2))
    write_training_set(collate(tokens, plan, ["prompt", "chosen"], ["prompt"], placement=placed, partition_by=ARRANGED), plan, path)
    rows, stored = read_training_set(spark, path)
    sizes = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("input_ids")).cast("bigint").alias("width"))
    return stored.batches.select("batch_id", "plan_pos", "n_records", "padded_tokens").join(sizes, "batch_id")


def stream_tokens(spark, folder):
    """Documents as JSON lines, tokenized as a stream of a few files at a time, stopped and gone on with."""
    path = scratch_path(spark, "stream")
    docs = _table(spark, folder, "documents")
    value = F.to_json(F.struct(F.col("doc_id").cast("string").alias("prompt"), F.col("text").alias("chosen")))
    for part in (0, 1):
        lines = docs.where(F.col("doc_id") % 2 == part).select(value.alias("value"))
        lines.repartition(4).write.mode("append").text(f"{path}/in")
        query = stream_token_set(
            spark, bl.sft_spec(f"{path}/in", 1 << 30, file_format="jsonl"), bl.CodepointTokenizer(), f"{path}/out", f"{path}/checkpoint",
            NameFilter(suffix="txt"), files_at_once=3, until_done=True,
        )
        query.awaitTermination()
    tokens = spark.read.parquet(f"{path}/out")
    number = F.array_join(F.transform("prompt", lambda c: F.char(c)), "").cast("bigint")
    return tokens.select(number.alias("doc_id"), F.col("chosen_len").cast("bigint").alias("n_tokens"), _joined(F.col("chosen")).alias("ids"))


# ---- tokenization -----------------------------------------------------------------------------


def tokenize_codepoint(spark, folder):
    tokens = _document_tokens(spark, folder)
    return tokens.select(
        F.col("seq_id").alias("doc_id"),
        F.col("total_len").cast("bigint").alias("n_tokens"),
        _joined(F.col("content")).alias("ids"),
    )


def _vocabulary_query(max_shipped: int) -> Query:
    def query(spark, folder):
        docs = _documents(spark, folder)
        vocabulary = bl.build_vocabulary(docs, "content", 2000)
        tokenizer = bl.VocabularyTokenizer(vocabulary, max_shipped=max_shipped)
        tokens = bl.tokenize(docs, bl.pretrain_spec(), tokenizer)
        return tokens.select(
            F.col("seq_id").alias("doc_id"),
            F.col("total_len").cast("bigint").alias("n_tokens"),
            F.size(F.filter("content", lambda i: i == 0)).cast("bigint").alias("n_unknown"),
            _joined(F.col("content")).alias("ids"),
        )

    return query


def vocabulary(spark, folder):
    return _big(bl.build_vocabulary(_documents(spark, folder), "content", 2000))


def tokenize_user_object(spark, folder):
    """A tokenizer object made on the workers: UTF-8 bytes."""

    def factory():
        return lambda texts: [list(text.encode("utf-8")) for text in texts]

    tokens = bl.tokenize(_documents(spark, folder), bl.pretrain_spec(), bl.ObjectTokenizer(factory))
    return tokens.select(
        F.col("seq_id").alias("doc_id"),
        F.col("content_len").cast("bigint").alias("n_tokens"),
        _joined(F.col("content")).alias("ids"),
    )


def tokenize_special(spark, folder):
    """BOS and EOS around every field, within the limits of the fields."""
    tokenizer = bl.CodepointTokenizer(bl.SpecialTokens(bos_id=6, eos_id=2, pad_id=0))
    tokens = bl.tokenize(_pairs(spark, folder), bl.sft_spec(max_seq_len=SFT_MAX), tokenizer, add_special=True)
    return tokens.select(
        "seq_id",
        F.col("total_len").cast("bigint").alias("n_tokens"),
        _joined(F.col("prompt")).alias("prompt"),
        _joined(F.col("chosen")).alias("chosen"),
    )


def _truncate_query(side: str) -> Query:
    def query(spark, folder):
        tokenizer = bl.CodepointTokenizer()
        ids = truncate(tokenizer.encode(F.col("content")), 256, side)
        docs = _documents(spark, folder).select(F.col("seq_id").alias("doc_id"), ids.alias("kept"))
        return docs.select("doc_id", F.size("kept").cast("bigint").alias("n_tokens"), _joined(F.col("kept")).alias("ids"))

    return query


def budget_sft(spark, folder):
    tokens = _pair_tokens(spark, folder)
    return _big(
        tokens.select(
            "seq_id",
            "prompt_len",
            "chosen_len",
            "total_len",
            _joined(F.col("prompt")).alias("prompt"),
            _joined(F.col("chosen")).alias("chosen"),
        )
    )


def budget_pretrain(spark, folder):
    docs = _documents(spark, folder)
    spec = bl.pretrain_spec(max_seq_len=2048, field_truncation_sides=["right"])
    tokens = bl.tokenize(docs, spec, bl.CodepointTokenizer())
    return tokens.select(
        F.col("seq_id").alias("doc_id"),
        F.col("content_len").cast("bigint").alias("n_tokens"),
        _joined(F.col("content")).alias("ids"),
    )


def budget_inference(spark, folder):
    docs = _documents(spark, folder).withColumnRenamed("content", "question")
    tokens = bl.tokenize(docs, bl.inference_spec(), bl.CodepointTokenizer())
    return tokens.select(
        F.col("seq_id").alias("doc_id"),
        F.col("question_len").cast("bigint").alias("n_tokens"),
        _joined(F.col("question")).alias("ids"),
    )


def _exhausted_query(on_exhausted: str) -> Query:
    def query(spark, folder):
        spec = bl.DatasetSpec(
            field_names=["content", "source", "lang"],
            max_seq_len=256,
            field_max_lengths=[None, None, 2],
            field_truncation_sides=["left", "right", "right"],
        )
        docs = _documents(spark, folder, "source", "lang")
        tokens = bl.tokenize(docs, spec, bl.CodepointTokenizer(), on_exhausted)
        return _big(
            tokens.select(
                F.col("seq_id").alias("doc_id"), "content_len", "source_len", "lang_len", "total_len"
            )
        )

    return query


# ---- order and planning -----------------------------------------------------------------------


def smart_sort_rank(spark, folder):
    ranked = sort_by_length(_word_lengths(spark, folder), DOC_ID_BITS)
    return _big(ranked.select(F.col("seq_id").alias("doc_id"), "len", "rank"))


def _assigned(plan: BatchPlan, *more: str) -> DataFrame:
    return _big(plan.assignment.select(F.col("seq_id").alias("doc_id"), *more, "len", "batch_id", "pos"))


def plan_fixed(spark, folder):
    return _assigned(bl.plan_fixed(_word_lengths(spark, folder), BATCH, smart=False, id_bits=DOC_ID_BITS))


def plan_fixed_sorted(spark, folder):
    return _assigned(bl.plan_fixed(_word_lengths(spark, folder), BATCH, id_bits=DOC_ID_BITS))


def _capacity(spark, folder, order: str = "none") -> BatchPlan:
    return bl.plan_capacity(_word_lengths(spark, folder), LIMIT, order=order, seed=7, id_bits=DOC_ID_BITS)


def plan_token_capacity(spark, folder):
    return _assigned(_capacity(spark, folder))


def _pair_difference(spark, folder) -> BatchPlan:
    return bl.plan_difference(lengths_of(_pair_tokens(spark, folder), key="prompt"), 64, 8)


def plan_length_difference(spark, folder):
    plan = _pair_difference(spark, folder)
    return _big(plan.assignment.select("seq_id", "len", "batch_id", "pos"))


def plan_length_difference_documents(spark, folder):
    return _assigned(bl.plan_difference(_word_lengths(spark, folder), 16, 64, id_bits=DOC_ID_BITS))


def plan_max_length(spark, folder):
    return _assigned(bl.plan_max_length(_word_lengths(spark, folder), PIECE, BATCH, id_bits=DOC_ID_BITS), "chunk")


def plan_max_length_sorted(spark, folder):
    return _assigned(bl.plan_max_length(_word_lengths(spark, folder), PIECE, BATCH, smart=True, id_bits=DOC_ID_BITS), "chunk")


def plan_by_policy_name(spark, folder):
    """All four policies by name, their batches per policy."""
    knobs = dict(
        zip(
            POLICIES,
            (
                {"batch_size": BATCH},
                {"limit": LIMIT},
                {"max_token_diff": 16, "max_plan_size": 64},
                {"max_field_length": PIECE, "batch_size": BATCH},
            ),
        )
    )
    lengths = _word_lengths(spark, folder)
    out = None
    for policy in POLICIES:
        stats = measures.plan_stats(plan_by_name(lengths, policy, **knobs[policy]).batches)
        part = stats.select(F.lit(policy).alias("policy"), "plan_item_count")
        out = part if out is None else out.unionByName(part)
    return out


def _order_query(order: str) -> Query:
    def query(spark, folder):
        batches = _capacity(spark, folder, order).batches
        return _big(batches.select("batch_id", "plan_pos", "n_records", "padded_tokens"))

    return query


def plan_order_random(spark, folder):
    batches = _capacity(spark, folder, "random").batches
    return _big(batches.select("batch_id", "plan_pos", "n_records", "padded_tokens"))


# ---- probing ----------------------------------------------------------------------------------


def _probe_ranges(spark, folder, *by: str) -> DataFrame:
    """Token counts to probe: from the longest document of a corpus to three times as much."""
    docs = _documents(spark, folder, *by).select(*by, word_count(F.col("content")).alias("len"))
    longest = F.max("len").cast("bigint")
    return docs.groupBy(*by).agg(longest.alias("start"), (longest * 3).alias("end"))


def probe_grid(spark, folder):
    grid = probe.probe_grid(_probe_ranges(spark, folder, "source"), step=500)
    return probe.probe_summary(grid)


def probe_order(spark, folder):
    return probe.order_probes(probe.probe_grid(_probe_ranges(spark, folder), step=500))


def probe_rows(spark, folder):
    """The filler records, counted back per batch; random ids lie between 0 and 99."""
    rows = probe.probe_rows(probe.probe_grid(_probe_ranges(spark, folder), step=2000), seed=11)
    return rows.groupBy("target", "seq_len").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(F.size("profile_content")).cast("bigint").alias("n_tokens"),
        F.sum(F.size(F.filter("profile_content", lambda i: (i >= 0) & (i < 100)))).cast("bigint").alias("n_valid"),
    )


# ---- collation --------------------------------------------------------------------------------


def _collate_query(**options) -> Query:
    def query(spark, folder):
        tokens = _pair_tokens(spark, folder)
        plan = bl.plan_fixed(lengths_of(tokens), BATCH)
        rows = collate(tokens, plan, ["prompt", "chosen"], ["prompt"], **options)
        arrays = [c for c in ("input_ids", "attention_mask", "labels") if c in rows.columns]
        return _big(
            rows.select(
                "batch_id",
                "pos",
                "n_tokens",
                "pad_to",
                *(_joined(F.col(c).cast("array<int>")).alias(c) for c in arrays),
            )
        )

    return query


def collate_one_field(spark, folder):
    """The answers alone, padded to the longest answer of a batch planned over both fields."""
    tokens = _pair_tokens(spark, folder)
    plan = bl.plan_fixed(lengths_of(tokens), BATCH)
    rows = collate(tokens, plan, ["chosen"])
    return _big(
        rows.select("batch_id", "pos", "n_tokens", "pad_to", _joined(F.col("labels")).alias("labels"))
    )


def collate_split_records(spark, folder):
    """Documents cut at 512 code points, 8 pieces per batch; tokenized once, planned from the stored lengths."""
    path = scratch_path(spark, "tokens")
    write_token_set(_document_tokens(spark, folder), path)
    tokens = read_token_set(spark, path)
    plan = bl.plan_max_length(lengths_of(tokens, key="content"), 512, BATCH, key="content", id_bits=DOC_ID_BITS)
    rows = collate(tokens, plan, ["content"])
    return _big(
        rows.select(
            "batch_id",
            "pos",
            "n_tokens",
            "pad_to",
            _joined(F.col("input_ids")).alias("input_ids"),
            _joined(F.col("attention_mask").cast("array<int>")).alias("attention_mask"),
            _joined(F.col("labels")).alias("labels"),
        )
    )


def collate_matrices(spark, folder):
    tokens = _pair_tokens(spark, folder)
    plan = bl.plan_fixed(lengths_of(tokens), BATCH)
    batches = batch_matrices(collate(tokens, plan, ["prompt", "chosen"], ["prompt"]))
    return _big(
        batches.select(
            "batch_id",
            "part",
            "n_rows",
            "pad_to",
            _joined(F.flatten("input_ids")).alias("input_ids"),
            _joined(F.flatten("labels")).alias("labels"),
        )
    )


# ---- sharding ---------------------------------------------------------------------------------


def shard_ranks(spark, folder):
    shards = shard_batches(_capacity(spark, folder).batches, 7, accumulation=2)
    return _big(shards.select("batch_id", "rank", "micro_step", "optimizer_step"))


def shard_ranks_shuffled(spark, folder):
    shards = shard_batches(_capacity(spark, folder).batches, 7, shuffle=True, seed=3)
    return _big(shards.select("rank", "micro_step", "batch_id"))


def step_layout_query(spark, folder):
    accumulation = accumulation_steps(global_batch=64, batch_per_device=4, world_size=8)
    return step_layout(_capacity(spark, folder).batches, 8, accumulation, epochs=3)


def loss_weight(spark, folder):
    batches = with_loss_weight(_capacity(spark, folder).batches, 4)
    return batches.select("batch_id", "n_records", "loss_weight")


# ---- measures ---------------------------------------------------------------------------------


def token_total(spark, folder):
    lengths = _word_lengths(spark, folder)
    return measures.token_total(lengths, F.col("len"))


def dataset_profile(spark, folder):
    docs = _documents(spark, folder, "source").select("source", word_count(F.col("content")).alias("len"))
    return measures.dataset_profile(docs, "source")


def plan_stats_general(spark, folder):
    return measures.plan_stats(bl.plan_max_length(_word_lengths(spark, folder), PIECE, BATCH).batches)


def plan_stats_capacity(spark, folder):
    return measures.capacity_stats(_capacity(spark, folder).batches)


def plan_stats_length_diff(spark, folder):
    return measures.difference_stats(_pair_difference(spark, folder).batches)


def batch_measures(spark, folder):
    return measures.batch_measures(_capacity(spark, folder).batches)


def plan_preview(spark, folder):
    tokens = _pair_tokens(spark, folder)
    plan = bl.plan_fixed(lengths_of(tokens), BATCH)
    plan = replace(plan, batches=order_batches(plan.batches, "pc_desc"))
    rows = measures.preview(tokens, plan)
    text = lambda name: F.array_join(F.col(name).cast("array<string>"), ",").alias(name)
    return _big(rows.select("plan_pos", "batch_id", "pos", "field", "size", text("first_ids"), text("last_ids")))


def _plan_item_query(position: int) -> Query:
    def query(spark, folder):
        path = scratch_path(spark, "plan")
        write_plan(_capacity(spark, folder, "pc_desc"), path)
        rows = measures.plan_item(read_plan(spark, path), position)
        return _big(rows.select(F.col("seq_id").alias("doc_id"), "batch_id", "pos", "len"))

    return query


def padding_report(spark, folder):
    """Four plans over lengths that are counted and ranked once."""
    ranked = rank_lengths(_word_lengths(spark, folder), DOC_ID_BITS)
    report = measures.padding_summary(
        {
            "fixed": bl.plan_fixed(ranked.select("seq_id", "len"), BATCH, smart=False, id_bits=DOC_ID_BITS),
            "fixed sorted": bl.plan_fixed(ranked, BATCH),
            "capacity": bl.plan_capacity(ranked, LIMIT),
            "length difference": bl.plan_difference(ranked, 16, 64),
        }
    )
    return report


def padding_report_fixed_length(spark, folder):
    plan = bl.plan_fixed(_word_lengths(spark, folder), BATCH)
    return measures.padding_summary({"fixed length": plan}, pad_to=16384)


# ---- run metrics, on the events table read as a log ---------------------------------------------

STEPS_PER_EPOCH = 500
BASE_TFLOP = 0.036


def _step_log(spark, folder) -> DataFrame:
    events = _table(spark, folder, "events")
    step = F.expr("event_id div 8")
    log = events.select(
        "event_type",
        F.expr(f"(event_id div 8) div {STEPS_PER_EPOCH}").alias("epoch"),
        (step % STEPS_PER_EPOCH).alias("step"),
        (F.col("event_id") % 8).alias("rank"),
        (F.col("user_id") % 16 + 1).alias("batch_size"),
        F.length("props").alias("seq_len"),
        (F.col("value") / 10).alias("normalized_loss"),
        F.col("value").alias("step_time"),
        (F.col("value") + 20).alias("used"),
        (F.col("user_id") + 5).cast("double").alias("free"),
        F.col("event_id"),
    )
    rate = reports.throughput(BASE_TFLOP, F.col("batch_size"), F.col("seq_len"), F.col("step_time"))
    return log.withColumn("tflops", rate)


def step_metrics(spark, folder):
    out = reports.step_metrics(_step_log(spark, folder), batch_per_device=4)
    rounded = [F.round(c, 9).alias(c) for c in ("loss", "mean_time", "records_per_second", "mean_tflops")]
    return out.select("epoch", "step", "batch_size", *rounded)


def throughput(spark, folder):
    log = _step_log(spark, folder)
    again = reports.throughput(
        BASE_TFLOP, F.col("batch_size"), F.col("seq_len"), F.col("step_time"), recompute=True
    )
    return log.select("event_id", "tflops", again.alias("recomputed"))


def global_step(spark, folder):
    log = reports.with_global_step(_step_log(spark, folder), STEPS_PER_EPOCH)
    return log.select("event_id", "global_step")


def memory_utilisation(spark, folder):
    out = reports.memory_utilisation(_step_log(spark, folder), by="step")
    return out.select("step", F.round("used", 6).alias("used"), F.round("utilisation", 6).alias("utilisation"))


def _scalars(spark, folder) -> DataFrame:
    log = _step_log(spark, folder)
    steps = reports.step_metrics(log, batch_per_device=4)
    means = steps.select(
        F.expr(
            f"stack(2, '{reports.TFLOPS_TAG}', mean_tflops, '{reports.TIME_TAG}', mean_time) AS (tag, value)"
        )
    )
    devices = reports.device_scalars(log.withColumn("device", F.col("rank")), by="step")
    return means.unionByName(devices.select("tag", "value"))


def device_scalars(spark, folder):
    log = _step_log(spark, folder).withColumn("device", F.col("rank"))
    return (
        reports.device_scalars(log, by="step")
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    )


def run_summary(spark, folder):
    out = reports.run_summary(_scalars(spark, folder))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def probe_capacity(spark, folder):
    return reports.pick_capacity(reports.probe_log(_step_log(spark, folder)), 0.6)


def policy_comparison(spark, folder):
    log = _step_log(spark, folder).withColumnRenamed("event_type", "dataset")
    runs = log.groupBy("dataset", (F.col("event_id") % 2).alias("run")).agg(
        F.avg("tflops").alias("tflops"),
        (F.sum("used") / F.sum(F.col("used") + F.col("free"))).alias("memory_utilisation"),
        F.sum("step_time").alias("time"),
        F.avg("normalized_loss").alias("loss"),
    )
    base, other = (runs.where(F.col("run") == r).drop("run") for r in (0, 1))
    out = reports.compare_runs(base, other)
    return out.select("dataset", *(F.round(c, 6).alias(c) for c in out.columns if c != "dataset"))


QUERIES: dict[str, Query] = {
    "prep_conversation_pairs": prep_conversation_pairs,
    "prep_question_pairs": prep_question_pairs,
    "prep_instruction_pairs": prep_instruction_pairs,
    "prep_reasoning_pairs": prep_reasoning_pairs,
    "project_fields": project_fields,
    "source_jsonl": source_jsonl,
    "source_numbered": source_numbered,
    "source_json_array": source_json_array,
    "source_json_numbered": source_json_numbered,
    "source_keyed_json": source_keyed_json,
    "source_whole_text": source_whole_text,
    "source_file_listing": source_file_listing,
    "sink_jsonl": sink_jsonl,
    "sink_plan": sink_plan,
    "sink_training_rows": sink_training_rows,
    "sink_training_set": sink_training_set,
    "stream_tokens": stream_tokens,
    "mirror_tree": mirror_tree,
    "mirror_bytes": mirror_bytes,
    "map_records": map_records,
    "merge_token_sets": merge_token_sets_query,
    "merge_token_folder": merge_token_folder,
    "tokenize_codepoint": tokenize_codepoint,
    "vocabulary": vocabulary,
    "tokenize_vocabulary": _vocabulary_query(500_000),
    "tokenize_vocabulary_joined": _vocabulary_query(100),
    "tokenize_user_object": tokenize_user_object,
    "tokenize_special": tokenize_special,
    "truncate_left": _truncate_query("left"),
    "truncate_right": _truncate_query("right"),
    "budget_sft": budget_sft,
    "budget_pretrain": budget_pretrain,
    "budget_inference": budget_inference,
    "budget_exhausted_keep": _exhausted_query("keep"),
    "budget_exhausted_empty": _exhausted_query("empty"),
    "smart_sort_rank": smart_sort_rank,
    "plan_fixed": plan_fixed,
    "plan_fixed_sorted": plan_fixed_sorted,
    "plan_token_capacity": plan_token_capacity,
    "plan_length_difference": plan_length_difference,
    "plan_length_difference_documents": plan_length_difference_documents,
    "plan_max_length": plan_max_length,
    "plan_max_length_sorted": plan_max_length_sorted,
    "plan_by_policy_name": plan_by_policy_name,
    "plan_order_none": _order_query("none"),
    "plan_order_bs_asc": _order_query("bs_asc"),
    "plan_order_bs_desc": _order_query("bs_desc"),
    "plan_order_pc_asc": _order_query("pc_asc"),
    "plan_order_pc_desc": _order_query("pc_desc"),
    "plan_order_rc_asc": _order_query("rc_asc"),
    "plan_order_rc_desc": _order_query("rc_desc"),
    "plan_order_random": plan_order_random,
    "probe_grid": probe_grid,
    "probe_order": probe_order,
    "probe_rows": probe_rows,
    "collate_right": _collate_query(),
    "collate_left": _collate_query(padding_side="left"),
    "collate_no_labels": _collate_query(with_labels=False),
    "collate_fixed_length": _collate_query(pad_to=1024),
    "collate_one_field": collate_one_field,
    "collate_split_records": collate_split_records,
    "collate_matrices": collate_matrices,
    "shard_ranks": shard_ranks,
    "shard_ranks_shuffled": shard_ranks_shuffled,
    "step_layout": step_layout_query,
    "loss_weight": loss_weight,
    "token_total": token_total,
    "dataset_profile": dataset_profile,
    "plan_stats_general": plan_stats_general,
    "plan_stats_capacity": plan_stats_capacity,
    "plan_stats_length_diff": plan_stats_length_diff,
    "batch_measures": batch_measures,
    "plan_preview": plan_preview,
    "plan_item_first": _plan_item_query(0),
    "plan_item_last": _plan_item_query(-1),
    "padding_report": padding_report,
    "padding_report_fixed_length": padding_report_fixed_length,
    "step_metrics": step_metrics,
    "throughput": throughput,
    "global_step": global_step,
    "memory_utilisation": memory_utilisation,
    "device_scalars": device_scalars,
    "run_summary": run_summary,
    "probe_capacity": probe_capacity,
    "policy_comparison": policy_comparison,
}
