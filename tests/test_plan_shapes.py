"""What must hold for the physical plans at any scale."""

import re

import batchloom as bl
from batchloom.operators.lengths import lengths_of
from batchloom.sinks.writers import write_token_set


def executed(df) -> str:
    """The plan without adaptive execution, where reuse is visible before a run."""
    return df._jdf.queryExecution().executedPlan().toString()


def stored_tokens(spark, tmp_path, n=2000):
    rows = spark.range(n).selectExpr("id AS seq_id", "array_repeat(1, cast(id % 50 AS int)) AS content")
    path = str(tmp_path / "tokens")
    write_token_set(rows, path)
    return spark.read.parquet(path)


def static(spark):
    """Adaptive execution and automatic broadcasts off: the plan a large input gets."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def dynamic(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_input_is_read_once(spark, tmp_path):
    tokens = stored_tokens(spark, tmp_path)
    static(spark)
    try:
        for plan in (
            bl.plan_capacity(lengths_of(tokens), 100),
            bl.plan_difference(lengths_of(tokens, key="content"), 4, 16),
            bl.plan_fixed(lengths_of(tokens), 16),
            bl.plan_fixed(lengths_of(tokens), 16, smart=False),
            bl.plan_max_length(lengths_of(tokens, key="content"), 7, 16),
        ):
            text = executed(plan.batches)
            assert text.count("FileScan") == 1, plan.policy
            assert "ReusedExchange" in text
        ordered = executed(bl.plan_capacity(lengths_of(tokens), 100, order="pc_desc").batches)
        assert ordered.count("FileScan") == 1
    finally:
        dynamic(spark)


def test_records_are_never_in_one_partition(spark, tmp_path):
    """Single partitions hold the length table, the class table or super-block totals only."""
    tokens = stored_tokens(spark, tmp_path)
    static(spark)
    try:
        text = executed(bl.plan_capacity(lengths_of(tokens), 100).assignment)
    finally:
        dynamic(spark)
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line or "RoundRobin" in line:
            assert "HashAggregate" in lines[i + 1] or "HashAggregate" in lines[i + 2], lines[i : i + 3]
    # The one broadcast has a row per capacity class; records meet block offsets in a sort-merge join.
    assert len(re.findall(r"BroadcastExchange", text)) == 1
    assert "SortMergeJoin" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_python_runs_in_the_fold_only(spark, tmp_path):
    tokens = stored_tokens(spark, tmp_path)
    for plan, calls in (
        (bl.plan_capacity(lengths_of(tokens), 100), 1),
        (bl.plan_fixed(lengths_of(tokens), 16), 0),
    ):
        text = executed(plan.assignment)
        assert len(re.findall(r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython", text)) == calls


def test_token_arrays_move_once(spark, tmp_path):
    """Collation shuffles integers to find the widths, and the arrays in one exchange."""
    tokens = stored_tokens(spark, tmp_path)
    static(spark)
    try:
        plan = bl.plan_fixed(lengths_of(tokens), 16)
        text = executed(bl.collate(tokens, plan))
    finally:
        dynamic(spark)
    assert len(re.findall(r"ReadSchema: struct<[^>]*content:array<int>", text)) == 1
    wide = [
        line for i, line in enumerate(text.splitlines()[:-1])
        if "Exchange hashpartitioning(seq_id" in line and "content" in "".join(text.splitlines()[i + 1 : i + 4])
    ]
    assert len(wide) == 1


def test_row_local_steps_accept_streams(spark, tmp_path):
    """Reading, pairing by columns and tokenizing do not need a bounded input."""
    from batchloom.sources.records import parse_json_lines

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"question":"q","answer":"a"}\nbad\n')
    lines = spark.readStream.format("text").load(str(folder))
    pairs = bl.question_pairs(parse_json_lines(lines, ["question", "answer"]))
    tokens = bl.tokenize(pairs.selectExpr("0L AS seq_id", "*"), bl.sft_spec(), bl.CodepointTokenizer())
    query = tokens.writeStream.format("memory").queryName("streamed").start()
    try:
        query.processAllAvailable()
        rows = spark.sql("SELECT prompt_len, chosen_len FROM streamed").collect()
    finally:
        query.stop()
    assert [tuple(r) for r in rows] == [(len("<|im_start|>user\nq<|im_end|>\n"), len("<|im_start|>assistant\na<|im_end|>\n"))]
