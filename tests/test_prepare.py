import pytest
from pyspark.sql import functions as F

import batchloom as bl


def turn(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def conversations(spark, *conversations):
    rows = [(c, t, r, f"{r}{t}") for c, roles in enumerate(conversations) for t, r in enumerate(roles)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)


def pairs(spark, *roles, **options):
    nested = bl.nest_turns(conversations(spark, *roles))
    out = bl.conversation_pairs(nested, **options).orderBy("conv_id", "turn")
    return [(r["conv_id"], r["turn"], r["prompt"], r["chosen"]) for r in out.collect()]


def test_every_answer_gets_all_turns_before_it(spark):
    u0, a1, u2, a3 = turn("u", "u0"), turn("a", "a1"), turn("u", "u2"), turn("a", "a3")
    assert pairs(spark, "uaua") == [(0, 1, u0, a1), (0, 3, u0 + a1 + u2, a3)]


def test_answers_go_by_position_not_by_role(spark):
    assert pairs(spark, "sua") == [(0, 1, turn("s", "s0"), turn("u", "u1"))]


def test_short_conversations_give_nothing(spark):
    assert pairs(spark, "u", "ua")[0][0] == 1
    assert len(pairs(spark, "u", "ua")) == 1


@pytest.mark.parametrize("spread", [1, 2, 3, 4, 7])
def test_long_conversations_are_spread_without_change(spark, spread):
    shapes = ["ua" * 11, "ua" * 5 + "u", "ua", "u", "sua"]
    assert pairs(spark, *shapes, spread_turns=spread) == pairs(spark, *shapes)


def test_a_hot_conversation(spark):
    rows = pairs(spark, "ua" * 700, *["ua"] * 40)
    assert len(rows) == 740
    hot = [r for r in rows if r[0] == 0]
    assert [r[1] for r in hot] == list(range(1, 1400, 2))
    whole = "".join(turn("ua"[t % 2], f"{'ua'[t % 2]}{t}") for t in range(1400))
    assert hot[-1][2] + hot[-1][3] == whole


def test_a_conversation_that_most_rows_repeat(spark):
    """Equal conversations are not gathered: short ones stay where they are, ranges of long ones are dealt evenly."""
    messages = [("u" if t % 2 == 0 else "a", f"text {t}") for t in range(6)]
    df = spark.createDataFrame([(i, messages) for i in range(400)], "conv_id int, messages array<struct<role: string, content: string>>").repartition(8)
    for spread in (512, 2):
        out = bl.conversation_pairs(df, spread_turns=spread)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 1200 and max(sizes) <= 1200 // 4
        assert out.distinct().count() == 1200
    plan = bl.conversation_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    # Only what was cut is shuffled, by turns and not by a hash of the text.
    assert "xxhash64" not in plan and "RepartitionByExpression" not in plan and plan.count("Repartition 8, true") == 3


def test_pairs_of_tables(spark):
    df = spark.createDataFrame([("s", "r", "t")], "source string, rationale string, target string")
    assert tuple(bl.reasoning_pairs(df).first()) == (turn("user", "s"), turn("assistant", "rt"))
    df = spark.createDataFrame([("q", "a")], "question string, answer string")
    assert tuple(bl.question_pairs(df).first()) == (turn("user", "q"), turn("assistant", "a"))
    df = spark.createDataFrame([("i", "c", "r")], "instruction string, context string, response string")
    assert tuple(bl.instruction_pairs(df).first()) == (turn("user", "ic"), turn("assistant", "r"))


def test_missing_parts_abort(spark):
    nested = bl.nest_turns(conversations(spark, "ua")).selectExpr(
        "transform(messages, m -> struct(m.role, if(m.role = 'u', m.content, null) AS content)) AS messages"
    )
    with pytest.raises(Exception, match="content is missing"):
        bl.conversation_pairs(nested).collect()
    df = spark.createDataFrame([("q", None)], "question string, answer string")
    with pytest.raises(Exception, match="answer is missing"):
        bl.question_pairs(df).collect()
    df = spark.createDataFrame([(1, "p", None)], "seq_id bigint, prompt string, chosen string")
    with pytest.raises(Exception, match="chosen is missing"):
        bl.project_fields(df, ["prompt", "chosen"]).collect()
    with pytest.raises(ValueError, match="not in the data"):
        bl.project_fields(df, ["content"])
    assert bl.project_fields(df, ["prompt"]).columns == ["seq_id", "prompt"]
