"""Tokenizing as a stream: every record once, over stops, restarts and repeated batches."""

import json

import pytest

import batchloom as bl
from batchloom.sources.files import NameFilter
from batchloom.streaming import tokens as S


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def put(place, name, records):
    (place / "in" / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


def record(i):
    return {"prompt": f"p{i}", "chosen": f"answer {i}"}


def run(spark, place, **options):
    spec = bl.sft_spec(str(place / "in"), file_format="jsonl")
    query = S.stream_token_set(spark, spec, bl.CodepointTokenizer(), str(place / "out"), str(place / "check"), until_done=True, **options)
    query.awaitTermination()
    assert query.exception() is None


def found(spark, place):
    rows = spark.read.parquet(str(place / "out")).collect()
    assert len({r["seq_id"] for r in rows}) == len(rows)
    return sorted("".join(map(chr, r["chosen"])) for r in rows), {r["seq_id"] >> S.ROW_BITS == r["batch"] for r in rows}


def answers(ids):
    return sorted(f"answer {i}" for i in ids)


def test_stop_and_restart(spark, place):
    put(place, "a.jsonl", [record(0), "no json", "{}", record(1)])
    put(place, "b.jsonl", [record(i) for i in range(2, 40)])
    put(place, "c.txt", [record(99)])
    run(spark, place, files_at_once=1)
    assert found(spark, place) == (answers(range(40)), {True})
    put(place, "d.jsonl", [record(i) for i in range(40, 60)])
    run(spark, place)
    assert found(spark, place) == (answers(range(60)), {True})
    run(spark, place)  # nothing new
    assert found(spark, place) == (answers(range(60)), {True})


def test_a_repeated_batch_replaces_what_it_left(spark, place):
    """The job ends after a batch was written and before that was noted down: the batch comes again."""
    put(place, "a.jsonl", [record(i) for i in range(10)])
    run(spark, place)
    put(place, "b.jsonl", [record(i) for i in range(10, 25)])
    run(spark, place)
    before = {r["seq_id"]: r["chosen"] for r in spark.read.parquet(str(place / "out")).collect()}
    commits = place / "check" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for p in commits.glob(f"*{last}*"):
        p.unlink()
    run(spark, place)
    assert found(spark, place) == (answers(range(25)), {True})
    assert {r["seq_id"]: r["chosen"] for r in spark.read.parquet(str(place / "out")).collect()} == before


def test_a_failure_within_a_batch(spark, place, monkeypatch):
    put(place, "a.jsonl", [record(i) for i in range(10)])
    real = S.write_token_set

    def broken(tokens, path, mode):
        real(tokens.limit(3), path, mode)
        raise RuntimeError("lost")

    monkeypatch.setattr(S, "write_token_set", broken)
    with pytest.raises(Exception, match="lost"):
        run(spark, place)
    monkeypatch.setattr(S, "write_token_set", real)
    run(spark, place)
    assert found(spark, place) == (answers(range(10)), {True})


def test_the_set_is_planned_like_any_other(spark, place):
    from batchloom.operators.lengths import lengths_of

    put(place, "a.jsonl", [record(i) for i in range(30)])
    run(spark, place)
    plan = bl.plan_capacity(lengths_of(spark.read.parquet(str(place / "out")).drop("batch")), 400)
    assert plan.assignment.count() == 30


def test_what_a_stream_cannot_read(spark, place):
    with pytest.raises(ValueError, match="JSON lines"):
        S.stream_token_set(spark, bl.pretrain_spec(str(place)), bl.CodepointTokenizer(), "x", "y")
    with pytest.raises(ValueError, match="suffix"):
        S.stream_lines(spark, str(place), NameFilter(regex="a"))
