import json

import pytest

import batchloom as bl
from batchloom.operators.lengths import lengths_of
from batchloom.sinks import commit, filetree
from batchloom.sinks import writers as W
from batchloom.sinks.mirror import process_to_mirror
from batchloom.sources.files import NameFilter


def test_jsonl_keeps_characters(spark, tmp_path):
    df = spark.createDataFrame([("中\n", "é")], "prompt string, chosen string")
    W.write_jsonl(df, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "中" in text and json.loads(text) == {"prompt": "中\n", "chosen": "é"}


def test_planning_reads_lengths_only(spark, tmp_path):
    rows = [(i, [1] * (i % 5), [2]) for i in range(50)]
    df = spark.createDataFrame(rows, "seq_id bigint, prompt array<int>, chosen array<int>")
    W.write_token_set(df, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = bl.plan_capacity(lengths_of(stored), 20)
    text = plan.assignment._jdf.queryExecution().executedPlan().toString()
    assert "total_len" in text and "array<int>" not in text
    assert plan.batches.agg({"tokens": "sum"}).first()[0] == sum(i % 5 + 1 for i in range(50))


def test_a_bucketed_set_is_not_shuffled_to_its_plan(spark, tmp_path):
    rows = [(i, list(range(i % 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "seq_id bigint, content array<int>")
    W.write_token_set(df, str(tmp_path / "t"), table="bucketed_tokens", buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = spark.table("bucketed_tokens")
        plan = bl.plan_fixed(lengths_of(stored), 4)
        rows = bl.collate(stored, plan)
        text = rows._jdf.queryExecution().executedPlan().toString()
        wide = next(i for i, line in enumerate(text.splitlines()) if "content:array<int>" in line)
        above = text.splitlines()[wide - 3 : wide]
        assert "Sort [seq_id" in above[0] and not any("Exchange" in line for line in above)
        assert rows.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("DROP TABLE bucketed_tokens")


def test_plan_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 9) for i in range(60)], "seq_id bigint, len int")
    plan = bl.plan_capacity(df, 20, order="pc_desc")
    W.write_plan(plan, str(tmp_path / "p"))
    stored = W.read_plan(spark, str(tmp_path / "p"))
    assert (stored.policy, stored.knobs) == (plan.policy, plan.knobs)
    for part in ("assignment", "batches"):
        a, b = getattr(plan, part), getattr(stored, part)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_an_empty_plan_comes_back(spark, tmp_path):
    df = spark.createDataFrame([], "seq_id bigint, content array<int>")
    W.write_plan(bl.plan_fixed(lengths_of(df), 4), str(tmp_path / "plan"))
    stored = W.read_plan(spark, str(tmp_path / "plan"))
    assert stored.policy == "FixedBatchSize" and stored.knobs["batch_size"] == 4 and stored.batches.count() == 0


def test_plan_names():
    assert (
        W.plan_path("/d/chat.tokens.parquet", "FixedBatchSize", {"smart": True, "batch_size": 4, "key": None})
        == "/d/chat.FixedBatchSize.batch_size=4.smart=True.plan"
    )


def test_training_rows_by_rank(spark, tmp_path):
    rows = [(i, list(range(1, 2 + i % 6))) for i in range(41)]
    df = spark.createDataFrame(rows, "seq_id bigint, content array<int>")
    plan = bl.plan_fixed(lengths_of(df), 4)
    placed = bl.place_rows(plan, bl.shard_batches(plan.batches, 3))
    out = bl.collate(df, plan, placement=placed, partition_by=W.ARRANGED)
    W.write_training_rows(out, str(tmp_path / "rows"))
    back = spark.read.parquet(str(tmp_path / "rows"))
    # 11 batches on 3 ranks: the first one is delivered twice.
    assert back.count() == 41 + 4
    assert back.select("rank", "micro_step").distinct().count() == 12
    for rank in range(3):
        files = sorted((tmp_path / "rows" / f"rank={rank}").glob("*.parquet"))
        for file in files:
            steps = [tuple(r) for r in spark.read.parquet(str(file)).select("micro_step", "pos").collect()]
            assert steps == sorted(steps)


def test_mirror(spark, tmp_path):
    for name in ("a.txt", "d/b.txt", "d/e/c.txt", "d/skip.md"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)

    def shout(source, target):
        with open(source) as src, open(target, "w") as dst:
            dst.write(src.read().upper())

    done = process_to_mirror(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), shout, NameFilter(suffix=".txt")
    )
    assert sorted(r["relative_path"] for r in done.collect()) == ["a.txt", "d/b.txt", "d/e/c.txt"]
    assert (tmp_path / "out/d/e/c.txt").read_text() == "D/E/C.TXT"
    assert not (tmp_path / "out/d/skip.md").exists()


def stored_plan(spark, path, n=4000, mode="errorifexists", order="pc_desc"):
    df = spark.range(n).selectExpr("id AS seq_id", "cast(1 + id % 37 AS int) AS len")
    plan = bl.plan_capacity(df, 60, order=order)
    W.write_plan(plan, str(path), mode)
    return plan, W.read_plan(spark, str(path))


@pytest.mark.parametrize("n", [4000, 16000])
def test_an_item_is_read_from_few_files(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(W, "ROWS_PER_FILE", 200)
    plan, stored = stored_plan(spark, tmp_path / "p", n)
    assert len(stored.assignment.inputFiles()) >= n // 400
    count = plan.batches.count()
    everything = plan.assignment.join(plan.batches.select("batch_id", "plan_pos"), "batch_id").collect()
    for position in (0, 1, count // 2, count - 1, -1, -count):
        item = stored.item(position)
        assert len(item.inputFiles()) <= 2
        want = sorted(tuple(r) for r in everything if r["plan_pos"] == position % count)
        assert sorted(map(tuple, item.collect())) == want and want
        assert item.columns == plan.item(position).columns
    assert stored.item(count).collect() == [] and stored.item(-count - 1).collect() == []
    # The order of delivery changes, the files don't know it.
    assert sorted(map(tuple, stored.ordered("none").item(0).collect())) == sorted(map(tuple, plan.ordered("none").item(0).collect()))


def test_a_batch_larger_than_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ROWS_PER_FILE", 100)
    df = spark.range(1000).selectExpr("id AS seq_id", "0 AS len")
    W.write_plan(bl.plan_capacity(df, 60), str(tmp_path / "p"))
    item = W.read_plan(spark, str(tmp_path / "p")).item(0)
    assert item.count() == 1000 and len(item.inputFiles()) >= 8


def test_batches_come_in_plan_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ROWS_PER_FILE", 500)
    _, stored = stored_plan(spark, tmp_path / "p")
    ranges = stored.manifest.read(spark, "batches_files").orderBy("first").collect()
    assert all(a["last"] < b["first"] for a, b in zip(ranges, ranges[1:])) and sum(r["rows"] for r in ranges) == stored.batches.count()
    for r in ranges:
        rows = spark.read.parquet(f"{stored.manifest.part_path('batches')}/{r['file']}").collect()
        assert [x["plan_pos"] for x in rows] == list(range(r["first"], r["last"] + 1))


def test_interrupted_writes_are_refused(spark, tmp_path):
    path = str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        W.read_plan(spark, path)
    writer = commit.VersionWriter(spark, path)
    writer.write("assignment", spark.range(5).toDF("seq_id"))
    with pytest.raises(ValueError, match="interrupted.*assignment-"):
        W.read_plan(spark, path)
    plan, stored = stored_plan(spark, path)  # a repeated write succeeds, and clears what was left
    assert stored.manifest.version == 1 and stored.assignment.count() == 4000
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "p").iterdir()) == ["_manifests", "assignment", "assignment_files", "batches", "batches_files"]
    # A later one that ends early leaves the version as it is; so does a manifest that was cut off.
    later = commit.VersionWriter(spark, path, "overwrite")
    later.write("assignment", spark.range(7).toDF("seq_id"))
    (tmp_path / "p" / "_manifests" / "000002.json").write_text('{"parts": {"assi')
    assert W.read_plan(spark, path).assignment.count() == 4000
    with pytest.raises(FileExistsError, match="version 1"):
        W.write_plan(plan, path)
    _, newer = stored_plan(spark, path, 500, "overwrite")
    assert newer.manifest.version == 3 and newer.assignment.count() == 500
    assert len(list((tmp_path / "p").iterdir())) == 5 and [p.name for p in (tmp_path / "p" / "_manifests").glob("*.json")] == ["000003.json"]
    victim = next(p for p in (tmp_path / "p").glob("batches-*/*.parquet"))
    victim.unlink()
    with pytest.raises(ValueError, match="batches has"):
        W.read_plan(spark, path)


def test_plan_and_rows_in_one_version(spark, tmp_path):
    df = spark.createDataFrame([(i, list(range(1, 2 + i % 6))) for i in range(41)], "seq_id bigint, content array<int>")
    plan = bl.plan_fixed(lengths_of(df), 4)
    placed = bl.place_rows(plan, bl.shard_batches(plan.batches, 3))
    rows = bl.collate(df, plan, placement=placed, partition_by=W.ARRANGED)
    W.write_training_set(rows, plan, str(tmp_path / "set"))
    back, stored = W.read_training_set(spark, str(tmp_path / "set"))
    assert back.count() == 45 and stored.batches.count() == 11 and stored.manifest.parts["rows"].rows == 45
    assert back.select("rank").distinct().count() == 3


def tree_of(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_mirror_without_mounts(spark, tmp_path):
    """Bytes come from Spark and go through the sink; the function opens nothing, and the root is a URI."""
    want = {}
    for name in ("a.txt", "d/b.txt", "d/e/ü c.txt", "d/skip.md", "d/none.txt"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode() + bytes(range(256)) * 9)
        if name.endswith(".txt") and "none" not in name:
            want[name] = path.read_bytes()[::-1]
    (tmp_path / "in" / "empty.txt").write_bytes(b"")  # Spark does not list it
    turn = lambda place, content: None if "none" in place else content[::-1]
    filetree.mirror_files(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", turn, NameFilter(suffix=".txt"))
    assert tree_of(tmp_path / "out") == want
    filetree.mirror_files(spark, f"file:{tmp_path}/in", str(tmp_path / "out"), turn, NameFilter(regex=".*txt$"))  # again
    assert tree_of(tmp_path / "out") == want


def test_a_failed_mirror_leaves_nothing(spark, tmp_path):
    for i in range(20):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text(str(i))

    def fail(place, content):
        if place == "7.txt":
            raise RuntimeError("lost")
        return content

    with pytest.raises(Exception, match="lost"):
        filetree.mirror_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), fail)
    # Tasks that end after the abort may have staged something; nothing is in its place, nor read.
    assert all(place.startswith("_staging-") for place in tree_of(tmp_path / "out"))
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).where("path NOT LIKE '%/in/%'").count() == 0


def test_a_repeated_task_leaves_one_copy(tmp_path):
    import pyarrow as pa

    def batches(tag):
        yield pa.RecordBatch.from_pydict({"relative_path": ["x/a", "b"], "content": [tag, b"2"]})
        yield pa.RecordBatch.from_pydict({"relative_path": ["x/c"], "content": pa.array([None], pa.binary())})

    writer = filetree.FileTreeWriter(f"file://{tmp_path}/out")
    writer.write(batches(b"first try"))
    second, empty = writer.write(batches(b"second")), writer.write(iter([]))
    assert tree_of(tmp_path / "out") and not (tmp_path / "out" / "b").exists()
    writer.commit([second, empty, None])
    assert tree_of(tmp_path / "out") == {"x/a": b"second", "b": b"2", "x/c": b""}
    for bad in ("../up", "/abs", "", None, "."):
        with pytest.raises(ValueError, match="no place"):
            writer.write(iter([pa.RecordBatch.from_pydict({"relative_path": pa.array([bad], pa.string()), "content": [b""]})]))
    writer.abort([])
    assert tree_of(tmp_path / "out") == {"x/a": b"second", "b": b"2", "x/c": b""}
