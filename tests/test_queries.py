"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", entry.QUERIES)
def test_query(spark, tables, name):
    assert compare(spark, tables, name, entry.QUERIES[name], entry.ORACLE.get(name), FOLDER) == ""


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLE) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_numbered_files_are_written_by_any_number_of_tasks(spark, tables, monkeypatch, tmp_path, shuffle_partitions):
    """Folders are cut: no task writes a fixed share of the documents, and the numbers are the same."""
    path = str(tmp_path / "numbered")
    monkeypatch.setattr("workload.queries.scratch_path", lambda *_: path)
    shuffle_partitions(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        name = "source_numbered"
        assert compare(spark, tables, name, entry.QUERIES[name], entry.ORACLE[name], FOLDER) == ""
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = spark.read.text(path)
    task = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1)
    by_task = [r["count"] for r in lines.groupBy(task).count().collect()]
    assert max(by_task) <= sum(by_task) / 4 and len(by_task) > 8
