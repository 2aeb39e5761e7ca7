import base64
import hashlib
import re

import pytest

from batchloom.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages():
    html = [None, "", "<p>é😀</p>", "same", "same", "x" * 3000, "a\r\n\r\nb", "WARC/1.1\r\n", f"<pre>{FAKE}</pre>", FAKE, FAKE * 3 + "WARC/1.1\r\nContent-Length: 99999\r\n\r\n", "\r\n\r\n", "same", "tail\r\n", "WARC/1.1\r\nContent-Length: x\r\n\r\n"]
    return [(i * 3 - 6, f"http://a/{i}" if i % 4 else None, h, "x") for i, h in enumerate(html)]


def expected(rows, least=0):
    first = {}
    for page, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= least:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = first.get(data, page) != page
        out.append((page, "revisit" if again else "response", len(data), digest, first[data] if again else None))
    return sorted(out)


@pytest.mark.parametrize("split,files,least,compression", [("128m", 1, 0, "gzip"), ("700", 2, 5, "none")])
def test_round_trip(spark, tmp_path, split, files, least, compression):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").coalesce(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        path = str(tmp_path / "a")
        warc.write_archives(df.repartition(files), "page_id", "url", "html", path, least, compression, 6)
        got = sorted(tuple(r) for r in warc.read_archives(spark, path).collect())
        assert got == expected(rows, least)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_foreign_archive(spark, tmp_path):
    """One file of many records, read in small splits, with a broken tail."""
    body = "".join(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(p)}\r\n\r\n{p}\r\n\r\n" for i, p in enumerate(["ab", FAKE, "", "c" * 700] * 12))
    (tmp_path / "x.warc").write_text(body + "WARC/1.1\r\nContent-Length: 50\r\n\r\ncut off", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = warc.read_archives(spark, str(tmp_path / "x.warc")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.page_id for r in rows) == list(range(48))
    assert [r.payload_bytes for r in sorted(rows, key=lambda r: r.page_id)][:4] == [2, len(FAKE), 0, 700]


def test_empty_and_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "y"), (2, "u", "x")], "page_id long, url string, html string")
    warc.write_archives(df, "page_id", "url", "html", str(tmp_path / "a"))
    rows = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.read_archives(spark, str(tmp_path / "a")).collect())
    assert rows == [(1, "response", 0), (1, "response", 0), (2, "revisit", 1)]
    warc.write_archives(df.limit(0), "page_id", "url", "html", str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_mandatory_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "x"), (2, None, "x")], "page_id long, url string, html string")
    for name, written in (("a", "2024-01-31T00:00:00Z"), ("b", None)):
        warc.write_archives(df, "page_id", "url", "html", str(tmp_path / name), compression="none", written=written)
        text = "".join(p.read_bytes().decode() for p in (tmp_path / name).glob("part-*"))
        records = [dict(line.split(": ", 1) for line in r.split("\r\n\r\n")[0].split("\r\n") if line) for r in text.split(warc.MAGIC)[1:]]
        by = {r["WARC-Type"]: r for r in records}
        for r in records:
            assert {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length"} <= set(r)
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r["WARC-Date"]) and (written is None or r["WARC-Date"] == written)
        assert by["revisit"]["WARC-Profile"].endswith("revisit/identical-payload-digest") and by["revisit"]["WARC-Refers-To"] == "<urn:page:1>"
