"""WARC archives: written with revisit records, read back by a verified chain of record boundaries.

Writing goes through Spark's text sink with the separator that ends a record, reading through its text
source with the line that begins one, so both work on any file system that Spark reaches and files are
read in splits. A split knows nothing of its neighbours, and a payload may hold the line that begins a
record. So every piece after such a line is only a *candidate*: a task emits where the candidate stands in
its split and, from its Content-Length, where its successor would be. Sums over splits give offsets in the
file. The true records are those that the chain from the start of the file reaches; pointer jumping finds
them in as many rounds as the logarithm of the links. Runs of candidates that follow each other without a
gap are one link, so the rounds work on a few rows for each split.

A record whose payload holds the magic line is put together from its pieces, and only such pieces keep
their text. Null payloads count as empty. Candidates without a valid length end their chain. Files that
hold nothing give no rows. Pages without an id are not archived. Records of other archives whose ids are no
``urn:page:`` have a null page_id.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.session import materialize

# Fixed values of the format: the first line of a record, line ends, and the end of a record.
MAGIC, LINE, END = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
PROFILE = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = re.compile(rb"^WARC-Record-ID: <urn:page:(-?\d+)>\r?$", re.M)
_KIND = re.compile(rb"^WARC-Type: (\w+)\r?$", re.M)
_LENGTH = re.compile(rb"^Content-Length: (\d+)\r?$", re.M)
_FULL = re.compile(rb"^X-Payload-Length: (\d+)\r?$", re.M)
_DIGEST = re.compile(rb"^WARC-Payload-Digest: sha1:([A-Z2-7]+)\r?$", re.M)
_REFERS = re.compile(rb"^WARC-Refers-To: <urn:page:(-?\d+)>\r?$", re.M)
RECORD = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a text in upper-case base 32: five hexadecimal digits are four of its digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(
    pages: DataFrame,
    page_id: str,
    url: str,
    html: str,
    path: str,
    least: int = 0,
    compression: str = "gzip",
    records_per_file: int = 20_000,
    written: str | None = None,
) -> None:
    """Write one record for every page: of equal payloads of ``least`` bytes or more, the page of the
    smallest id is the response and the others revisit it.

    Payloads are compared by SHA-256 and length; rows that repeat the smallest id are all responses. A
    compressed file is one gzip member, which is read by one task and in which no reader can seek, so files have a
    bounded number of records. Records carry the mandatory fields of WARC 1.1; their date is ``written`` (as in
    2024-01-31T00:00:00Z), by default now, and revisits name the profile of identical payloads.
    """
    chosen = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("")), "[\r\n]", " ").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("payload"),
    )
    digests = chosen.select("page_id", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("sha"))
    digests = digests.where(F.col("size") >= least)
    # A hot payload is one row for each task after the first step of the aggregation.
    first = digests.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    again = digests.join(first, ["sha", "size"]).where(F.col("page_id") > F.col("first"))
    again = again.select("page_id", "sha", F.col("first").alias("refers_to")).distinct()
    rows = chosen.withColumn("sha", F.sha2("payload", 256)).join(again, ["page_id", "sha"], "left")
    revisit = F.col("refers_to").isNotNull()
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit(MAGIC),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.lit(LINE + "WARC-Record-ID: <urn:page:"),
        F.col("page_id").cast("string"),
        F.lit(">" + LINE + "WARC-Date: "),
        now if written is None else F.lit(written),
        F.lit(LINE + "WARC-Target-URI: "),
        F.col("url"),
        F.lit(LINE + "WARC-Payload-Digest: sha1:"),
        base32_sha1(F.col("payload")),
        F.lit(LINE + "X-Payload-Length: "),
        F.octet_length("payload").cast("string"),
        F.when(revisit, F.concat(F.lit(LINE + PROFILE + LINE + "WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(LINE + "Content-Type: text/html" + LINE + "Content-Length: "),
        F.when(revisit, "0").otherwise(F.octet_length("payload").cast("string")),
        F.lit(END),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    rows.where("page_id IS NOT NULL").select(head.alias("value")).write.options(
        lineSep=END, compression=compression, maxRecordsPerFile=records_per_file
    ).text(path)


def _first(pattern: re.Pattern, head: bytes) -> bytes | None:
    found = pattern.search(head)
    return found.group(1) if found else None


def _parse(piece: bytes) -> tuple[int, int, tuple] | None:
    """Of the text after a magic line: length of the head, length of the payload, fields; None if no record."""
    stop = piece.find(b"\r\n\r\n")
    if stop < 0:
        return None
    head = piece[: stop + 2]
    length = _first(_LENGTH, head)
    if length is None:
        return None
    fields = tuple(_first(p, head) for p in (_PAGE, _KIND, _FULL, _DIGEST, _REFERS))
    return stop + 4, int(length), fields


def _row(fields: tuple, payload: bytes) -> dict:
    """A result row; the digest and length of a response are those of the payload that was read."""
    page, kind, full, digest, refers = fields
    if kind == b"revisit":
        size, sha = int(full or 0), (digest or b"").decode()
    else:
        size, sha = len(payload), b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "page_id": None if page is None else int(page),
        "record_type": (kind or b"").decode(),
        "payload_bytes": size,
        "payload_digest": sha,
        "refers_to": None if refers is None else int(refers),
    }


CANDIDATE = f"path string, block long, spot long, size long, next long, piece binary, {RECORD}"


def candidates(spark: SparkSession, path: str, all_bytes: bool = False) -> DataFrame:
    """Every piece after a magic line: where it begins in its split, its bytes, and where its successor is.

    ``spot`` and ``next`` count from the first piece of the split and are those of the magic line; pieces
    that are a whole record by themselves carry its fields, the others (or all) their bytes.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    mark = len(MAGIC)
    columns = [c.split()[0] for c in CANDIDATE.split(", ")]

    def run(batches):
        at: dict[tuple[str, int], int] = {}
        for batch in batches:
            rows = []
            for path_, block, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                start = at.get((path_, block), 0)
                at = {(path_, block): start + len(value) + mark}  # splits come one after another
                row = dict.fromkeys(columns) | {"path": path_, "block": block, "spot": start - mark, "size": len(value) + mark}
                parsed = _parse(value)
                if parsed:
                    head, length, fields = parsed
                    row["next"] = start + head + length + 4
                    if head + length <= len(value) <= head + length + 4:
                        row |= _row(fields, value[head : head + length])
                if all_bytes or row["payload_digest"] is None:
                    row["piece"] = value
                rows.append(row)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(columns, types)], names=columns)

    return raw.mapInArrow(run, CANDIDATE)


def _in_files(found: DataFrame) -> DataFrame:
    """Positions in the split to offsets in the file; the piece before the first magic line goes.

    The sums are over one row for each split.
    """
    totals = found.groupBy("path", "block").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("path", "block", F.coalesce(before, F.lit(0)).alias("base"))
    placed = found.withColumn("here", F.col("spot")).join(bases, ["path", "block"])
    placed = placed.withColumns({"spot": F.col("spot") + F.col("base"), "next": F.col("next") + F.col("base")})
    return placed.drop("base").where("spot >= 0")


def reachable(records: DataFrame) -> DataFrame:
    """Of candidates (path, block, spot, next), (path, spot) of those that the chain from the first one of
    their file reaches.
    """
    nodes = records.select("path", "block", "spot", "next")
    order = Window.partitionBy("path", "block").orderBy("spot")
    follows = F.coalesce(F.lag("next").over(order) == F.col("spot"), F.lit(False))
    nodes = materialize(nodes.withColumn("follows", follows).withColumn("goes_on", F.coalesce(F.lead("spot").over(order) == F.col("next"), F.lit(False))), "nodes")
    # A link begins where the piece before does not lead, and wherever a jump lands.
    jumps = nodes.where(~F.col("goes_on") & F.col("next").isNotNull()).select("path", F.col("next").alias("spot")).distinct().withColumn("target", F.lit(True))
    marked = nodes.join(jumps, ["path", "spot"], "left")
    heads = marked.withColumn("begins", ~F.col("follows") | F.coalesce("target", F.lit(False)))
    heads = heads.withColumn("link", F.max(F.when(F.col("begins"), F.col("spot"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    heads = materialize(heads.select("path", "spot", "next", "link"), "links")
    last = F.max(F.struct("spot", "next"))["next"]
    links = heads.groupBy("path", F.col("link").alias("head")).agg(last.alias("goal"))
    # A file begins with a record, else nothing in it can be trusted.
    known = links.select("path", "head")
    reached = materialize(known.where("head = 0"), "reached")
    jump, count = materialize(links.where("goal IS NOT NULL"), "jumps"), -1
    while (now := reached.count()) != count:
        count = now
        ahead = reached.join(jump, ["path", "head"]).select("path", F.col("goal").alias("head"))
        reached = materialize(reached.unionAll(ahead.join(known, ["path", "head"], "left_semi")).distinct(), "reached")
        further = jump.select("path", F.col("head").alias("goal"), F.col("goal").alias("end"))
        jump = materialize(jump.join(further, ["path", "goal"]).select("path", "head", F.col("end").alias("goal")), "jumps")
    return heads.join(reached.withColumnRenamed("head", "link"), ["path", "link"], "left_semi").select("path", "spot")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under ``path``: page_id, record_type, payload_bytes, payload_digest, refers_to."""
    records = materialize(_in_files(materialize(candidates(spark, path), "candidates")), "records")
    kept = records.join(reachable(records).withColumn("real", F.lit(True)), ["path", "spot"], "left")
    names = [c.split()[0] for c in RECORD.split(", ")]
    whole = kept.where(F.col("real") & F.col("payload_digest").isNotNull()).select(*names)
    # Records that magic in their payload cut, and the pieces that are no records of their own.
    cut = kept.where(F.col("real").isNull() | F.col("payload_digest").isNull())
    owner = F.last(F.when(F.col("real"), F.col("spot")), ignorenulls=True).over(Window.partitionBy("path").orderBy("spot"))
    owned = materialize(cut.select("path", "block", "here", "spot", "piece", owner.alias("owner")).where("owner IS NOT NULL"), "owned")
    # A piece in a payload can look like a whole record; its bytes are read again.
    if owned.where("piece IS NULL").take(1):
        again = candidates(spark, path, all_bytes=True).select("path", "block", F.col("spot").alias("here"), F.col("piece").alias("read"))
        owned = owned.join(again, ["path", "block", "here"], "left").withColumn("piece", F.coalesce("piece", "read"))
    return whole.unionAll(_assemble(owned, names))


def _assemble(owned: DataFrame, names: list[str]) -> DataFrame:
    """Records from the pieces between their magic line and the next record's."""

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("spot").to_pylist(), table.column("piece").to_pylist()))
        data = MAGIC.encode().join(p for _, p in rows)
        parsed = _parse(data)
        made = [_row(parsed[2], data[parsed[0] : parsed[0] + parsed[1]])] if parsed and parsed[0] + parsed[1] <= len(data) else []
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.table([pa.array([r[c] for r in made], t) for c, t in zip(names, types)], names=names)

    return owned.select("path", "owner", "spot", "piece").groupBy("path", "owner").applyInArrow(join, RECORD)
