"""Secret scans with an incremental ledger of blobs, in SQL functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a Parquet table beside
which nothing needs to be kept, lists the pairs of blob and rule version that were scanned, with the spans
found. A run scans only pairs that the ledger does not have, one text for each blob, appends them, and
joins the findings back to all paths that hold the blob. A new version of a rule makes its pairs unseen
again; the others stay.

Spans count code points, the end exclusive. Matches of one rule are leftmost and do not overlap; those that
a rule's length condition refuses are dropped, but still take up their text. Null texts count as empty.
Repeated rows are scanned once and each get a result row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import fresh

SPAN = "struct<kind:string, start:bigint, stop:bigint>"
LEDGER = f"blob string, rule string, version int, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` must have ``least`` characters for a match to count."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0


# The three kinds of the contract, in its order. For runs of a class of characters, the
# least length is part of the pattern: a run is matched as a whole or not at all.
ASSIGN = Rule(
    "assign",
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    group=2,
    least=8,
)
ACCESS = Rule("access", r"AKIA[A-Z0-9]{12,}")
HEX = Rule("hex", r"[0-9a-f]{32,}")
BASE_RULES = (ASSIGN, ACCESS, HEX)
# A private key runs to its END line, over lines of base64 where that is missing, and to the end of a text that
# breaks off (one group of base64, four characters, at least). Runs are classes of characters: matching needs no stack, however long a body is.
_PEM_BODY = (
    r"[^-]*(?:-{1,4}[^-]+){0,16}-----END [A-Z ]{0,40}PRIVATE KEY-----",
    r"(?:\s{0,4}(?:Proc-Type|DEK-Info): [^\r\n]*){0,4}\s{0,4}[A-Za-z0-9+/=\\]{16,}[A-Za-z0-9+/=\r\n\\]*",
    r"\s{0,4}[A-Za-z0-9+/=\\]{4,}\z",
)
#: What the scan finds beside them.
MORE_RULES = (
    Rule("pem", rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:{'|'.join(_PEM_BODY)})?", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of the rule's matches: the pieces between matches and the matches give the positions."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    lengths = F.transform(found, F.length)
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    rows = F.arrays_zip(between.alias("gap"), lengths.alias("size"), tested.alias("tested"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + row["gap"]
        stop = start + F.coalesce(row["size"], F.lit(0))
        span = F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), stop.alias("stop"))
        taken = F.when(row["tested"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(stop.alias("at"), taken.alias("spans"))

    spans = F.aggregate(rows, zero, step, lambda state: state["spans"])
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, empty where none has been written yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def versions_of(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the address of each text's content as ``blob``."""
    return df.withColumn("blob", F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))


def update_ledger(df: DataFrame, text: str, path: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan what is unseen in ``df`` and append it; returns the number of pairs that were added.

    Pairs are counted by rule, so blobs that only lack one rule are scanned for that rule alone.
    """
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    blobs = versions_of(texts, "text")
    ledger = read_ledger(spark, path)
    wanted = F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    # The rules that each blob has been scanned for: a row for each blob of the ledger.
    done = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))
    unseen = blobs.select("blob").distinct().join(done, "blob", "left")
    unseen = unseen.withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<struct<rule:string,version:int>>"))))
    unseen = unseen.where(F.size("todo") > 0).select("blob", "todo")
    # One text of each blob: rows of a hot blob are dropped before they travel.
    one = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    scans = one.join(unseen, "blob").select("blob", "text", F.explode("todo").alias("todo"))
    chosen = F.lit(None).cast(f"array<{SPAN}>")
    for r in rules:
        here = (F.col("todo.rule") == r.kind) & (F.col("todo.version") == r.version)
        chosen = F.when(here, spans_of(F.col("text"), r)).otherwise(chosen)
    scanned = scans.select("blob", "todo.rule", "todo.version", chosen.alias("spans"))
    before = ledger.count()
    scanned.select("blob", "rule", F.col("version").cast("int").alias("version"), "spans").write.mode("append").parquet(path)
    return read_ledger(spark, path).count() - before


def findings(df: DataFrame, text: str, path: str, rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """``df`` with all spans of its texts from the ledger as ``into``, by start, then rule order."""
    ledger = read_ledger(df.sparkSession, path)
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
    # Only pairs with a span are joined; one row for each blob.
    spans = ledger.where(current & (F.size("spans") > 0)).select("blob", F.explode("spans").alias("s"))
    ranked = F.struct(F.col("s.start").alias("start"), rank[F.col("s.kind")].alias("rank"), F.col("s.stop").alias("stop"), F.col("s.kind").alias("kind"))
    gathered = spans.select("blob", ranked.alias("s")).distinct().groupBy("blob").agg(F.sort_array(F.collect_list("s")).alias(into))
    gathered = gathered.withColumn(into, F.transform(into, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))
    key = fresh(df, "blob")
    addressed = df.drop(into).withColumn(key, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    joined = addressed.join(gathered.withColumnRenamed("blob", f"{key} found"), F.col(f"`{key}`") == F.col(f"`{key} found`"), "left")
    empty = F.array().cast(f"array<{SPAN}>")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c != into), F.coalesce(F.col(f"`{into}`"), empty).alias(into))


def scan(df: DataFrame, text: str, path: str, rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """Bring the ledger at ``path`` up to date with ``df`` and give each row its spans."""
    update_ledger(df, text, path, rules)
    return findings(df, text, path, rules, into)


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(df: DataFrame, text: str, path: str, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """``df`` with every span of its texts (overlaps as one) replaced by ``mask``; null texts stay null."""
    key = fresh(df, "secrets found")
    marked = scan(df, text, path, rules, key)
    value = F.col(f"`{text}`")
    # Spans come by start: each adds what stands between it and the end of those before.
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(value, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        begins = (s["start"] >= state["at"]) & ((s["start"] > state["at"]) | (state["at"] == 0) | (s["start"] == state["at"]))
        out = F.when(begins, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), out.alias("out"))

    rest = F.aggregate(F.col(f"`{key}`"), zero, step, lambda state: F.concat(state["out"], F.substr(value, (state["at"] + 1).cast("int"))))
    clean = F.when(F.size(F.col(f"`{key}`")) > 0, rest).otherwise(value)
    return marked.select(*((clean if c == text else F.col(f"`{c}`")).alias(c) for c in df.columns))
