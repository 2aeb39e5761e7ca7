"""One registered query for each corpus operator, over the whole tables, and its SQL where SQL can say it.

A query applies its operator with production settings and derives digest columns; the operators
themselves return texts, ids, spans and files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm import audit, bpe, decontaminate, langid, lines, minhash, pii, quality, search, secret_scan, suffix, toxicity, warc
from batchloom.llm.common import crc_fold
from batchloom.llm.oracle import ORACLE  # noqa: F401
from batchloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

#: Name of the public vocabulary file that the queries encode with.
VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the text that they decode to."""
    return bpe.round_trip(table(spark, folder, "documents"), "doc_id", "text", vocabulary_path())


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return minhash.near_duplicates(table(spark, folder, "documents"), "doc_id", "text")[0]


def _labelled(spark: SparkSession, folder: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All documents with their fold, and the labels that may be learned from."""
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", crc_fold(F.col("doc_id"), 4) == 2)
    labels = table(spark, folder, "labels").select("doc_id", label)
    return docs, labels.where(crc_fold(F.col("doc_id"), 4) != 2)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every document; label 1 is good."""
    docs, labels = _labelled(spark, folder, "quality")
    model = quality.fit(docs, labels, "doc_id", "text", "quality")
    return quality.score(docs, "doc_id", "text", model, keep=("held_out",))


def op4_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document without the strings of 100 bytes that start earlier."""
    return suffix.remove_repeats(table(spark, folder, "documents"), "doc_id", "text")


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Trained on the documents with a language whose fold is not held out."""
    return langid.fit(docs.where(crc_fold(F.col("doc_id"), 3) != 1), "text", "lang", "doc_id")


def op5_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_fold(F.col("doc_id"), 3) == 1)
    return langid.identify(docs, "doc_id", "text", language_model(docs), keep=("held_out",))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as it comes back from the archives."""
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), "page_id", "url", "html", path)
    return warc.read_archives(spark, path)


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _number_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, _is_kind(kind))).cast("long")


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts, a digest of the base spans, and all spans."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, "text", scratch_path(spark, "ledger"))
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    counts = [_number_of("secrets", kind).alias(f"n_{kind}") for kind in kinds]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("secrets")).alias("spans"),
    )


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document; label 1 is toxic."""
    docs, labels = _labelled(spark, folder, "toxic")
    index = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    return toxicity.score(docs, "doc_id", "text", index, keep=("held_out",))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items that each document holds."""
    items = table(spark, folder, "benchmark").withColumnRenamed("text", "item_text")
    return decontaminate.find_items(table(spark, folder, "documents"), "doc_id", "text", items, "item_id", "item_text")


def op10_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules on every document; the host is its source."""
    return lines.apply_rules(table(spark, folder, "documents"), "doc_id", "text", "source").drop("host")


def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    items = table(spark, folder, "benchmark").withColumnRenamed("text", "item_text")
    return search.search(table(spark, folder, "documents"), "doc_id", "text", items, "item_id", "item_text")


def op12_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Five filters in every order: what each removes in each language."""
    marked = audit.masks(table(spark, folder, "documents"), "doc_id", "text", "lang")
    return audit.audit(audit.mask_counts(marked, table(spark, folder, "labels"), "doc_id", "quality", "toxic"), "ABCDE")


def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: counts, a digest of the base spans, and all spans."""
    found = pii.find(table(spark, folder, "documents"), "text", ("doc_id",))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_minhash": op2_minhash,
    "op3_quality": op3_quality,
    "op4_suffix": op4_suffix,
    "op5_langid": op5_langid,
    "op6_warc": op6_warc,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_lines": op10_lines,
    "op11_search": op11_search,
    "op12_audit": op12_audit,
    "op13_pii": op13_pii,
}
