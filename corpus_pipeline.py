"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns documents with the same columns; the last one returns token
ids. Rows that a stage does not drop keep every column, whatever else the table carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm import bpe, decontaminate, langid, minhash, secret_scan
from batchloom.llm.queries import language_model, table, vocabulary_path
from batchloom.session import materialize, scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; texts without a letter go as well."""
    return langid.keep_identified(docs, "text", language_model(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near-duplicates."""
    return minhash.keep_one(docs, "doc_id", "text")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item_text")
    return decontaminate.drop_contaminated(docs, "text", items, "item_id", "item_text")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their text masked; ``n_chars`` follows the text."""
    masked = secret_scan.redact(docs, "text", scratch_path(spark, "ledger"))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    counted = F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
    return masked.select(*((counted if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    rest = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "n_tokens", "same_text")))
    ids = bpe.encode(rest, "text", vocabulary_path(), "ids", verified="same_text")
    return ids.drop("text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Trained models, alignments and merges are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None
