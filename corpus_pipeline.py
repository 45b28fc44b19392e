"""A corpus in five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import line_quality, packing, repeats, secrets, simhash
from tallyspark.llm.common import written

#: Columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the rules and removes lines that many documents of a source share."""
    return _columns(line_quality.cleaned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that shares 0.8 of its five-word shingles."""
    return _columns(simhash.first_of_each(docs, simhash.similar_documents(docs)))


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out strings of 200 bytes that occur more than once; documents stay, even if little is left."""
    return _columns(repeats.without_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets and the parts of credentials."""
    return _columns(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: a row for each piece of each document."""
    return packing.packed(packing.text_items(docs))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated text", repeated_text),
    ("secret scan", secret_scan),
    ("packing", pack),
]
#: Fingerprints and cut bytes are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
