"""From raw documents to token ids: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermarket.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from offermarket.llm.queries import table, vocabulary
from offermarket.staging import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that documents share go, except in the first; ``n_chars`` follows the text."""
    return line_dedup.drop_shared_lines(docs).select(*docs.columns)


def first_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives its text back."""
    ranks = vocabulary()
    kept = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    encoded = byte_bpe.encode(kept, ranks, carry=["doc_id", "lang", "source", "text_sha256"])
    decoded = byte_bpe.decode(encoded, ranks)
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        "text_sha256",
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", own_lines),
    ("minhash_near_dedup", first_of_class),
    ("benchmark_decontamination", clean_of_benchmark),
    ("byte_bpe", token_ids),
]

# The classifier, and near duplicates joined into classes, are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
