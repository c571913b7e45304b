"""One query per operator over its whole table, in the shape its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermarket.llm import (
    byte_bpe,
    decontaminate,
    exact_dedup,
    filter_audit,
    lexical_search,
    license_scan,
    line_dedup,
    lm_scoring,
    main_text,
    near_dedup,
    quality,
    sharding,
    toxicity,
)
from offermarket.llm.labelled import held_out
from offermarket.llm.shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; tasks that read it can import this package."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    texts = main_text.main_text(table(spark, folder, "pages"), carry=["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def vocabulary() -> byte_bpe.Vocabulary:
    return byte_bpe.load_vocabulary(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = vocabulary()
    encoded = byte_bpe.encode(table(spark, folder, "documents"), ranks, carry=["doc_id"]).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
    )
    decoded = byte_bpe.decode(encoded, ranks, carry=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_suffix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_matches(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), carry=["doc_id"]
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scores, _ = quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scores.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.LEAST_SCORE).cast("int").alias("predicted"),
    )


def op6_feistel_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shard_rows(rows, shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    classes = near_dedup.near_classes(table(spark, folder, "documents"), carry=["doc_id"])
    return classes.select("doc_id", "class_id", "class_size", "kept")


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    out = held_out(F.col("doc_id"), mod=7, remainder=2)
    scores, model = lm_scoring.train_and_score(table(spark, folder, "documents"), ~out, carry=["doc_id"])
    return scores.select(
        "doc_id",
        out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"), digest_all=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scores = toxicity.toxicity_scores(docs, table(spark, folder, "labels"), carry=["doc_id"])
    return scores.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(table(spark, folder, "documents"), carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), top=50)


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_line_dedup": op2_line_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_suffix_decontamination": op4_suffix_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_feistel_sharding": op6_feistel_sharding,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_license_scan": op12_license_scan,
    "op13_lexical_search": op13_lexical_search,
}
