"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

A first pass reads lengths and prefix hashes only. Texts whose length is unique, or
whose prefix hash is unique within a length, are settled by it; the others get a
full hash in a second pass. The text itself is never shuffled: groups of a prefix
that has company are named by a slot among ``SLOTS``, whose list has a fixed
largest size and can be broadcast. A slot shared by chance costs a hash, no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermarket.llm.frames import field, without_blanks
from offermarket.skew import hot_join
from offermarket.staging import stage

#: Slots of the broadcast list: 2**20 integers at most, about 16 MB as a hash table.
SLOTS = 1 << 20
PREFIX = 64


def _slot(length: Column, prefix: Column) -> Column:
    return F.pmod(F.xxhash64(length, prefix), F.lit(SLOTS)).cast("int")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False
) -> DataFrame:
    """One row per document: ``doc_id, n_chars, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after deleting ``[\\x20\\x09-\\x0D]``. The row with the
    most code points in the original text stays, then that with the smallest id; of
    rows equal in both, one. A NULL text counts as empty, a NULL id as the largest.
    ``text_sha256`` is the digest of the shortened text; texts settled without it have
    NULL there unless ``digest_all`` asks for it. Other columns play no part.
    """
    text = F.coalesce(field(text_col), F.lit(""))
    # Named in a projection of its own, so that it is worked out once a row.
    rows = docs.select(field(id_col).alias("doc_id"), F.length(text).alias("n_chars"), without_blanks(text).alias("bare"))
    rows = rows.select(
        "doc_id",
        "n_chars",
        "bare",
        F.octet_length("bare").alias("length"),
        F.xxhash64(F.substring("bare", 1, PREFIX)).alias("prefix"),
    )
    first = stage(rows.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")), "prefix-groups")
    lengths = first.groupBy("length").agg(F.sum("n").alias("rows")).filter("rows > 1").select("length")
    crowded = first.filter("n > 1").join(lengths, "length", "left_semi")
    slots = F.broadcast(crowded.select(_slot(F.col("length"), F.col("prefix")).alias("slot")).distinct())
    dealt = rows.withColumn("slot", _slot(F.col("length"), F.col("prefix")))
    open_rows = dealt.join(slots, "slot", "left_semi")
    alone = dealt.join(slots, "slot", "left_anti")

    hashed = stage(
        open_rows.groupBy(F.sha2("bare", 256).alias("text_sha256"), "doc_id", "n_chars").agg(
            F.count(F.lit(1)).alias("copies")
        ),
        "full-hashes",
    )
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = stage(
        hashed.groupBy("text_sha256").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("copies").alias("group_size"),
            F.min_by(F.struct("doc_id", "n_chars"), order).alias("best"),
        ),
        "full-hash-groups",
    )
    joined = hot_join(
        hashed, groups.drop("n_rows"), groups.select("text_sha256", "n_rows"), ["text_sha256"], ["doc_id", "n_chars"]
    )
    best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == F.col("best.n_chars"))
    grouped = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (best & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )
    single = alone.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        (F.sha2("bare", 256) if digest_all else F.lit(None).cast("string")).alias("text_sha256"),
    )
    return single.unionByName(grouped)
