"""Line dedup: lines that several documents share stay in one of them.

Lines are exploded and hashed; the distinct documents of each hash are counted
from distinct ``(hash, document)`` pairs, so a line that every document holds
still arrives pre-aggregated. Only hashes travel, and the texts of documents that lose
a line, once, when they meet the positions. Frequent lines are split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermarket.llm.frames import BLANKS, ascii_lower, field, pack, unpack
from offermarket.skew import hot_join
from offermarket.staging import stage

#: Slots of the broadcast list of documents that lose lines: 2**20 integers at most, about 16 MB as a hash table.
SLOTS = 1 << 20


def _slot(id_col: str, key_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col, key_col), F.lit(SLOTS)).cast("int")


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """Drop every line held by ``min_docs`` documents or more, except in the smallest id holding it.

    Returns the input columns with the text replaced, plus ``n_lines`` (before) and
    ``n_dropped``. Keys below ``min_chars`` code points are never dropped. A NULL or
    empty text is one empty line and comes back empty. Rows with the same id are one
    document, so what they share between them stays; NULL ids are one document that
    comes after all others. A document may come back without any line, as empty text.
    """
    rows = pack(docs, id=field(id_col), text=F.coalesce(field(text_col), F.lit(""))).withColumn(
        "text_key", F.xxhash64("text")
    )
    lines = stage(
        rows.select("id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.length("key") >= min_chars)
        .select("id", "text_key", "pos", F.unhex(F.md5("key")).alias("line_hash")),
        "lines",
    )
    holders = (
        lines.groupBy("line_hash", "id")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .groupBy("line_hash")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("keeper"), F.sum("n_rows").alias("n_rows"))
        .filter(F.col("n_docs") >= min_docs)
    )
    shared = stage(holders, "shared-lines")
    lost = (
        hot_join(lines, shared.drop("n_rows"), shared.select("line_hash", "n_rows"), ["line_hash"], ["id", "pos"])
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "text_key")
        .agg(F.collect_set("pos").alias("lost"))
        .select(F.col("id").alias("lost_id"), F.col("text_key").alias("lost_key"), "lost")
    )
    lost = stage(lost, "lost-lines")
    here = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("text_key") == F.col("lost_key"))
    # Only texts that lose a line are shuffled. Chance company in a slot costs a text's way, no more.
    slots = F.broadcast(lost.select(_slot("lost_id", "lost_key").alias("slot")).distinct())
    dealt = rows.withColumn("slot", _slot("id", "text_key"))
    losing = dealt.join(slots, "slot", "left_semi").drop("slot").join(lost, here, "left").drop("lost_id", "lost_key")
    whole = dealt.join(slots, "slot", "left_anti").drop("slot").withColumn("lost", F.lit(None).cast("array<int>"))
    split = losing.unionByName(whole).withColumn("lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    # The positions come in order; a document's lines are joined where the document is.
    joined = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(joined)
    more = {"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {}
    return unpack(
        split,
        docs.columns,
        **{text_col: text},
        **more,
        n_lines=F.size("lines").cast("long"),
        n_dropped=F.coalesce(F.size("lost"), F.lit(0)).cast("long"),
    )
