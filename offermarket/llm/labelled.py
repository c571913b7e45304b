"""Labels of documents and the part of them that a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermarket.llm.frames import field
from offermarket.skew import hot_join
from offermarket.staging import stage

#: A document is held out if crc32 of its id as text leaves 0 by this number.
FOLDS = 5


def held_out(doc_id: Column, mod: int = FOLDS, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == remainder


def with_labels(rows: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """``rows`` that have a label of 0 or 1, with it as ``_label``; those held out are left out.

    A label that is given twice counts once, contradicting ones count both, and rows
    with a NULL id or label have none. An id with very many rows is split over tasks.
    """
    known = (
        labels.select(field(id_col).alias("_id"), field(label).cast("int").alias("_label"))
        .filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
        .distinct()
    )
    mine = rows.withColumn("_id", field(id_col)).filter(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    counts = stage(mine.groupBy("_id").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1"), "id-counts")
    return hot_join(mine.withColumn("_spread", F.monotonically_increasing_id()), known, counts, ["_id"], ["_spread"]).drop(
        "_id", "_spread"
    )
