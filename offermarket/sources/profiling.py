"""A first look at a raw source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_source(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, NULLs and approximate distinct values.

    A single pass over the source, whatever its number of columns.
    """
    measures = [F.count(F.lit(1)).alias("n_rows")]
    for position, name in enumerate(df.columns):
        quoted = F.col(f"`{name}`")
        measures.append(F.count_if(quoted.isNull()).alias(f"null_{position}"))
        measures.append(F.approx_count_distinct(quoted).alias(f"distinct_{position}"))
    rows = [
        F.struct(
            F.lit(position + 1).alias("position"),
            F.lit(name).alias("column"),
            F.lit(kind).alias("dtype"),
            F.col("n_rows"),
            F.col(f"null_{position}").alias("n_null"),
            F.col(f"distinct_{position}").alias("n_distinct_approx"),
        )
        for position, (name, kind) in enumerate(df.dtypes)
    ]
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def first_rows(df: DataFrame, n: int = 3) -> DataFrame:
    """The rows shown next to a source's profile."""
    return df.limit(n)
