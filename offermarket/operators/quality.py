"""Rules of the stored tables, load reports and row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermarket.schemas import FOREIGN_KEYS, MAX_LENGTH, NOT_NULL, UNIQUE
from offermarket.skew import any_null


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """``(rule, table, n_violations)`` for every rule of the given tables.

    NOT NULL and length rules of a table share one pass. Uniqueness counts the
    rows beyond the first of a key; foreign keys are counted per value before
    they meet the parent table, so a popular parent costs one row.
    """
    parts = []
    for name, table in tables.items():
        parts.extend(_column_rules(name, table))
        for keys in UNIQUE.get(name, []):
            parts.append(_unique_rule(name, table, keys))
    for child, key, parent in FOREIGN_KEYS:
        if child in tables and parent in tables:
            parts.append(_foreign_key_rule(child, tables[child], key, tables[parent]))
    return _stack(parts)


def _column_rules(name: str, table: DataFrame) -> list[DataFrame]:
    checks = {}
    for column in NOT_NULL.get(name, []):
        if column in table.columns:
            checks[f"not null {column}"] = F.col(column).isNull()
    for column, limit in MAX_LENGTH.get(name, {}).items():
        if column in table.columns:
            checks[f"length {column} <= {limit}"] = F.length(column) > limit
    if not checks:
        return []
    counted = table.agg(
        *[F.count_if(broken).alias(f"rule_{i}") for i, broken in enumerate(checks.values())]
    )
    rows = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(name).alias("table"),
            F.col(f"rule_{i}").alias("n_violations"),
        )
        for i, rule in enumerate(checks)
    ]
    return [counted.select(F.inline(F.array(*rows)))]


def _unique_rule(name: str, table: DataFrame, keys: list[str]) -> DataFrame:
    groups = table.filter(~any_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    extra = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_violations"))
    return extra.select(
        F.lit(f"unique {', '.join(keys)}").alias("rule"), F.lit(name).alias("table"), "n_violations"
    )


def _foreign_key_rule(name: str, child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    values = (
        child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    )
    orphans = values.join(parent.select(F.col("id").alias(key)), key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_violations")).select(
        F.lit(f"foreign key {key}").alias("rule"), F.lit(name).alias("table"), "n_violations"
    )


def load_report(
    read: DataFrame,
    accepted: DataFrame,
    rejected: DataFrame,
    new_rows: DataFrame,
    bridge_new: DataFrame,
) -> DataFrame:
    """``(metric, n)``: rows read, rejected, duplicate, inserted and pairs inserted."""
    counts = _stack(
        [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "n")
            for metric, df in [
                ("read", read),
                ("accepted", accepted),
                ("rejected", rejected),
                ("inserted", new_rows),
                ("job_skills inserted", bridge_new),
            ]
        ]
    )
    duplicate = counts.agg(
        F.sum(
            F.when(F.col("metric") == "accepted", F.col("n"))
            .when(F.col("metric") == "inserted", -F.col("n"))
            .otherwise(0)
        ).alias("n")
    ).select(F.lit("duplicate").alias("metric"), "n")
    return counts.unionByName(duplicate)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, source, n)``; tables without a source have a NULL one."""
    parts = []
    for name, table in tables.items():
        if "source" in table.columns:
            counted = table.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        else:
            counted = table.agg(F.count(F.lit(1)).alias("n")).withColumn(
                "source", F.lit(None).cast("string")
            )
        parts.append(counted.select(F.lit(name).alias("table"), "source", "n"))
    return _stack(parts)
