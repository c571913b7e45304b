"""Insert-if-absent loads, deletes and the write itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermarket.skew import any_null


def _columns(order_by: list[Column | str]) -> list[Column]:
    return [F.col(item) if isinstance(item, str) else item for item in order_by]


def first_wins(df: DataFrame, keys: list[str], order_by: list[Column | str]) -> DataFrame:
    """One row per key: the first by ``order_by``; rows with a NULL key all stay.

    An aggregate instead of a window: every map task keeps one row per key, so
    a key with countless copies never meets in one task. Equal orders are
    settled by a hash of the row.
    """
    missing = any_null(keys)
    return _first_of_keyed(df.filter(~missing), keys, order_by).unionByName(df.filter(missing))


def _first_of_keyed(df: DataFrame, keys: list[str], order_by: list[Column | str]) -> DataFrame:
    order = F.struct(*_columns(order_by), F.xxhash64(*df.columns))
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def insert_if_absent(
    target: DataFrame, incoming: DataFrame, keys: list[str], order_by: list[Column | str]
) -> DataFrame:
    """Rows of ``incoming`` to append: keys already stored are left alone.

    NULL keys never conflict, so those rows are all new. They are kept out of
    the joins, where they would all land in one task.
    """
    missing = any_null(keys)
    keyed = incoming.filter(~missing)
    conflicts = stored_keys(target, keyed, keys)
    new = _first_of_keyed(keyed, keys, order_by).join(conflicts, keys, "left_anti")
    return new.unionByName(incoming.filter(missing))


def stored_keys(target: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``keyed`` that are stored already.

    The stored keys are cut down to those that arrive. A small load is thus the
    side Spark can broadcast, and the stored table, however large, is scanned
    but not shuffled. Of the load only the key columns are read for it.
    """
    stored = target.select(*keys).filter(~any_null(keys))
    return stored.join(keyed.select(*keys), keys, "left_semi")


def insert_job_skills(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bridge pairs not stored yet."""
    pairs = ["job_id", "skill_id"]
    conflicts = stored_keys(target, incoming, pairs)
    return incoming.select(*pairs).distinct().join(conflicts, pairs, "left_anti")


def write_table(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = ("source",), mode: str = "append"
) -> None:
    """Append one load in one job, laid out so that a source is one folder."""
    writer = df.write.mode(mode)
    present = [name for name in partition_by if name in df.columns]
    if present:
        writer = writer.partitionBy(*present)
    writer.parquet(path)


def delete_cascade(bridge: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Bridge rows that remain after deleting offers (or skills) by ``key``."""
    return bridge.join(deleted.select(key).distinct(), key, "left_anti")
