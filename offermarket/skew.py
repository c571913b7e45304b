"""Joins and numbering that stay balanced when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermarket.staging import stage

SALTS = 32
BLOCK = 10_000
BUCKETS = 4096
# Bytes a lookup side may have to be broadcast: it lies in the driver and in every executor.
BROADCAST_BYTES = 128 << 20


def _check(how: str) -> None:
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep their meaning when salted")


def salted_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` (one row per key) with hot keys spread out.

    Each key of ``facts`` is divided into ``salts`` parts by a hash of
    ``spread_by``; the lookup side, small by nature, is repeated once per part.
    Rows with a NULL key are spread as well, although they match nothing.
    """
    _check(how)
    salted = facts.withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    )
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def blocked_row_number(
    df: DataFrame, keys: list[str], order: str, name: str, block: int = BLOCK
) -> DataFrame:
    """``row_number`` per key over an integer ``order`` column, in parallel.

    Rows are numbered inside blocks of the order column; a second, far smaller
    window over one row per block adds what the earlier blocks hold. No task
    ever sorts a whole hot key.
    """
    blocks = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    sizes = blocks.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *keys, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    numbered = blocks.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_block", "_before", "_inside")
    )


def dense_row_number(
    df: DataFrame, keys: list[str], by: list[str], name: str, buckets: int = BUCKETS
) -> DataFrame:
    """Numbers from 1 without gaps per key, in no meaningful order, in parallel.

    Rows are dealt to buckets by a hash of ``by`` and numbered inside them; what the
    earlier buckets hold comes from a table of one row per key and bucket. No task
    ever holds a whole hot key. ``df`` is read twice and should be staged; rows equal
    in ``keys`` and ``by`` get numbers of their own.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*by)
    numbered = dealt.withColumn("_inside", F.row_number().over(inside)).join(offsets, [*keys, "_bucket"])
    return numbered.withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``row_number`` over a whole frame without bringing it into one task.

    Rows are partitioned by ranges of the order and staged; the driver adds up one
    count per partition, and each is numbered on its own from there on.
    """
    placed = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = {row["_part"]: row["n"] for row in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0]
    for part in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(part, 0))
    before = F.get(F.array(*[F.lit(start).cast("long") for start in starts]), F.col("_part"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn(name, before + inside).drop("_part")


def spread(df: DataFrame, *keys: str, rows_each: int | None = None) -> DataFrame:
    """Partition by keys into the session's full number of partitions.

    For rows that are few bytes but much work: a number that is given is kept,
    while adaptive execution would merge small partitions into a single task. With
    ``rows_each``, there are as many partitions as keep to about that many rows each;
    ``df`` is counted for that and should be staged.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows_each is not None:
        partitions = max(partitions, -(-df.count() // rows_each))
    return df.repartition(partitions, *keys)


def any_null(columns: list[str]) -> Column:
    """True where at least one of the columns is NULL."""
    result = F.lit(False)
    for name in columns:
        result = result | F.col(name).isNull()
    return result


def measured_bytes(df: DataFrame) -> int:
    """About the bytes of a frame's rows in memory, measured in one pass over it."""
    text = F.octet_length(F.to_json(F.struct(*df.columns)))
    return int(df.agg(F.coalesce(F.sum(text + F.lit(64)), F.lit(0))).first()[0])


def sized_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    limit: int = BROADCAST_BYTES,
    *,
    always: bool = True,
) -> DataFrame:
    """Inner join that broadcasts the lookup side up to ``limit`` bytes, which are measured.

    Beyond it, and unless ``always`` where a session has turned broadcasts off, the join is a
    shuffled one with every key spread out: where a key joins many rows with many, it is the
    pairs that pile up in a task, which no size of the input shows. ``lookup`` is read twice
    and should be staged.
    """
    turned_off = facts.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    if (always or not turned_off) and measured_bytes(lookup) <= limit:
        return facts.join(F.broadcast(lookup), on)
    return salted_lookup(facts, lookup.hint("merge"), on, spread_by)


def _key_hash(counts: DataFrame, on: list[str]) -> Column:
    """A number per key, the same on both sides of a join whatever integer types they use."""
    return F.xxhash64(*[F.col(name).cast(counts.schema[name].dataType) for name in on])


def _hot_keys(counts: DataFrame, on: list[str], share: float) -> list[int]:
    """Hashes of the keys that hold more than ``share`` of the rows: ``1 / share`` at most.

    A key that shares a hash by chance is spread as well, which is harmless.
    """
    total = counts.agg(F.sum("n_rows")).scalar()
    found = counts.filter(F.col("n_rows") > F.lit(share) * total).select(_key_hash(counts, on).alias("key"))
    return sorted({row["key"] for row in found.collect()})


def hot_join(
    facts: DataFrame,
    lookup: DataFrame,
    counts: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    share: float = 0.001,
    salts: int = SALTS,
) -> DataFrame:
    """Join that spreads only the keys holding more than ``share`` of ``facts``.

    ``counts`` tells the rows (``n_rows``) of ``facts`` per key, usually from an
    aggregate that exists anyway; it is read at once and should be staged. At most
    ``1 / share`` keys can pass the test, whatever the data: that bound is what allows
    their hashes to be listed in the plan, so that no join finds the hot keys. All
    other keys join as usual, and the lookup side is repeated for hot keys only, so
    it may be as large as ``facts``. Rows with a NULL key are spread too.
    """
    _check(how)
    hot = _hot_keys(counts, on, share)
    if not hot and how == "inner":
        return facts.join(lookup, on)
    key = _key_hash(counts, on)
    part = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    salted = facts.withColumn("_salt", F.when(key.isin(hot) | any_null(on), part).otherwise(0))
    parts = F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.withColumn("_salt", F.explode(parts))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
