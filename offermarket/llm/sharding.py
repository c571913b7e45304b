"""Sharding by a keyed permutation of global row numbers.

Rows are numbered without a global sort: a hash deals them to buckets, the bucket
sizes become offsets, and rows are numbered inside their bucket. A Feistel network
over the numbers then shuffles them; shard and slot are arithmetic on the shuffled
number, so the place of a row can be computed from its number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermarket.llm.frames import field

ROUNDS = 8
# x -> x**5 is one-to-one below this Mersenne prime, and every product stays under 2**62.
PRIME = (1 << 31) - 1
#: Rows that one task numbers, about; and buckets at least.
BUCKET_ROWS = 1 << 18
MIN_BUCKETS = 1024


def sides(n: int) -> tuple[int, int]:
    """Two moduli with a product of at least ``n`` and less than ``n`` plus the first."""
    a = max(1, math.isqrt(n))
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[int]:
    """Keys below PRIME, drawn from the seed by a linear congruence."""
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        x = (x * 48271 + 11) % PRIME
        keys.append(x)
    return keys


def _pass(number: Column, n: int, seed: int) -> Column:
    """The network once, over 0 .. a * b - 1: each round shifts one half by a function of the other."""
    a, b = (F.lit(m).cast("long") for m in sides(n))
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])
    halves = F.struct(F.call_function("div", number, b).alias("l"), (number % b).alias("r"), F.lit(True).alias("left"))

    def turn(acc: Column, key: Column) -> Column:
        y = (F.when(acc["left"], acc["r"]).otherwise(acc["l"]) + key) % PRIME
        square = (y * y) % PRIME
        shift = ((square * square) % PRIME) * y % PRIME
        return F.struct(
            F.when(acc["left"], (acc["l"] + shift) % a).otherwise(acc["l"]).alias("l"),
            F.when(acc["left"], acc["r"]).otherwise((acc["r"] + shift) % b).alias("r"),
            (~acc["left"]).alias("left"),
        )

    return F.aggregate(keys, halves, turn, lambda acc: acc["l"] * b + acc["r"])


def permuted(number: Column, n: int, seed: int) -> Column:
    """A one-to-one map of 0 .. n-1 onto itself.

    What falls beyond ``n`` walks on along its cycle. A cycle holds no more than
    ``a * b - n`` such numbers, fewer than the root of ``n``, and as few rows start
    one: the walk always ends and costs less than a step per row on the whole.
    """
    a, b = sides(n)
    once = _pass(number, n, seed)
    if a * b == n:
        return once
    steps = F.sequence(F.lit(1), F.lit(a * b - n))
    return F.transform(
        F.array(once),
        lambda p: F.when(p < n, p).otherwise(
            F.aggregate(steps, p, lambda at, _: F.when(at < n, at).otherwise(_pass(at, n, seed)))
        ),
    )[0]


def numbered_rows(rows: DataFrame, n: int, name: str = "row_number") -> DataFrame:
    """The ``n`` rows with numbers from 0, the same on every run whatever their order.

    Equal rows can't be told apart: they are counted per input partition, get a range
    of numbers together, and are expanded again after the ranges were dealt out, so
    that no task holds all copies of a row. NULLs are values like any other.
    """
    # Names of their own, so that no input column clashes with those used here.
    mine = [f"_{i}" for i in range(len(rows.columns))]
    buckets = max(MIN_BUCKETS, -(-n // BUCKET_ROWS))
    counted = (
        rows.select(*[field(c).alias(m) for c, m in zip(rows.columns, mine)], F.spark_partition_id().alias("part"))
        .groupBy(*mine, "part")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("bucket", F.pmod(F.xxhash64(*mine), F.lit(buckets)))
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy("bucket").agg(F.sum("copies").alias("size"))
    # One row per bucket: their number is set by BUCKET_ROWS.
    offsets = sizes.select("bucket", F.coalesce(F.sum("size").over(before.orderBy("bucket")), F.lit(0)).alias("offset"))
    inside = before.partitionBy("bucket").orderBy(*mine, "part")
    starts = (
        counted.withColumn("start", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(offsets, "bucket")
        .select(*mine, "copies", (F.col("start") + F.col("offset")).alias("start"))
        .repartition("start")
    )
    numbers = starts.select(
        *mine, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("copies") - 1)).alias("number")
    )
    kept = [F.col(m).alias(c) for c, m in zip(rows.columns, mine) if c.lower() != name.lower()]
    return numbers.select(*kept, F.col("number").alias(name))


def shard_rows(rows: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """Every row with its global ``row_number``, its ``shard`` and its ``slot`` there.

    Shards differ by one row at most and slots have no gaps from 0. All columns take
    part in the numbering, so only what is needed should be given. The result holds
    for any order and partitioning of the input; equal rows get places of their own,
    NULLs are values, an empty table gives an empty one, and input columns with the
    names of results are replaced.
    """
    n = rows.count()
    numbered = numbered_rows(rows, n)
    place = permuted(F.col("row_number"), max(n, 1), seed)
    kept = [field(c) for c in numbered.columns if c.lower() not in ("shard", "slot")]
    return numbered.select(*kept, place.alias("_place")).select(
        *kept,
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("_place"), F.lit(shards).cast("long")).alias("slot"),
    )
