import pytest
from awkward import clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from offermarket.llm.sharding import PRIME, ROUNDS, permuted, round_keys, shard_rows, sides


def place(number, n, seed):
    """The permutation, computed from the number alone."""
    a, b = sides(n)
    while True:
        left, right = divmod(number, b)
        for i, key in enumerate(round_keys(seed)):
            y = ((right if i % 2 == 0 else left) + key) % PRIME
            shift = pow(y, 5, PRIME)
            if i % 2 == 0:
                left = (left + shift) % a
            else:
                right = (right + shift) % b
        number = left * b + right
        if number < n:
            return number


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10))
def test_permutation_is_one_to_one(n, seed):
    a, b = sides(n)
    assert n <= a * b < n + max(a, 1) + 1
    assert sorted(place(i, n, seed) for i in range(n)) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000, 4093])
def test_column_equals_plain_arithmetic(spark, n):
    from pyspark.sql import functions as F

    rows = spark.range(n).select("id", permuted(F.col("id"), n, 5).alias("p")).collect()
    assert all(r.p == place(r.id, n, 5) for r in rows)


def test_large_numbers_do_not_overflow(spark):
    from pyspark.sql import functions as F

    n = 10**12 + 39
    ids = [0, 1, n - 1, 123456789012]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", permuted(F.col("id"), n, 3).alias("p"))
    assert all(r.p == place(r.id, n, 3) for r in rows.collect())


def check(df, n, shards):
    rows = df.collect()
    assert sorted(r.row_number for r in rows) == list(range(n))
    for r in rows:
        p = place(r.row_number, n, 1)
        assert (r.shard, r.slot) == (p % shards, p // shards)
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    assert all(found == list(range(len(found))) for found in slots.values())
    sizes = [len(found) for found in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_awkward_rows_and_clashes(spark):
    docs = clashing(spark, "row", "part", "copies", "bucket", "start", "number", "shard", "slot", "row_number")
    check(shard_rows(docs, 8), docs.count(), 8)
    assert shard_rows(documents(spark, []), 8).count() == 0


def test_copies_and_repartitioning(spark):
    rows = [(1, "copy")] * 4000 + [(i, "x") for i in range(500)]
    docs = documents(spark, rows).select("doc_id", "text")
    check(shard_rows(docs.repartition(3), 5), 4500, 5)
    one = sorted(tuple(r) for r in shard_rows(docs.repartition(3), 5).collect())
    other = sorted(tuple(r) for r in shard_rows(docs.repartition(7, "doc_id"), 5).collect())
    assert one == other


def test_shuffle_mixes_neighbours():
    n = 10_000
    assert ROUNDS >= 6
    near = sum(abs(place(i, n, 1) - place(i + 1, n, 1)) < n // 100 for i in range(2000))
    assert near < 100
