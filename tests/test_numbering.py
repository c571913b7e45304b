"""Numbering whole frames, and the bitmap index that is built on it."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from offermarket.operators import career
from offermarket.skew import dense_row_number, global_row_number


def test_dense_numbers_of_hot_and_missing_keys(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") < 900, F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        (F.col("id") % 1000).alias("twice"),
    )
    got = rows(dense_row_number(df.filter("k is not null"), ["k"], ["twice"], "number", buckets=16), "k", "number")
    sizes = {}
    for key, _ in got:
        sizes[key] = sizes.get(key, 0) + 1
    assert sizes["hot"] == 2000
    assert sorted(got) == sorted((key, number) for key, n in sizes.items() for number in range(1, n + 1))
    assert dense_row_number(df.limit(0), ["k"], ["twice"], "number").count() == 0


def test_global_numbers_follow_the_order(spark):
    values = [(i * 7919 % 1000 // 3, f"n{i}") for i in range(1000)]
    df = spark.createDataFrame(values, "v long, name string").repartition(5)
    got = rows(global_row_number(df, [F.desc("v"), F.asc("name")], "rank"), "rank", "v", "name")
    wanted = sorted(values, key=lambda x: (-x[0], x[1]))
    assert sorted(got) == [(i, *x) for i, x in enumerate(wanted, 1)]
    assert global_row_number(df.limit(0), [F.asc("v"), F.asc("name")], "rank").count() == 0


@pytest.mark.parametrize("words", [1, 16])
def test_countries_by_bitmaps(spark, monkeypatch, words):
    """With one word a country of 300 offers has several blocks."""
    monkeypatch.setattr(career, "WORDS", words)
    draw = random.Random(2)
    skills = [f"s{i}" for i in range(12)]
    offers = [(f"j{i}", draw.choice(["A", "A", "A", "B", None]), draw.sample(skills, draw.randint(1, 4))) for i in range(400)]
    data = [(job, country, skill) for job, country, needed in offers for skill in needed]
    # Rows may repeat, and an offer without a skill plays no part.
    data += data[:50] + [("j999", "A", None)]
    frame = spark.createDataFrame(data, "job_id string, country string, skill_name string")
    profiles = {p: sorted(draw.sample([*skills, "unknown"], draw.randint(1, 5))) for p in range(25)}
    owned = spark.createDataFrame(list(profiles.items()), "profile_id int, skills array<string>")
    index = career.offer_bitmaps(frame)
    got = rows(career.hiring_countries(owned, index, 2), "profile_id", "rank", "country", "n_offers")
    wanted = []
    for profile, mine in profiles.items():
        counts = {c: sum(k == c and bool(set(n) & set(mine)) for _, k, n in offers) for c in "AB"}
        ranked = sorted(((-n, c) for c, n in counts.items() if n))
        wanted += [(profile, rank, c, -n) for rank, (n, c) in enumerate(ranked, 1)]
    assert sorted(got) == sorted(wanted)
