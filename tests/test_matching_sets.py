"""The best titles by requirement sets, against every profile and title."""

import random

import pytest
from conftest import rows

from offermarket.operators import matching


def score(mine, needed, method):
    shared = len(mine & needed)
    return round(100 * (shared / len(needed) if method == "coverage" else 2 * shared / (len(mine) + len(needed))), 1)


@pytest.mark.parametrize("method", ["coverage", "dice"])
@pytest.mark.parametrize("limit", [1 << 27, 0])
def test_best_titles(spark, monkeypatch, method, limit):
    """Many titles ask for the same skills, so ties by name decide; with limit 0 nothing is broadcast."""
    monkeypatch.setattr(matching.sized_join, "__defaults__", (limit,))
    draw = random.Random(8)
    skills = [f"s{i}" for i in range(9)]
    sets = [sorted(draw.sample(skills, draw.choice([1, 2, 4, 5]))) for _ in range(6)]
    needed = [(draw.choice(["A", "B"]), f"t{i:02d}", draw.choice(sets)) for i in range(60)]
    profiles = [(p, draw.choice(["A", "B", "C"]), sorted(draw.sample([*skills, "x"], draw.randint(1, 6)))) for p in range(40)]
    asked = spark.createDataFrame(needed, "scope string, job_title string, required array<string>")
    owned = spark.createDataFrame(profiles, "profile_id int, scope string, skills array<string>")
    for n in (3, 10):
        wanted = []
        for profile, scope, mine in profiles:
            scored = sorted(
                (-score(set(mine), set(required), method), title)
                for place, title, required in needed
                if place == scope and set(mine) & set(required)
            )
            wanted += [(profile, rank, title, -s) for rank, (s, title) in enumerate(scored[:n], 1)]
        got = matching.coverage_score(owned, asked, method, n)
        assert sorted(rows(got, "profile_id", "rank", "job_title", "score")) == sorted(wanted)


def test_only_the_first_titles_of_a_set_are_kept(spark):
    asked = spark.createDataFrame([("A", f"t{i:03d}", ["x"]) for i in range(300)], "scope string, job_title string, required array<string>")
    row = matching.requirement_sets(asked, 4).first()
    assert row.titles == ["t000", "t001", "t002", "t003"] and row.set == 1
