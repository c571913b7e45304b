"""Matching and hiring countries where a lookup is too large to be broadcast whole."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from offermarket.operators import career, matching
from offermarket.staging import stage

SETS = "scope string, job_title string, required array<string>"
OWNED = "profile_id int, scope string, skills array<string>"


def market(spark):
    draw = random.Random(5)
    skills = [f"s{i}" for i in range(20)]
    asked = [(draw.choice("AB"), f"t{i:02d}", sorted(draw.sample(skills, draw.randint(1, 9)))) for i in range(50)]
    owned = [(p, draw.choice("ABC"), sorted(draw.sample([*skills, "x"], draw.randint(1, 6)))) for p in range(40)]
    return asked, owned, spark.createDataFrame(asked, SETS), spark.createDataFrame(owned, OWNED)


@pytest.mark.parametrize("bound", [1 << 27, 6000])
def test_all_titles_are_scored(spark, monkeypatch, bound):
    """Without a number of titles every title that shares a skill comes out, whole or in parts."""
    monkeypatch.setattr(matching, "BROADCAST_BYTES", bound)
    asked, owned, needed, profiles = market(spark)
    wanted = [
        (p, scope, title, len(set(mine) & set(required)), len(required))
        for p, scope, mine in owned
        for place, title, required in asked
        if place == scope and set(mine) & set(required)
    ]
    got = matching.coverage_score(profiles, needed)
    assert rows(got, "profile_id", "scope", "job_title", "n_matched", "n_required") == sorted(wanted, key=repr)
    assert max(sum(w[0] == p for w in wanted) for p, _, _ in owned) > 10


def test_best_titles_in_parts(spark, monkeypatch):
    _, _, needed, profiles = market(spark)
    columns = ["profile_id", "rank", "job_title", "score"]
    whole = rows(matching.coverage_score(profiles, needed, n=3), *columns)
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 6000)
    assert rows(matching.coverage_score(profiles, needed, n=3), *columns) == whole


def test_large_title_facts_are_not_broadcast(spark, monkeypatch):
    """Lists of skills are measured; small files of them are no reason for a broadcast."""
    _, owned, needed, profiles = market(spark)
    facts = needed.withColumn("mean_salary", F.lit(1.0))
    best = matching.coverage_score(profiles, needed, n=2).join(profiles.select("profile_id", "skills"), "profile_id")
    best = stage(best, "best-titles")
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 8)
    asked = matching.with_title_facts(best, facts)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [scope" in plan
    mine = {p: set(skills) for p, _, skills in owned}
    found = matching.skill_gap(asked).collect()
    assert len(found) == best.count() > 0
    assert all(r.matched == sorted(set(r.required) & mine[r.profile_id]) for r in found)
    assert all(r.missing == sorted(set(r.required) - mine[r.profile_id]) for r in found)


def test_countries_in_parts(spark, monkeypatch):
    """A country whose blocks lie in several parts is counted whole."""
    monkeypatch.setattr(career, "WORDS", 1)
    monkeypatch.setattr(career, "SPAN", 1)
    draw = random.Random(2)
    skills = [f"s{i}" for i in range(12)]
    offers = [(f"j{i}", draw.choice("AAAB"), draw.sample(skills, draw.randint(1, 4))) for i in range(400)]
    frame = spark.createDataFrame([(j, c, s) for j, c, own in offers for s in own], "job_id string, country string, skill_name string")
    profiles = {p: sorted(draw.sample([*skills, "unknown"], draw.randint(1, 5))) for p in range(25)}
    owned = spark.createDataFrame(list(profiles.items()), "profile_id int, skills array<string>")
    index = career.offer_bitmaps(frame)
    monkeypatch.setattr(career, "BROADCAST_BYTES", 2 * career.measured_bytes(index) // 3)
    assert len(career._index_parts(index)) > 2
    wanted = []
    for profile, mine in profiles.items():
        counts = {c: sum(k == c and bool(set(n) & set(mine)) for _, k, n in offers) for c in "AB"}
        ranked = sorted((-n, c) for c, n in counts.items() if n)
        wanted += [(profile, rank, c, -n) for rank, (n, c) in enumerate(ranked, 1)]
    got = rows(career.hiring_countries(owned, index, 2), "profile_id", "rank", "country", "n_offers")
    assert sorted(got) == sorted(wanted)
