"""Skills travel as numbers while profiles are matched; lists of names are made last."""

import random
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from offermarket.operators import matching
from offermarket.plans import advising
from offermarket.staging import stage
from offermarket.vocabulary import ALL_COUNTRIES

PROFILE = "profile_id int, skills array<string>, target_country string, experience string, min_salary double"


@pytest.fixture(scope="module")
def market(spark):
    """Offers of countries, one of which bears the name of the scope of all, and of none; titles and skills can be NULL."""
    draw = random.Random(3)
    skills = [*(f"s{i}" for i in range(30)), "É", "a,b", None]
    places = ["A", "B", ALL_COUNTRIES, None]
    offers = []
    for job in range(120):
        place, title, salary = draw.choice(places), draw.choice(["t1", "t2", "t3", "t4", None]), draw.choice([None, Decimal(draw.randint(1, 900))])
        offers += [(f"j{job}", title, salary, place, skill) for skill in draw.sample(skills, draw.randint(1, 4))]
    owned = [(p, draw.sample([*skills, "x", "y"], draw.randint(0, 6)), draw.choice(["A", "B", "C", None]), "e", 1.0) for p in range(40)]
    offers = spark.createDataFrame(offers, "job_id string, job_title string, salary_avg decimal(12,2), country string, skill_name string")
    return stage(spark.createDataFrame(owned, PROFILE), "profiles"), stage(offers, "offers")


def by_names(profiles, offers):
    """The same by lists of names."""
    facts = stage(matching.title_facts(offers), "facts")
    valid = stage(matching.valid_profiles(profiles), "valid")
    best = matching.coverage_score(valid, facts, n=10)
    return best.join(valid.select("profile_id", "skills").distinct(), "profile_id").join(facts, ["scope", "job_title"])


def test_gaps_by_numbers_are_those_by_names(market):
    columns = ["profile_id", "rank", "scope", "job_title", "score", "n_matched", "n_required", "mean_salary", "required", "matched", "missing"]
    got = rows(advising.match_profiles(*market), *columns)
    assert got == rows(matching.skill_gap(by_names(*market)), *columns) and len(got) > 50


def test_titles_of_a_scope(market):
    """Each country's titles, and those of all countries together, from plain sums."""
    _, offers = market
    wanted = {}
    for r in offers.filter("job_title is not null and skill_name is not null").collect():
        for scope in {r.country, ALL_COUNTRIES} - {None}:
            skills, paid = wanted.setdefault((scope, r.job_title), (set(), []))
            skills.add(r.skill_name)
            paid += [r.salary_avg] if r.salary_avg is not None else []
    got = {(r.scope, r.job_title): r for r in matching.title_facts(offers).collect()}
    assert set(got) == set(wanted)
    for key, (skills, paid) in wanted.items():
        assert got[key].required == sorted(skills)
        assert float(got[key].mean_salary) == pytest.approx(float(sum(paid) / len(paid))) if paid else got[key].mean_salary is None


def test_reports_make_lists_last(spark, market):
    """Lists of a report are made above all shuffles, of names they are nowhere shuffled or sorted."""
    profiles, offers = market
    matches = advising.Matches.of(profiles, offers)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = matching.profile_report(matches.best, profiles, matches.with_gap)
        plan = report._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan.split("Exchange hashpartitioning")[0]
    assert "Exchange hashpartitioning" in plan and "array_except" in above and "array_except" not in plan[len(above):]
    assert "SortAggregate" not in plan
    whole = matching.profile_report(matches.with_gap(matches.best), profiles)
    columns = ["profile_id", "skills", "target_country", "titles", "best"]
    assert report.columns == whole.columns == columns
    assert rows(report, *columns) == rows(whole, *columns) and report.count() > 20


def test_profiles_that_share_an_id(market):
    """Their first titles are compared, as without numbers."""
    profiles, offers = market
    twice = profiles.unionByName(profiles.filter("profile_id < 20").withColumn("target_country", F.lit("A")))
    twice = stage(twice.withColumn("profile_id", F.when(F.col("profile_id") != 9, F.col("profile_id"))), "twice")
    matches = advising.Matches.of(twice, offers)
    got = matching.profile_report(matches.best, twice, matches.with_gap)
    wanted = matching.profile_report(matches.with_gap(matches.best), twice)
    assert rows(got) == rows(wanted) and got.count() > got.select("profile_id").distinct().count() > 20
