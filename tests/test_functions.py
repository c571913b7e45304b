"""Column functions on hand-worked values."""

import re

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offermarket.functions import (
    coerce_flag,
    compat_badge,
    derive_currency,
    detect_skills,
    extract_salary_request,
    flag_predicted_salary,
    format_salary,
    missing_to_null,
    money_text,
    normalize_country,
    parse_posted_date,
    percent_score,
    percent_text,
    report_grade,
    route_intent,
    skills_list,
    split_skill_list,
    strip,
    strip_think,
    tag_source,
)
from offermarket.vocabulary import DETECTED_SKILLS

MANY = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


def test_normalize_country(spark):
    for raw, name in [
        ("UK", "United Kingdom"),
        ("USA", "United States"),
        ("US", "United States"),
        ("UAE", "United Arab Emirates"),
        ("Deutschland", "Germany"),
        ("Nederland", "Netherlands"),
        ("Global", None),
        ("uk", "uk"),
        ("France", "France"),
        (None, None),
    ]:
        assert one(spark, normalize_country, raw) == name


def test_currency_and_flags(spark):
    assert one(spark, derive_currency, "gb") == "GBP"
    assert one(spark, derive_currency, "fr") == "USD"
    assert [one(spark, flag_predicted_salary, v) for v in ("1", "0", None)] == [True, False, False]
    assert [one(spark, coerce_flag, v) for v in ("True", "False", "x", None)] == [True, False, None, None]
    assert [one(spark, missing_to_null, v) for v in ("NA", "", "null", "0", None)] == [
        None, None, None, "0", None,
    ]


def test_posted_date_keeps_the_written_day(spark):
    written = "2026-07-01T23:30:00-05:00"
    assert str(one(spark, parse_posted_date, written)) == "2026-07-01"
    assert str(one(spark, parse_posted_date, "2026-07-01T00:30:00.123456Z")) == "2026-07-01"
    assert one(spark, parse_posted_date, None) is None
    assert one(spark, parse_posted_date, "") is None
    lenient = lambda c: parse_posted_date(c, strict=False)
    assert one(spark, lenient, "yesterday") is None
    assert one(spark, lenient, "2026-13-41T00:00:00Z") is None
    with pytest.raises(Exception, match="not an ISO timestamp"):
        one(spark, parse_posted_date, "yesterday")


def test_detect_skills(spark):
    for text, found in [
        ("R&D, python/SQL; GitHub; scikit-learn", ["Python", "SQL", "R", "Scikit-learn"]),
        ("éR MySQL JavaScript", []),
        ("POWER BI and dbt", ["Power BI", "dbt"]),
        ("Power  BI", []),
        ("", []),
        (None, []),
    ]:
        assert one(spark, detect_skills, text) == found


@MANY
@given(st.lists(st.text(alphabet="Rr é-_.SQLsql\nsK", max_size=25), min_size=1, max_size=40))
def test_detect_skills_like_word_search(spark, texts):
    expected = [
        [s for s in DETECTED_SKILLS if re.search(r"\b" + re.escape(s) + r"\b", t, re.IGNORECASE)]
        for t in texts
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", detect_skills(F.col("t")).alias("s")
    )
    assert [row.s for row in df.orderBy("i").collect()] == expected


def test_detect_skills_with_overlapping_entries(spark):
    words = ["data", "data science", "science", "c++"]
    found = one(spark, lambda c: detect_skills(c, words), "Data Science")
    assert found == ["data", "data science", "science"]
    assert one(spark, lambda c: detect_skills(c, ["data science"]), "no data") == []


def test_lists(spark):
    assert one(spark, split_skill_list, "Python | SQL|Python|") == ["Python", "SQL"]
    assert one(spark, split_skill_list, "\tA\xa0|a| |A") == ["A", "a"]
    assert one(spark, split_skill_list, None) == []
    assert one(spark, skills_list, "A, B,,C ,A") == ["A", "B", "C"]


@MANY
@given(st.lists(st.text(alphabet=" \t\n\xa0 　\x1cab|é", max_size=12), min_size=1, max_size=40))
def test_strip_like_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", strip(F.col("t")).alias("s")
    )
    assert [row.s for row in df.orderBy("i").collect()] == [t.strip() for t in texts]


def test_scores_round_ties_to_even(spark):
    df = spark.createDataFrame(
        [(1, 16), (3, 16), (2, 3), (1, 2), (0, 4), (5, 5), (1, 0)], "m long, r long"
    )
    got = [row[0] for row in df.select(percent_score(F.col("m"), F.col("r"))).collect()]
    assert got == [6.2, 18.8, 66.7, 50.0, 0.0, 100.0, 0.0]


def test_scores_like_float_rounding(spark):
    pairs = [(m, r) for r in range(1, 300) for m in range(0, r + 1)]
    df = spark.createDataFrame(pairs, "m long, r long").select(
        "m", "r", percent_score(F.col("m"), F.col("r")).alias("s")
    )
    for row in df.collect():
        assert row.s == round(row.m / row.r * 100, 1), row


def test_badges(spark):
    badge = lambda v: one(spark, compat_badge, v, "double")
    assert [badge(v) for v in (50.0, 49.9, 25.0, 24.9)] == [
        "🟢 Excellent", "🟡 Bon", "🟡 Bon", "🔴 Moyen",
    ]
    assert one(spark, report_grade, 50.0, "double") == "EXCELLENT"
    assert one(spark, percent_text, 33.3, "double") == "33.3%"
    assert one(spark, percent_text, 100.0, "double") == "100.0%"


def test_money(spark):
    assert one(spark, money_text, 1234.5, "double") == "$1,234"
    assert one(spark, money_text, None, "double") == "N/A"
    assert one(spark, money_text, 0.0, "double") == "N/A"
    assert one(spark, format_salary, 98765.4, "double") == "$98,765 USD/an"


def test_dialogue(spark):
    assert one(spark, strip_think, "a<think>x\ny</think>b<think>z</think> ") == "ab"
    request = one(
        spark,
        extract_salary_request,
        'ok <ML_PREDICT>{"skills":["SQL"],"years_of_experience":5}</ML_PREDICT>',
    )
    assert request.skills == ["SQL"] and request.years_of_experience == 5
    assert request.country is None
    assert one(spark, extract_salary_request, "<ML_PREDICT>oops</ML_PREDICT>") is None
    assert one(spark, extract_salary_request, "no tag") is None
    assert one(spark, extract_salary_request, None) is None
    assert one(spark, route_intent, "Combien vais-je gagner ?") == "ML"
    assert one(spark, route_intent, "PRÉDIRE mon avenir") == "ML"
    assert one(spark, route_intent, "Bonjour") == "GENERAL"
    assert one(spark, route_intent, None) == "GENERAL"
    tagged = one(spark, lambda c: tag_source(c, F.lit("ML")), "x")
    assert tagged == "x\n\n🤖 Source : Modèle Machine Learning"
