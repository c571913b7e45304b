"""What the physical plans must and must not hold."""

import contextlib
import io

import pytest

from __spark_entry__ import queries


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize(
    "name",
    [
        "top_skills", "salary_by_title", "offers_by_country", "remote_split", "headline_kpis",
        "skill_trend_top", "title_requirements", "match_profiles", "priority_skills",
        "hiring_countries", "skill_salary_impact", "bucket_rare", "training_extract",
        "first_wins", "insert_if_absent", "context_window", "append_turns", "detect_skills",
    ],
)
def test_no_cross_joins_and_no_python(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert word not in text


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(queries()["monthly_trend"](spark, sf_dir))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert schemas and all("o_totalprice" not in line and "c_name" not in line for line in schemas)


def test_filters_reach_the_scan(spark, tmp_path):
    from offermarket.operators import market
    from offermarket.plans.loading import Warehouse
    from offermarket.operators.conform import apply_defaults
    from offermarket.vocabulary import API_SOURCE, MARKET_SOURCE

    jobs = spark.createDataFrame(
        [("1", MARKET_SOURCE, "a"), ("2", API_SOURCE, "b")], "id string, source string, job_title string"
    )
    warehouse = Warehouse(spark, str(tmp_path))
    warehouse.put("jobs", apply_defaults(jobs), "x")
    warehouse.publish("x")
    text = plan(market.salary_by_title(warehouse.table("jobs")))
    assert "PartitionFilters: [isnotnull(source" in text
    assert "IsNotNull(salary_avg)" in text
    assert "ReadSchema: struct<job_title:string,salary_avg:decimal(12,2)>" in text


def test_scoring_shuffles_profiles_only(spark, sf_dir):
    """With requirements broadcast, pairs are counted and ranked in place."""
    text = plan(queries()["recommend_titles"](spark, sf_dir))
    tree = text.split("== Physical Plan ==")[1].split("\n\n")[0]
    above = tree.split("BroadcastHashJoin")[0]
    assert "Window" in above and "Exchange" not in above


def test_hot_skills_are_split_without_the_session_s_help(spark, sf_dir):
    """With broadcasts and adaptive execution off, popular skills still meet their names in parts."""
    from offermarket.bindings.tables import Market

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        m = Market(spark, sf_dir)
        for frame in (m.rows, queries()["training_extract"](spark, sf_dir)):
            text = plan(frame)
            assert "hashpartitioning(skill_id" in text and "_salt" in text
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_ranking_and_counting_leave_no_single_task(spark, sf_dir):
    """Demand is ranked by ranges, and counted offers are ORed and ranked where the profile is."""
    assert "Exchange SinglePartition" not in plan(queries()["priority_skills"](spark, sf_dir))
    tree = plan(queries()["hiring_countries"](spark, sf_dir)).split("== Physical Plan ==")[1].split("\n\n")[0]
    above = tree.split("BroadcastHashJoin")[0]
    assert "Window" in above and "Exchange" not in above and "SortAggregate" not in above
