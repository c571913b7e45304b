"""The hand-worked market load with its matches and plans."""

import pytest
from conftest import rows
from fixtures import write_market_csv
from pyspark.sql import functions as F

from offermarket.operators import career, market, matching, quality, skills, views
from offermarket.plans import advising
from offermarket.plans.loading import Warehouse, load_market, seed_warehouse
from offermarket.sources.feeds import read_market_csv
from offermarket.sources.profiling import first_rows, profile_source
from offermarket.vocabulary import ALL_COUNTRIES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("market"))


@pytest.fixture(scope="module")
def loaded(spark, folder):
    warehouse = Warehouse(spark, folder + "/warehouse")
    known = spark.createDataFrame(
        [("1", "FR", "France", "Europe"), ("2", "DE", "Germany", "Europe"), ("3", None, "France", None)],
        "id string, code string, name string, continent string",
    )
    warehouse.put("countries", known, "start")
    warehouse.publish("start")
    report = load_market(warehouse, write_market_csv(folder), "one")
    return warehouse, dict(rows(report))


@pytest.fixture(scope="module")
def tables(loaded):
    return loaded[0].tables()


@pytest.fixture(scope="module")
def offer_rows(tables):
    return views.offer_skill_rows(
        tables["jobs"], tables["job_skills"], tables["skills"], tables["countries"].limit(2)
    ).persist()


@pytest.fixture(scope="module")
def profile(spark):
    return spark.createDataFrame(
        [
            (1, ["Python", "SQL", "Python"], None),
            (2, ["SQL", "Python"], "France"),
            (3, [], None),
            (4, ["Cobol"], None),
            (5, ["Python", "SQL"], None),
        ],
        "profile_id long, skills array<string>, target_country string",
    )


def test_read(spark, folder, loaded):
    df = read_market_csv(spark, folder + "/market.csv")
    assert df.count() == 8
    by_row = df.orderBy("arrival").select("job_id", "annual_salary_usd", "industry").collect()
    assert [row.job_id for row in by_row] == ["m1", "m2", "m3", "m4", "m5", "m6", "m1", "m7"]
    assert by_row[7].annual_salary_usd is None
    assert by_row[0].industry == 'Fi"nance, x'
    profiled = {row.column: row for row in profile_source(df.drop("arrival", "_corrupt_record")).collect()}
    assert profiled["annual_salary_usd"].n_null == 1 and profiled["job_id"].n_rows == 8
    assert first_rows(df).count() == 3


def test_report(loaded):
    assert loaded[1] == {
        "read": 8,
        "accepted": 6,
        "rejected": 2,
        "inserted": 5,
        "duplicate": 1,
        "job_skills inserted": 12,
        "corrupt": 0,
    }


def test_loading_again_adds_nothing(spark, folder, loaded):
    warehouse = loaded[0]
    before = rows(quality.table_counts(warehouse.tables()))
    report = dict(rows(load_market(warehouse, folder + "/market.csv", "two")))
    assert report["inserted"] == 0 and report["job_skills inserted"] == 0
    assert rows(quality.table_counts(warehouse.tables())) == before
    # The same load once more is the one that is stored.
    again = dict(rows(load_market(warehouse, folder + "/market.csv", "one")))
    assert again["inserted"] == 5
    assert rows(quality.table_counts(warehouse.tables())) == before


def test_stored_rows_keep_the_rules(tables):
    broken = quality.check_constraints(tables).filter("n_violations > 0")
    assert rows(broken, "rule", "table") == []


def test_offers(tables):
    jobs = tables["jobs"]
    assert rows(jobs, "external_id", "country_id") == [
        ("m1", "1"), ("m2", "1"), ("m3", "2"), ("m4", None), ("m7", "1"),
    ]
    first = jobs.filter("external_id = 'm1'").first()
    assert first.salary_avg == 50000 and first.salary_currency == "USD"
    assert first.salary_is_predicted is False and first.is_remote_friendly is True
    assert first.created_at is not None and first.employment_type is None


def test_skills_of_offers(tables):
    assert tables["job_skills"].count() == 12
    assert rows(market.top_skills(tables["job_skills"], tables["skills"], 2)) == [
        ("Python", 4), ("SQL", 2),
    ]
    assert skills.offers_with_raw_skills(tables["jobs"]).count() == 5


def test_summaries(tables):
    priced = views.priced_offers(tables["jobs"], tables["countries"].limit(2))
    assert rows(views.title_summary(priced)) == [
        ("Data Analyst", 2, 60000.0), ("Data Engineer", 1, 90000.0), ("ML Engineer", 1, 120000.0),
    ]
    assert rows(views.country_summary(priced)) == [("France", 2, 60000.0), ("Germany", 1, 90000.0)]
    split = market.remote_split(tables["jobs"])
    assert rows(split, "label", "n_offers") == [("Non Remote", 4), ("Remote Friendly", 1)]
    assert split.agg(F.sum("percent")).first()[0] == pytest.approx(100)
    assert rows(market.trend_axis(market.monthly_trend(tables["jobs"])), "period", "month_index") == [
        ("Mar 2025", 3)
    ]
    assert rows(market.company_size_split(tables["jobs"]), "label") == [("Startup (1-50)",)]


def test_country_name_with_a_quote(spark, tables):
    countries = spark.createDataFrame(
        [("1", "X", "Côte d'Ivoire", None)], "id string, code string, name string, continent string"
    )
    got = market.salary_by_title_in_country(tables["jobs"], countries, country="Côte d'Ivoire")
    assert rows(got) == [("Data Analyst", 60000.0)]


def test_titles(offer_rows):
    needed = matching.title_requirements(offer_rows).filter(F.col("scope") == ALL_COUNTRIES)
    assert rows(needed, "job_title", "required") == [
        ("Data Analyst", ["Excel", "Python", "R", "SQL", "Tableau"]),
        ("Data Engineer", ["Airflow", "Python", "Spark"]),
        ("ML Engineer", ["PyTorch", "Python"]),
    ]
    salary = matching.title_salary(offer_rows).filter(F.col("scope") == ALL_COUNTRIES)
    assert rows(salary, "job_title", F.round("mean_salary", 2)) == [
        ("Data Analyst", 63333.33), ("Data Engineer", 90000.0), ("ML Engineer", 120000.0),
    ]


def test_matches(offer_rows, profile):
    found = advising.match_profiles(profile, offer_rows).persist()
    everywhere = [
        (1, "ML Engineer", 50.0), (2, "Data Analyst", 40.0), (3, "Data Engineer", 33.3),
    ]
    assert rows(found.filter("profile_id = 1"), "rank", "job_title", "score") == everywhere
    assert rows(found.filter("profile_id = 5"), "rank", "job_title", "score") == everywhere
    assert rows(found.filter("profile_id = 2"), "rank", "job_title", "score") == [
        (1, "Data Engineer", 50.0), (2, "Data Analyst", 40.0),
    ]
    assert found.filter("profile_id in (3, 4)").count() == 0
    gap = found.filter("profile_id = 1 and job_title = 'Data Analyst'").first()
    assert gap.matched == ["Python", "SQL"] and gap.missing == ["Excel", "R", "Tableau"]
    best = rows(matching.best_title(found), "profile_id", "salary")
    assert best == [(1, "$120,000"), (2, "N/A"), (5, "$120,000")]
    recap = matching.recap_table(found, 1).filter("profile_id = 1").first()
    assert (recap.score, recap.level, recap.missing) == ("50.0%", "🟢 Excellent", "PyTorch")
    report = matching.profile_report(found, profile).filter("profile_id = 2").first()
    assert [t.grade for t in report.titles] == ["EXCELLENT", "BON"]
    assert report.best.matched == "Python" and report.target_country == "France"
    both = found.filter(
        F.array_sort(F.concat("matched", "missing")) != F.col("required")
    )
    assert both.count() == 0


def test_many_profiles_equal_single_runs(offer_rows, profile):
    together = rows(advising.match_profiles(profile, offer_rows), "profile_id", "job_title", "score")
    single = []
    for number in (1, 2, 5):
        one = profile.filter(F.col("profile_id") == number)
        single += rows(advising.match_profiles(one, offer_rows), "profile_id", "job_title", "score")
    assert sorted(single, key=repr) == together


def test_dice(offer_rows, profile):
    scored = matching.coverage_score(
        matching.valid_profiles(profile), matching.title_requirements(offer_rows), "dice"
    )
    assert rows(scored.filter("profile_id = 1"), "job_title", "score") == [
        ("Data Analyst", 57.1), ("Data Engineer", 40.0), ("ML Engineer", 50.0),
    ]


def test_plan(offer_rows, profile):
    plan = advising.CareerPlan(profile, offer_rows)
    assert rows(plan.priority_skills().filter("profile_id = 1"), "rank", "skill_name", "n_offers") == [
        (i + 1, name, 1)
        for i, name in enumerate(["Airflow", "Excel", "PyTorch", "R", "Spark", "Tableau"])
    ]
    assert rows(plan.hiring_countries().filter("profile_id = 5"), "country", "n_offers") == [
        ("France", 3), ("Germany", 1),
    ]
    impact = plan.salary_impact().filter("profile_id = 1")
    assert rows(impact, "rank", "skill_name", "mean_salary") == [
        (1, "PyTorch", 120000.0),
        (2, "Spark", 90000.0),
        (3, "Excel", 70000.0),
        (4, "R", 70000.0),
        (5, "Tableau", 70000.0),
    ]


def test_priority_skips_owned_ranks(spark):
    demand = spark.createDataFrame(
        [(f"s{i:02d}", 100 - i) for i in range(30)], "skill_name string, n_offers long"
    )
    profiles = spark.createDataFrame(
        [(1, ["s00", "s02", "none"]), (2, [f"s{i:02d}" for i in range(28)]), (3, ["s29"])],
        "profile_id long, skills array<string>",
    )
    got = rows(career.priority_skills(profiles, demand, 3), "profile_id", "rank", "skill_name")
    assert got == [
        (1, 1, "s01"), (1, 2, "s03"), (1, 3, "s04"),
        (2, 1, "s28"), (2, 2, "s29"),
        (3, 1, "s00"), (3, 2, "s01"), (3, 3, "s02"),
    ]


def test_seeds(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    seed_warehouse(warehouse)
    seed_warehouse(warehouse, "again")
    assert warehouse.table("countries").count() == 14
    assert warehouse.table("skills").count() == 27
    assert views.skills_listing(warehouse.table("skills")).count() == 27
    options = views.profile_options(warehouse.table("skills"), warehouse.table("countries"))
    assert options.filter("kind = 'country'").first().value == ALL_COUNTRIES


def test_kpis(tables):
    values = dict(rows(views.headline_kpis(tables)))
    assert values == {
        "total offers": 5, "priced offers": 4, "titles": 3,
        "skills": 8, "countries": 2, "companies": 0,
    }


def test_headers_in_any_order_and_line_breaks_in_quotes(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "a.csv").write_text('job_id,job_title,country,city\nm1,Data Analyst,France,"New\nYork"\nm2,"ML, Engineer",France,Lyon\n')
    (folder / "b.csv").write_text("city,country,job_title,job_id\nParis,France,Data Engineer,m3\n")
    (folder / "c.csv").write_text("job_id,job_title,country,city\nm4,Data Analyst\nm5,Data Analyst,France,Nice,too,many\nm6,Data Analyst,France,Nice\n")
    (folder / "d.csv").write_text(",job_id,job_id,country,job_title\nx,m7,y,France,Data Analyst\n")
    df = read_market_csv(spark, str(folder))
    assert rows(df.filter("_corrupt_record is null"), "job_id", "job_title", "country", "city") == [
        ("m1", "Data Analyst", "France", "New\nYork"),
        ("m2", "ML, Engineer", "France", "Lyon"),
        ("m3", "Data Engineer", "France", "Paris"),
        ("m6", "Data Analyst", "France", "Nice"),
        ("m7", "Data Analyst", "France", None),
    ]
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    known = spark.createDataFrame([("1", "FR", "France", "Europe")], "id string, code string, name string, continent string")
    warehouse.put("countries", known, "start")
    warehouse.publish("start")
    report = dict(rows(load_market(warehouse, str(folder), "one")))
    assert (report["read"], report["corrupt"], report["rejected"], report["inserted"]) == (7, 2, 2, 5)


def test_written_reports(spark, profile, offer_rows, tmp_path):
    found = advising.match_profiles(profile, offer_rows).persist()
    path = str(tmp_path / "reports")
    advising.write_reports(found, profile, path)
    advising.write_reports(found, profile, path)
    wanted = matching.profile_report(found, profile)
    written = spark.read.schema(wanted.schema).json(path)
    assert rows(written, "profile_id", "skills", "titles") == rows(wanted, "profile_id", "skills", "titles")
    assert written.count() > 0
