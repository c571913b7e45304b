"""Serving views and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermarket.functions.numbers import mean_of
from offermarket.skew import sized_join
from offermarket.vocabulary import ALL_COUNTRIES, MARKET_SOURCE, UNCATEGORISED


def _named_countries(countries: DataFrame) -> DataFrame:
    return countries.select(F.col("id").alias("country_id"), F.col("name").alias("country"))


def skills_catalog(skills: DataFrame) -> DataFrame:
    """All skills by name."""
    return skills.select("id", "name", "category").orderBy("name", "id")


def priced_offers(
    jobs: DataFrame, countries: DataFrame, source: str = MARKET_SOURCE
) -> DataFrame:
    """Offers of a source that state a salary, with their country's name."""
    return (
        jobs.filter((F.col("source") == source) & F.col("salary_avg").isNotNull())
        .join(_named_countries(countries), "country_id", "left")
        .select(
            "id",
            "job_title",
            "job_category",
            "experience_level",
            "salary_avg",
            "company_size",
            "is_remote_friendly",
            "country",
        )
    )


def offer_skill_rows(
    jobs: DataFrame,
    job_skills: DataFrame,
    skills: DataFrame,
    countries: DataFrame,
    source: str = MARKET_SOURCE,
) -> DataFrame:
    """One row per offer of a source and skill it needs; the salary may be NULL."""
    offers = (
        jobs.filter(F.col("source") == source)
        .join(_named_countries(countries), "country_id", "left")
        .select(
            F.col("id").alias("job_id"), "job_title", "experience_level", "salary_avg", "country"
        )
    )
    # One skill may be asked for by most offers; the skills themselves are few, and broadcast where they are.
    named = sized_join(
        job_skills,
        skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill_name")),
        ["skill_id"],
        spread_by=["job_id"],
        always=False,
    ).select("job_id", "skill_name")
    return offers.join(named, "job_id")


def country_names(countries: DataFrame) -> DataFrame:
    """Distinct country names in order."""
    return countries.select("name").distinct().orderBy("name")


def offers_listing(priced: DataFrame) -> DataFrame:
    """Distinct title, country, salary and experience; best paid first."""
    columns = ["job_title", "country", "salary_avg", "experience_level"]
    return (
        priced.select(*columns)
        .distinct()
        .orderBy(F.desc("salary_avg"), "job_title", "country", "experience_level")
    )


def skills_listing(skills: DataFrame) -> DataFrame:
    """Distinct skills by category; a missing text reads "uncategorised"."""
    return (
        skills.select("name", "category")
        .fillna(UNCATEGORISED)
        .distinct()
        .orderBy("category", "name")
    )


def _summary(priced: DataFrame, key: str) -> DataFrame:
    return (
        priced.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_offers"), mean_of(F.col("salary_avg")).alias("mean_salary"))
        .withColumn("mean_salary", F.bround("mean_salary", 0))
        .orderBy(F.desc("n_offers"), key)
    )


def title_summary(priced: DataFrame) -> DataFrame:
    """Offers and mean salary per title."""
    return _summary(priced, "job_title")


def country_summary(priced: DataFrame) -> DataFrame:
    """Offers and mean salary per country; offers without one are left out."""
    return _summary(priced, "country")


def headline_kpis(tables: dict[str, DataFrame], source: str = MARKET_SOURCE) -> DataFrame:
    """``(metric, value)``: the figures on top of the pages.

    ``companies`` counts the names that have offers. One pass over the offers
    gives all figures taken from them; the company keys are reduced to distinct
    ones before they meet the company table.
    """
    jobs = tables["jobs"]
    priced = (F.col("source") == source) & F.col("salary_avg").isNotNull()
    per_title = jobs.groupBy("job_title").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(priced).alias("n_priced")
    )
    offers = per_title.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total offers"),
        F.coalesce(F.sum("n_priced"), F.lit(0)).alias("priced offers"),
        F.count_if((F.col("n_priced") > 0) & F.col("job_title").isNotNull()).alias("titles"),
    )
    hiring = (
        jobs.select(F.col("company_id").alias("id"))
        .filter(F.col("id").isNotNull())
        .distinct()
        .join(tables["companies"].select("id", "name"), "id")
    )
    parts = [
        offers.unpivot([], ["total offers", "priced offers", "titles"], "metric", "value"),
        tables["skills"].agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("skills")),
        tables["countries"]
        .agg(F.countDistinct("name").alias("value"))
        .withColumn("metric", F.lit("countries")),
        hiring.agg(F.countDistinct("name").alias("value")).withColumn("metric", F.lit("companies")),
    ]
    return reduce(DataFrame.unionByName, [part.select("metric", "value") for part in parts])


def profile_options(skills: DataFrame, countries: DataFrame) -> DataFrame:
    """``(kind, value)`` a profile can choose from; "all countries" included."""
    named = skills.select(F.lit("skill").alias("kind"), F.col("name").alias("value"))
    places = countries.select(F.lit("country").alias("kind"), F.col("name").alias("value"))
    everywhere = countries.sparkSession.createDataFrame(
        [("country", ALL_COUNTRIES)], "kind string, value string"
    )
    options = named.unionByName(places).filter(F.col("value").isNotNull()).distinct()
    return options.unionByName(everywhere).orderBy(
        F.desc("kind"), (F.col("value") != ALL_COUNTRIES), "value"
    )
