"""Market figures.

Every figure is counted on the key columns first and named afterwards: the
joins to the dimensions then see one row per key, whatever the number of offers
and however unevenly they are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermarket.functions.conforming import pick_label
from offermarket.functions.numbers import mean, share
from offermarket.vocabulary import (
    COMPANY_SIZE_LABELS,
    MARKET_SOURCE,
    MONTH_LABELS,
    REMOTE_LABELS,
    TREND_BASE_YEAR,
    TREND_YEARS,
)


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_offers"))


def _named_counts(counts: DataFrame, key: str, dimension: DataFrame, *others: str) -> DataFrame:
    """Counts per key as counts per name; names need not be unique."""
    names = dimension.select(F.col("id").alias(key), "name")
    return (
        counts.filter(F.col(key).isNotNull())
        .join(names, key)
        .groupBy("name", *others)
        .agg(F.sum("n_offers").alias("n_offers"))
    )


def _with_percent(counts: DataFrame) -> DataFrame:
    """Share of the total, taken from the counts and not from the offers."""
    total = counts.agg(F.sum("n_offers")).scalar()
    return counts.withColumn("percent", share(F.col("n_offers"), total))


def top_skills(job_skills: DataFrame, skills: DataFrame, n: int = 10) -> DataFrame:
    """The most demanded skills over all sources."""
    counts = _named_counts(_count(job_skills, "skill_id"), "skill_id", skills)
    return counts.orderBy(F.desc("n_offers"), "name").limit(n)


def salary_by_title(jobs: DataFrame, source: str = MARKET_SOURCE, n: int = 15) -> DataFrame:
    """Best paid titles of a source: mean salary and offers."""
    return (
        jobs.filter((F.col("source") == source) & F.col("salary_avg").isNotNull())
        .groupBy("job_title")
        .agg(F.sum("salary_avg").alias("_salaries"), F.count(F.lit(1)).alias("n_offers"))
        .select(
            "job_title",
            mean(F.col("_salaries"), F.col("n_offers")).alias("mean_salary"),
            "n_offers",
        )
        .orderBy(F.desc("mean_salary"), "job_title")
        .limit(n)
    )


def offers_by_country(jobs: DataFrame, countries: DataFrame) -> DataFrame:
    """Offers per country over all sources; offers without one are left out."""
    counts = _named_counts(_count(jobs, "country_id"), "country_id", countries)
    return counts.withColumnRenamed("name", "country").orderBy(F.desc("n_offers"), "country")


def remote_split(jobs: DataFrame, source: str = MARKET_SOURCE) -> DataFrame:
    """Remote-friendly offers against the others."""
    flagged = jobs.filter((F.col("source") == source) & F.col("is_remote_friendly").isNotNull())
    return _with_percent(_count(flagged, "is_remote_friendly")).withColumn(
        "label", pick_label(F.col("is_remote_friendly"), REMOTE_LABELS)
    )


def monthly_trend(jobs: DataFrame, source: str = MARKET_SOURCE) -> DataFrame:
    """Offers per posting month."""
    months = ["posting_year", "posting_month"]
    dated = jobs.filter(
        (F.col("source") == source)
        & F.col("posting_year").isNotNull()
        & F.col("posting_month").isNotNull()
    )
    return _count(dated, *months).orderBy(*months)


def trend_axis(
    trend: DataFrame, base_year: int = TREND_BASE_YEAR, years: list[int] = TREND_YEARS
) -> DataFrame:
    """The trend on one running month axis, restricted to the drawn years."""
    labels = F.array(*[F.lit(label) for label in MONTH_LABELS])
    return (
        trend.filter(F.col("posting_year").isin(years))
        .withColumn(
            "month_index",
            (F.col("posting_year") - F.lit(base_year)) * 12 + F.col("posting_month"),
        )
        .withColumn(
            "period",
            F.concat_ws(" ", F.get(labels, F.col("posting_month") - 1), F.col("posting_year")),
        )
        .orderBy("posting_year", "month_index")
    )


def skill_trend_by_year(
    job_skills: DataFrame, skills: DataFrame, jobs: DataFrame, source: str = MARKET_SOURCE
) -> DataFrame:
    """Offers of a source per skill and posting year."""
    dated = jobs.filter(
        (F.col("source") == source) & F.col("posting_year").isNotNull()
    ).select(F.col("id").alias("job_id"), "posting_year")
    counts = _count(job_skills.join(dated, "job_id"), "skill_id", "posting_year")
    named = _named_counts(counts, "skill_id", skills, "posting_year")
    return named.withColumnRenamed("name", "skill_name").orderBy(
        F.desc("n_offers"), "skill_name", "posting_year"
    )


def skill_trend_top(trend: DataFrame, top: DataFrame) -> DataFrame:
    """The yearly trend of the skills in ``top``."""
    names = top.select(F.col("name").alias("skill_name"))
    return trend.join(names, "skill_name", "left_semi")


def top_companies(jobs: DataFrame, companies: DataFrame, n: int = 15) -> DataFrame:
    """Company names with the most offers, countries taken together."""
    counts = _named_counts(_count(jobs, "company_id"), "company_id", companies)
    return counts.orderBy(F.desc("n_offers"), "name").limit(n)


def company_size_split(jobs: DataFrame) -> DataFrame:
    """Offers per company size, with long labels for the known codes."""
    sized = jobs.filter(F.col("company_size").isNotNull())
    label = F.coalesce(pick_label(F.col("company_size"), COMPANY_SIZE_LABELS), F.col("company_size"))
    return (
        _with_percent(_count(sized, "company_size"))
        .withColumn("label", label)
        .orderBy(F.desc("n_offers"), "company_size")
    )


def salary_by_title_in_country(
    jobs: DataFrame,
    countries: DataFrame,
    source: str = MARKET_SOURCE,
    country: str | None = None,
    n: int = 15,
) -> DataFrame:
    """Best paid titles, in one country or in all."""
    priced = jobs.filter((F.col("source") == source) & F.col("salary_avg").isNotNull())
    if country is None:
        sums = priced.groupBy("job_title")
    else:
        named = countries.filter(F.col("name") == F.lit(country)).select(
            F.col("id").alias("country_id")
        )
        # Count per country key first: the join then sees titles, not offers.
        keyed = priced.groupBy("country_id", "job_title").agg(
            F.sum("salary_avg").alias("salary_avg"), F.count(F.lit(1)).alias("_rows")
        )
        sums = keyed.join(named, "country_id").groupBy("job_title")
    rows = F.sum("_rows") if country is not None else F.count(F.lit(1))
    return (
        sums.agg(mean(F.sum("salary_avg"), rows).alias("mean_salary"))
        .orderBy(F.desc("mean_salary"), "job_title")
        .limit(n)
        .withColumn("mean_salary", F.bround("mean_salary", 0))
    )


def skill_year_compare(trend: DataFrame, years: list[int] = TREND_YEARS) -> DataFrame:
    """Offers per skill, one column per year; 0 where a year has none."""
    wide = (
        trend.filter(F.col("posting_year").isin(years))
        .groupBy("skill_name")
        .pivot("posting_year", years)
        .agg(F.sum("n_offers"))
    )
    return wide.select(
        "skill_name",
        *[F.coalesce(F.col(str(year)), F.lit(0)).alias(f"offers_{year}") for year in years],
    )
