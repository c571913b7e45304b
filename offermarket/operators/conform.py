"""From raw feed rows to rows of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermarket.functions.conforming import (
    derive_currency,
    flag_predicted_salary,
    normalize_country,
    parse_posted_date,
)
from offermarket.schemas import ARRIVAL, COMPANIES, COUNTRIES, JOBS, MONEY, SKILLS, TABLES
from offermarket.skew import any_null, hot_join
from offermarket.vocabulary import API_SOURCE, COUNTRY_ALIASES, MARKET_SOURCE


def assign_keys(
    df: DataFrame,
    natural_key: list[str],
    id_col: str = "id",
    load_id: str | None = None,
    position: str = ARRIVAL,
) -> DataFrame:
    """Surrogate key: 128-bit digest of the natural key, equal on every run.

    A row without a natural key (a NULL in it) is told apart by all its columns,
    its position in the landing and the load, else a second load of the same
    rows would reuse the first one's keys.
    """
    digest = F.md5(F.to_json(F.struct(*natural_key)))
    if load_id is None:
        return df.withColumn(id_col, digest)
    own = [name for name in df.columns if name not in (id_col, position)]
    parts = [F.struct(*own).alias("row"), F.lit(load_id).alias("load")]
    if position in df.columns:
        parts.append(F.col(position).alias("position"))
    alone = F.md5(F.to_json(F.struct(*parts)))
    return df.withColumn(id_col, F.when(any_null(natural_key), alone).otherwise(digest))


def unique_countries(countries: DataFrame) -> DataFrame:
    """One key per country name; the stored name is not unique."""
    return countries.groupBy(F.col("name").alias("country_name")).agg(
        F.min("id").alias("country_id")
    )


def _with_country_id(df: DataFrame, countries: DataFrame, name: Column) -> DataFrame:
    return df.withColumn("country_name", name).join(
        unique_countries(countries), "country_name", "left"
    )


def split_known_country(
    df: DataFrame, countries: DataFrame, aliases: dict[str, str | None] = COUNTRY_ALIASES
) -> tuple[DataFrame, DataFrame]:
    """Market rows whose country is usable, and the rejected ones.

    A country absent from the dimension is rejected, and so is a missing one.
    An alias for "no single country" is accepted without a country.
    """
    joined = _with_country_id(df, countries, normalize_country(F.col("country"), aliases))
    accepted = F.col("country").isNotNull() & (
        F.col("country_name").isNull() | F.col("country_id").isNotNull()
    )
    return joined.filter(accepted), joined.filter(~accepted)


def offer_country(aliases: dict[str, str | None] = COUNTRY_ALIASES) -> Column:
    """Canonical country of an API offer: its first area; NULL when empty."""
    name = normalize_country(F.get(F.col("location.area"), F.lit(0)), aliases)
    return F.when(name != "", name)


def add_missing_countries(
    offers: DataFrame,
    countries: DataFrame,
    aliases: dict[str, str | None] = COUNTRY_ALIASES,
) -> DataFrame:
    """Countries of API offers the dimension lacks, by name only."""
    named = (
        offers.select(offer_country(aliases).alias("name"))
        .filter(F.col("name").isNotNull())
        .distinct()
        .join(countries.select("name"), "name", "left_anti")
    )
    rows = named.select(
        F.lit(None).cast("string").alias("code"),
        "name",
        F.lit(None).cast("string").alias("continent"),
    )
    return assign_keys(rows, ["name"]).select(*COUNTRIES.fieldNames())


def upsert_companies(offers: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies of ``offers`` (``company_name, country_id``) not stored yet.

    Every offer counts, also one that is itself a duplicate; a company needs
    both a name and a country.
    """
    pair = ["name", "country_id"]
    wanted = (
        offers.select(F.col("company_name").alias("name"), "country_id")
        .filter((F.col("name") != "") & F.col("country_id").isNotNull())
        .distinct()
        .join(companies.select(*pair), pair, "left_anti")
    )
    rows = wanted.select(
        "name",
        F.lit(None).cast("string").alias("size"),
        "country_id",
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"),
    )
    return assign_keys(rows, pair).select(*COMPANIES.fieldNames())


def upsert_skills(names: DataFrame, skills: DataFrame) -> DataFrame:
    """Skills (column ``name``) not stored yet, without a category."""
    wanted = names.select("name").distinct().join(skills.select("name"), "name", "left_anti")
    rows = wanted.select("name", F.lit(None).cast("string").alias("category"))
    return assign_keys(rows, ["name"]).select(*SKILLS.fieldNames())


def conform_market(
    df: DataFrame, countries: DataFrame, aliases: dict[str, str | None] = COUNTRY_ALIASES
) -> DataFrame:
    """Accepted market rows as offers, with ``arrival`` when the feed has it."""
    accepted, _ = split_known_country(df, countries, aliases)
    extra = [ARRIVAL] if ARRIVAL in df.columns else []
    return accepted.select(
        F.col("job_id").alias("external_id"),
        F.lit(MARKET_SOURCE).alias("source"),
        "job_title",
        "job_category",
        "country_id",
        "city",
        F.col("salary_min_usd").alias("salary_min"),
        F.col("salary_max_usd").alias("salary_max"),
        F.col("annual_salary_usd").alias("salary_avg"),
        F.lit("USD").alias("salary_currency"),
        "experience_level",
        "years_of_experience",
        "education_required",
        "company_size",
        "industry",
        F.col("required_skills").alias("required_skills_raw"),
        "demand_score",
        "demand_growth_yoy_pct",
        "ai_salary_premium_pct",
        "benefits_score_10",
        "is_llm_role",
        "is_remote_friendly",
        "salary_tier",
        "posting_year",
        "posting_month",
        *extra,
    )


def locate_offers(
    offers: DataFrame,
    countries: DataFrame,
    aliases: dict[str, str | None] = COUNTRY_ALIASES,
) -> DataFrame:
    """API offers with ``country_id`` and ``company_name``."""
    located = _with_country_id(offers, countries, offer_country(aliases))
    return located.withColumn("company_name", F.col("company.display_name"))


def conform_api(
    offers: DataFrame,
    countries: DataFrame,
    companies: DataFrame,
    aliases: dict[str, str | None] = COUNTRY_ALIASES,
    strict_dates: bool = True,
) -> DataFrame:
    """API offers flattened to the stored form; countries and companies known.

    A company may have countless offers and many offers name none, so the
    look-up of companies, too many to broadcast, spreads such groups.
    """
    located = locate_offers(offers, countries, aliases)
    known = companies.filter(F.col("country_id").isNotNull()).select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), "country_id"
    )
    pair = ["company_name", "country_id"]
    counts = located.filter(~any_null(pair)).groupBy(*pair).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = hot_join(located, known, counts, pair, spread_by=[ARRIVAL], how="left")
    return joined.select(
        F.col("id").alias("external_id"),
        F.lit(API_SOURCE).alias("source"),
        F.col("title").alias("job_title"),
        F.col("category.label").alias("job_category"),
        "company_id",
        "country_id",
        F.col("location.display_name").alias("city"),
        F.col("salary_min").cast(MONEY).alias("salary_min"),
        F.col("salary_max").cast(MONEY).alias("salary_max"),
        derive_currency(F.col("country_code")).alias("salary_currency"),
        flag_predicted_salary(F.col("salary_is_predicted")).alias("salary_is_predicted"),
        F.col("contract_type").alias("employment_type"),
        "contract_time",
        "description",
        parse_posted_date(F.col("created"), strict_dates).alias("posted_date"),
        ARRIVAL,
    )


def split_titled(offers: DataFrame, title: str = "title") -> tuple[DataFrame, DataFrame]:
    """Offers with a title, and those without, which the table refuses."""
    return offers.filter(F.col(title).isNotNull()), offers.filter(F.col(title).isNull())


def union_sources(*feeds: DataFrame) -> DataFrame:
    """Both feeds in one table; what a feed does not know is NULL."""
    result = feeds[0]
    for feed in feeds[1:]:
        result = result.unionByName(feed, allowMissingColumns=True)
    return result


def apply_defaults(df: DataFrame, table: str = "jobs") -> DataFrame:
    """All columns of the table; defaults only where the column was not given.

    A NULL that the feed did give stays NULL.
    """
    now = F.current_timestamp().cast("timestamp_ntz")
    defaults = {
        "jobs": {
            "salary_currency": F.lit("USD"),
            "salary_is_predicted": F.lit(False),
            "created_at": now,
            "updated_at": now,
        },
        "companies": {"created_at": now},
    }.get(table, {})
    schema: T.StructType = TABLES[table]
    return df.select(
        *[
            (
                F.col(field.name).cast(field.dataType)
                if field.name in df.columns
                else defaults.get(field.name, F.lit(None)).cast(field.dataType)
            ).alias(field.name)
            for field in schema.fields
        ]
    )


def finish_offers(df: DataFrame, load_id: str) -> DataFrame:
    """Conformed offers as complete rows of the offers table."""
    keyed = assign_keys(df, ["external_id", "source"], load_id=load_id)
    return apply_defaults(keyed).select(*JOBS.fieldNames())

