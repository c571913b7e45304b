"""Reference rows every warehouse starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermarket.operators.conform import assign_keys
from offermarket.schemas import COUNTRIES, SKILLS
from offermarket.vocabulary import SEED_COUNTRIES, SEED_SKILLS


def seed_countries(spark: SparkSession) -> DataFrame:
    """Seeded countries with their keys.

    A country loaded before it was seeded has a name but no code, so the key
    takes both: the seeded row is a row of its own, as in the stored tables.
    """
    rows = spark.createDataFrame(SEED_COUNTRIES, "code string, name string, continent string")
    return assign_keys(rows, ["code", "name"]).select(*COUNTRIES.fieldNames())


def seed_skills(spark: SparkSession) -> DataFrame:
    """Seeded skills with their keys."""
    rows = spark.createDataFrame(SEED_SKILLS, "name string, category string")
    return assign_keys(rows, ["name"]).select(*SKILLS.fieldNames())


def seed_dimensions(countries: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seed rows absent from the stored dimensions, by code and by name."""
    from offermarket.operators.merge import insert_if_absent

    spark = countries.sparkSession
    return (
        insert_if_absent(countries, seed_countries(spark), ["code"], [F.col("code")]),
        insert_if_absent(skills, seed_skills(spark), ["name"], [F.col("name")]),
    )
