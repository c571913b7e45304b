"""Skills of offers: from raw lists and free text to the bridge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermarket.functions.text import detect_skills, split_skill_list
from offermarket.skew import salted_lookup
from offermarket.vocabulary import DETECTED_SKILLS


def offers_with_raw_skills(jobs: DataFrame) -> DataFrame:
    """Offers that carry a raw skill list."""
    return jobs.filter(F.col("required_skills_raw") != "")


def offer_skill_names(jobs: DataFrame, dictionary: list[str] = DETECTED_SKILLS) -> DataFrame:
    """``(job_id, name)``: skills listed by an offer or found in its description.

    Names are made distinct inside the offer's row, so no shuffle is needed.
    """
    names = F.array_distinct(
        F.concat(
            split_skill_list(F.col("required_skills_raw")),
            detect_skills(F.col("description"), dictionary),
        )
    )
    return jobs.select(F.col("id").alias("job_id"), F.explode(names).alias("name"))


def build_job_skills(
    jobs: DataFrame, skills: DataFrame, dictionary: list[str] = DETECTED_SKILLS
) -> DataFrame:
    """Bridge pairs of ``jobs``; skills have to be stored first."""
    return bridge_pairs(offer_skill_names(jobs, dictionary), skills)


def bridge_pairs(names: DataFrame, skills: DataFrame) -> DataFrame:
    """``(job_id, name)`` rows as pairs of keys."""
    known = skills.select(F.col("id").alias("skill_id"), "name")
    # A popular skill is in most offers; the known skills are few.
    return salted_lookup(names, known, ["name"], spread_by=["job_id"]).select("job_id", "skill_id")
