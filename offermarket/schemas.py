"""Explicit schemas: feeds as they land, tables as they are stored.

Keys are strings. They are 128-bit digests of the natural key (see
``operators.conform.assign_keys``): a 64-bit hash is expected to collide
somewhere past a few billion offers, which is within reach here.
"""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
# Column that orders the rows of one load as the feed delivered them.
ARRIVAL = "arrival"

KEY = T.StringType()
MONEY = T.DecimalType(12, 2)
PERCENT = T.DecimalType(6, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# Market feed: column of the file -> type it has once loaded.
MARKET_COLUMNS: dict[str, T.DataType] = {
    "job_id": T.StringType(),
    "job_title": T.StringType(),
    "job_category": T.StringType(),
    "country": T.StringType(),
    "city": T.StringType(),
    "salary_min_usd": MONEY,
    "salary_max_usd": MONEY,
    "annual_salary_usd": MONEY,
    "experience_level": T.StringType(),
    "years_of_experience": T.IntegerType(),
    "education_required": T.StringType(),
    "company_size": T.StringType(),
    "industry": T.StringType(),
    "required_skills": T.StringType(),
    "demand_score": T.IntegerType(),
    "demand_growth_yoy_pct": PERCENT,
    "ai_salary_premium_pct": PERCENT,
    "benefits_score_10": T.DecimalType(4, 2),
    "is_llm_role": T.BooleanType(),
    "is_remote_friendly": T.BooleanType(),
    "salary_tier": T.StringType(),
    "posting_year": T.IntegerType(),
    "posting_month": T.IntegerType(),
}

# One offer inside a landed API page.
API_OFFER = _struct(
    ("id", T.StringType()),
    ("title", T.StringType()),
    ("description", T.StringType()),
    ("created", T.StringType()),
    ("category", _struct(("label", T.StringType()))),
    ("company", _struct(("display_name", T.StringType()))),
    (
        "location",
        _struct(("area", T.ArrayType(T.StringType())), ("display_name", T.StringType())),
    ),
    ("salary_min", T.DoubleType()),
    ("salary_max", T.DoubleType()),
    ("salary_is_predicted", T.StringType()),
    ("contract_type", T.StringType()),
    ("contract_time", T.StringType()),
)
API_PAGE = _struct(("results", T.ArrayType(API_OFFER)))
API_PAGE_PARTITIONS = _struct(
    ("country_code", T.StringType()),
    ("what", T.StringType()),
    ("page", T.IntegerType()),
)

COUNTRIES = _struct(
    ("id", KEY), ("code", T.StringType()), ("name", T.StringType()), ("continent", T.StringType())
)
COMPANIES = _struct(
    ("id", KEY),
    ("name", T.StringType()),
    ("size", T.StringType()),
    ("country_id", KEY),
    ("created_at", T.TimestampNTZType()),
)
SKILLS = _struct(("id", KEY), ("name", T.StringType()), ("category", T.StringType()))
JOB_SKILLS = _struct(("job_id", KEY), ("skill_id", KEY))
JOBS = _struct(
    ("id", KEY),
    ("external_id", T.StringType()),
    ("source", T.StringType()),
    ("job_title", T.StringType()),
    ("job_category", T.StringType()),
    ("company_id", KEY),
    ("country_id", KEY),
    ("city", T.StringType()),
    ("latitude", T.DecimalType(9, 6)),
    ("longitude", T.DecimalType(9, 6)),
    ("salary_min", MONEY),
    ("salary_max", MONEY),
    ("salary_avg", MONEY),
    ("salary_currency", T.StringType()),
    ("salary_is_predicted", T.BooleanType()),
    ("experience_level", T.StringType()),
    ("years_of_experience", T.IntegerType()),
    ("education_required", T.StringType()),
    ("employment_type", T.StringType()),
    ("contract_time", T.StringType()),
    ("remote_ratio", T.IntegerType()),
    ("is_remote_friendly", T.BooleanType()),
    ("company_size", T.StringType()),
    ("industry", T.StringType()),
    ("demand_score", T.IntegerType()),
    ("demand_growth_yoy_pct", PERCENT),
    ("ai_salary_premium_pct", PERCENT),
    ("benefits_score_10", T.DecimalType(4, 2)),
    ("is_llm_role", T.BooleanType()),
    ("salary_tier", T.StringType()),
    ("description", T.StringType()),
    ("required_skills_raw", T.StringType()),
    ("posted_date", T.DateType()),
    ("posting_year", T.IntegerType()),
    ("posting_month", T.IntegerType()),
    ("created_at", T.TimestampNTZType()),
    ("updated_at", T.TimestampNTZType()),
)

TABLES: dict[str, T.StructType] = {
    "countries": COUNTRIES,
    "companies": COMPANIES,
    "skills": SKILLS,
    "jobs": JOBS,
    "job_skills": JOB_SKILLS,
}

PROFILES = _struct(
    ("profile_id", T.LongType()),
    ("skills", T.ArrayType(T.StringType())),
    ("target_country", T.StringType()),
    ("experience", T.StringType()),
    ("min_salary", T.DoubleType()),
)

# Fields of a logged salary request (also the input of batch scoring).
SALARY_REQUEST = _struct(
    ("job_title", T.StringType()),
    ("country", T.StringType()),
    ("experience_level", T.StringType()),
    ("years_of_experience", T.DoubleType()),
    ("is_remote_friendly", T.BooleanType()),
    ("job_category", T.StringType()),
    ("employment_type", T.StringType()),
    ("company_size", T.StringType()),
    ("industry", T.StringType()),
    ("skills", T.ArrayType(T.StringType())),
)

# Rules of the stored tables.
NOT_NULL = {
    "countries": ["name"],
    "companies": ["name"],
    "skills": ["name"],
    "jobs": ["source", "job_title"],
    "job_skills": ["job_id", "skill_id"],
}
UNIQUE = {
    "countries": [["id"], ["code"]],
    "companies": [["id"], ["name", "country_id"]],
    "skills": [["id"], ["name"]],
    "jobs": [["id"], ["external_id", "source"]],
    "job_skills": [["job_id", "skill_id"]],
}
FOREIGN_KEYS = [
    ("companies", "country_id", "countries"),
    ("jobs", "company_id", "companies"),
    ("jobs", "country_id", "countries"),
    ("job_skills", "job_id", "jobs"),
    ("job_skills", "skill_id", "skills"),
]
MAX_LENGTH = {
    "countries": {"code": 5, "name": 100, "continent": 50},
    "companies": {"name": 255, "size": 20},
    "skills": {"name": 100, "category": 50},
    "jobs": {
        "external_id": 100,
        "source": 30,
        "job_title": 255,
        "job_category": 100,
        "city": 150,
        "salary_currency": 10,
        "experience_level": 50,
        "education_required": 50,
        "employment_type": 20,
        "contract_time": 20,
        "company_size": 20,
        "industry": 100,
        "salary_tier": 50,
    },
    "job_skills": {},
}
