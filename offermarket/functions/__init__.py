"""Column functions; each takes and returns columns."""

from offermarket.functions.conforming import (
    coerce_flag,
    derive_currency,
    flag_predicted_salary,
    normalize_country,
    parse_posted_date,
    pick_label,
)
from offermarket.functions.dialogue import (
    extract_salary_request,
    route_intent,
    strip_think,
    tag_source,
)
from offermarket.functions.numbers import (
    compat_badge,
    format_salary,
    log_target,
    mean_of,
    money_text,
    percent_score,
    percent_text,
    report_grade,
    share,
    unlog,
)
from offermarket.functions.text import (
    detect_skills,
    missing_to_null,
    skills_list,
    split_list,
    split_skill_list,
    strip,
)

__all__ = [
    "coerce_flag",
    "compat_badge",
    "derive_currency",
    "detect_skills",
    "extract_salary_request",
    "flag_predicted_salary",
    "format_salary",
    "log_target",
    "mean_of",
    "missing_to_null",
    "money_text",
    "normalize_country",
    "parse_posted_date",
    "percent_score",
    "percent_text",
    "pick_label",
    "report_grade",
    "route_intent",
    "share",
    "skills_list",
    "split_list",
    "split_skill_list",
    "strip",
    "strip_think",
    "tag_source",
    "unlog",
]
