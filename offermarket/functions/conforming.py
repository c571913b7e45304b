"""Column rules that bring both feeds to the stored form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offermarket.vocabulary import COUNTRY_ALIASES

# ISO 8601 date, optionally with a time and an offset.
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)


def lookup_map(pairs: dict) -> Column:
    """A literal map column."""
    return F.create_map(*[F.lit(item) for pair in pairs.items() for item in pair])


def normalize_country(col: Column, aliases: dict[str, str | None] = COUNTRY_ALIASES) -> Column:
    """Canonical country name; exact match, other names pass unchanged.

    An alias whose target is None ("no single country") gives NULL and must not
    fall through to the raw name.
    """
    named = {raw: name for raw, name in aliases.items() if name is not None}
    unnamed = [raw for raw, name in aliases.items() if name is None]
    result = F.coalesce(F.try_element_at(lookup_map(named), col), col) if named else col
    return F.when(~col.isin(unnamed), result) if unnamed else result


def derive_currency(country_code: Column) -> Column:
    """Pounds for searches in Great Britain, dollars for all the others."""
    return F.when(country_code == "gb", "GBP").otherwise("USD")


def parse_posted_date(col: Column, strict: bool = True) -> Column:
    """The date of an ISO timestamp as it is written, without any zone shift.

    Missing or empty text gives NULL. Malformed text stops the job when
    ``strict``, else gives NULL.
    """
    given = F.when(col != "", col)
    day = F.substring(given, 1, 10)
    if not strict:
        return F.when(given.rlike(_ISO), _try_date(day))
    return F.when(given.rlike(_ISO), F.to_date(day, "yyyy-MM-dd")).when(
        given.isNotNull(),
        F.raise_error(F.concat(F.lit("not an ISO timestamp: "), given)).cast("date"),
    )


def _try_date(day: Column) -> Column:
    return F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date")


def flag_predicted_salary(col: Column) -> Column:
    """TRUE only for the text ``1``; missing counts as FALSE."""
    return F.coalesce(col == "1", F.lit(False))


def coerce_flag(col: Column) -> Column:
    """Boolean written as text; anything unreadable is NULL."""
    return col.try_cast("boolean")


def pick_label(col: Column, labels: dict) -> Column:
    """Label of a value; NULL for a value without one."""
    return F.try_element_at(lookup_map(labels), col)
