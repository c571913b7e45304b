"""Means, rounding, shares and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offermarket.vocabulary import GRADES, NOT_AVAILABLE


def mean(total: Column, rows: Column) -> Column:
    """Mean from a sum and a count, as a double; NULL without rows.

    Sums of decimals are exact, so the mean does not depend on how the rows
    were partitioned.
    """
    return F.try_divide(total.cast("double"), rows)


def mean_of(col: Column) -> Column:
    """Aggregate: mean of the non-NULL values."""
    return mean(F.sum(col), F.count(col))


def share(part: Column, whole: Column) -> Column:
    """Percentage of a whole."""
    return F.lit(100.0) * part / whole


def percent_score(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to one decimal, ties to even, 0 for an empty whole.

    The quotient is a double and is rounded as it is printed: 23 of 80 gives
    28.7, since the double lies just below the tie.
    """
    return F.when(whole > 0, F.bround(part / whole * 100, 1)).otherwise(F.lit(0.0))


def _grade(score: Column, position: int) -> Column:
    result = None
    for grade in GRADES:
        floor, label = grade[0], F.lit(grade[position])
        if floor is None:
            result = result.otherwise(label)
        else:
            result = (F if result is None else result).when(score >= floor, label)
    return result


def compat_badge(score: Column) -> Column:
    """Badge of a rounded compatibility score."""
    return F.when(score.isNotNull(), _grade(score, 1))


def report_grade(score: Column) -> Column:
    """Word printed for a rounded compatibility score in the report."""
    return F.when(score.isNotNull(), _grade(score, 2))


def money_text(amount: Column) -> Column:
    """``$1,234``, or N/A when missing or not positive."""
    return F.when(amount > 0, F.concat(F.lit("$"), F.format_number(amount, 0))).otherwise(
        F.lit(NOT_AVAILABLE)
    )


def format_salary(amount: Column) -> Column:
    """``$1,234 USD/an``."""
    return F.concat(F.lit("$"), F.format_number(amount, 0), F.lit(" USD/an"))


def percent_text(score: Column) -> Column:
    """``33.3%``; the score carries one decimal."""
    return F.concat(F.format_string("%.1f", score), F.lit("%"))


def log_target(col: Column) -> Column:
    """Salary on the scale the models are trained on."""
    return F.log1p(col)


def unlog(col: Column) -> Column:
    """Back from the training scale to a salary."""
    return F.expm1(col)
