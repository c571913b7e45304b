"""Column rules for conversation logs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from offermarket.functions.text import strip
from offermarket.schemas import CORRUPT, SALARY_REQUEST
from offermarket.vocabulary import (
    INTENT_GENERAL,
    INTENT_PREDICTION,
    PREDICTION_CUES,
    REQUEST_PATTERN,
    SOURCE_GENERAL,
    SOURCE_PREDICTION,
    THINK_PATTERN,
)


def strip_think(col: Column) -> Column:
    """Text without its reasoning passages, stripped."""
    return strip(F.regexp_replace(col, THINK_PATTERN, ""))


def request_json(col: Column) -> Column:
    """Content of the first request tag, stripped; NULL without a tag."""
    return F.when(col.rlike(REQUEST_PATTERN), strip(F.regexp_extract(col, REQUEST_PATTERN, 1)))


def extract_salary_request(col: Column, schema: str | None = None) -> Column:
    """Fields of the first logged salary request.

    NULL without a tag and for unreadable JSON, never a struct of NULLs.
    ``schema`` is a DDL list of fields, the salary request's by default.
    """
    fields = schema or ", ".join(
        f"{field.name} {field.dataType.simpleString()}" for field in SALARY_REQUEST.fields
    )
    names = [part.split()[0] for part in re.split(r",\s*(?![^<]*>)", fields)]
    parsed = F.from_json(
        request_json(col),
        f"{fields}, {CORRUPT} string",
        {"columnNameOfCorruptRecord": CORRUPT},
    )

    def readable(item: Column) -> Column:
        return F.when(
            item.isNotNull() & item[CORRUPT].isNull(),
            F.struct(*[item[name].alias(name) for name in names]),
        )

    # transform() binds the parsed request, so the JSON is read once.
    return F.get(F.transform(F.array(parsed), readable), F.lit(0))


def route_intent(col: Column, cues: list[str] = PREDICTION_CUES) -> Column:
    """ML when the question holds one of the cues, GENERAL otherwise."""
    pattern = "(?iu)" + "|".join(rf"\Q{cue}\E" for cue in cues)
    return F.when(col.rlike(pattern), INTENT_PREDICTION).otherwise(INTENT_GENERAL)


def tag_source(col: Column, intent: Column) -> Column:
    """Answer followed by the note naming where it comes from."""
    note = F.when(intent == INTENT_PREDICTION, SOURCE_PREDICTION).otherwise(SOURCE_GENERAL)
    return F.concat(col, note)
