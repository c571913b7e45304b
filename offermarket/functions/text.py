"""Text columns: stripping, delimited lists, dictionary lookup in free text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from offermarket.vocabulary import DETECTED_SKILLS, MISSING_TOKENS, WHITESPACE


def strip(col: Column) -> Column:
    """Remove every kind of Unicode white space at both ends.

    ``trim`` alone knows the plain space only, so the characters are listed.
    """
    return F.btrim(col, F.lit(WHITESPACE))


def missing_to_null(col: Column) -> Column:
    """NULL where a CSV cell holds one of the words for "missing"."""
    return F.when(~col.isin(MISSING_TOKENS), col)


def split_list(col: Column, separator: str) -> Column:
    """Parts of a delimited text: stripped, non-empty, first occurrence kept.

    NULL gives an empty list.
    """
    parts = F.transform(F.split(col, re.escape(separator)), strip)
    kept = F.array_distinct(F.filter(parts, lambda part: part != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def split_skill_list(col: Column) -> Column:
    """Skills of a ``|``-separated list."""
    return split_list(col, "|")


def skills_list(col: Column) -> Column:
    """Skills of a comma-separated list."""
    return split_list(col, ",")


def detect_skills(text: Column, dictionary: list[str] = DETECTED_SKILLS) -> Column:
    """Dictionary entries occurring in ``text`` as whole words, any case.

    The result keeps the dictionary's order and spelling; NULL text gives an
    empty list. Entries made of one word cannot overlap each other, so a single
    pass over the text finds all of them; only the few entries of several words
    need a pass of their own. The spelling of each hit is then looked up in the
    short list of hits, not in the text.
    """
    single = [entry for entry in dictionary if re.fullmatch(r"\w+", entry)]
    several = [entry for entry in dictionary if entry not in single]

    def whole_word(body: str) -> str:
        return rf"(?iU)\b{body}\b"

    found = {entry: text.rlike(whole_word(_quote(entry))) for entry in several}
    if not single:
        return _named_hits(dictionary, found)
    any_single = whole_word("(?:" + "|".join(_quote(entry) for entry in single) + ")")
    hits = F.array_join(
        F.array_distinct(F.regexp_extract_all(text, F.lit(any_single), F.lit(0))), "\n"
    )

    def spelled(hit_lines: Column) -> Column:
        per_entry = dict(found)
        for entry in single:
            per_entry[entry] = hit_lines.rlike(whole_word(_quote(entry)))
        return _named_hits(dictionary, per_entry)

    # transform() binds the hits to a variable, so they are computed once.
    return F.coalesce(
        F.get(F.transform(F.array(hits), spelled), F.lit(0)),
        F.array().cast("array<string>"),
    )


def _quote(entry: str) -> str:
    return r"\Q" + entry + r"\E"


def _named_hits(dictionary: list[str], found: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(found[entry], F.lit(entry)) for entry in dictionary]))
