"""Column handling shared by the operators of this package.

An operator names the columns it works on. All other input columns travel in one
struct, so they can never clash with a name that the operator uses inside; where
an input column bears the name of a result column, the result wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "_rest"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The white space of the contracts, [\x20\x09-\x0D].
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def field(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pack(df: DataFrame, carried: list[str] | None = None, **named: Column) -> DataFrame:
    """The columns an operator works on, and one struct ``_rest`` with the input columns (or those carried)."""
    rest = df.columns if carried is None else carried
    # A constant keeps the struct from being empty where nothing is carried.
    whole = F.struct(*[field(c) for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    return df.select(*[c.alias(n) for n, c in named.items()], whole.alias(REST))


def unpack(df: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """The input columns again, followed by the results, which replace columns of their name."""
    same = {c.lower(): c for c in columns}
    replaced = {n.lower(): c for n, c in results.items()}
    kept = [
        replaced[c.lower()].alias(c) if c.lower() in replaced else F.col(REST).getField(c).alias(c) for c in columns
    ]
    return df.select(*kept, *[c.alias(n) for n, c in results.items() if n.lower() not in same])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def without_blanks(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text

