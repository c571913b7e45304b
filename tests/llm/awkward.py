"""Rows that operators must take without crashing."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "one very long line of many words that goes on and on " * 4000

TEXTS = [
    (1, "The same line in two documents.\nA line of its own."),
    (2, "the same line in two documents.  \nAnother line of its own."),
    (3, None),
    (4, ""),
    (5, LONG),
    (6, LONG),
    (7, "a"),
    (8, "a"),
    (9, "\n\n \t\n"),
    (None, "The same line in two documents.\nWithout an id."),
    (None, None),
    (11, "Ünïcödé wörds, 日本語 and 👍 signs"),
    (12, "repeated row"),
    (12, "repeated row"),
    (12, "same id, other text"),
    (13, "word " * 30 + "end"),
    (14, "!!! ### !!!"),
    (15, "!!! ### !!!"),
]


def documents(spark, rows=TEXTS):
    whole = [(d, t, None if d == 7 else "en", None if d == 8 else "src", None if t is None else len(t)) for d, t in rows]
    return spark.createDataFrame(whole, SCHEMA)


def clashing(spark, *names, rows=TEXTS):
    """The documents with more columns, of the given names, that hold something else."""
    from pyspark.sql import functions as F

    docs = documents(spark, rows)
    for name in names:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
