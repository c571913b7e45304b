"""Readers of the two offer feeds."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermarket.functions.conforming import coerce_flag
from offermarket.functions.text import missing_to_null
from offermarket.schemas import API_PAGE, API_PAGE_PARTITIONS, ARRIVAL, CORRUPT, MARKET_COLUMNS
from offermarket.vocabulary import SEARCH_COUNTRIES, SEARCH_TITLES

ARRIVAL_KIND = "struct<file:string,block:bigint,row:bigint>"


def read_market_csv(spark: SparkSession, path: str) -> DataFrame:
    """Market rows of CSV files with headers: typed columns, ``arrival`` and the corrupt line.

    Columns are taken by header name, whatever their order in a file, and read as
    text; the words for "missing" become NULL before the cast, and a value that
    does not fit its type is NULL instead of stopping the load. A quoted field may
    hold line breaks, so a file is read by one task. A line with too few or too many
    fields is kept in ``_corrupt_record``. ``arrival`` orders the rows as the files
    hold them, whatever the number of read tasks.
    """
    parts = [_one_layout(spark, header, files) for header, files in _layouts(spark, path).items()]
    if not parts:
        kinds = T.StructType([T.StructField(n, k) for n, k in MARKET_COLUMNS.items()])
        return spark.createDataFrame([], kinds.add(CORRUPT, T.StringType()).add(ARRIVAL, ARRIVAL_KIND))
    return reduce(DataFrame.unionByName, parts)


def _layouts(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by their header line. File names and a line each come to the driver, no data."""
    first = F.min_by("value", F.struct("block", "row"))
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    found: dict[str, list[str]] = {}
    for row in lines.filter("block = 0").groupBy("file").agg(first.alias("header")).collect():
        found.setdefault(row.header.lstrip("\ufeff"), []).append(row.file)
    return found


def _one_layout(spark: SparkSession, header: str, files: list[str]) -> DataFrame:
    names = next(csv.reader([header]))
    # Names that are empty or come twice can't be asked for; they only hold their place.
    places = [n if n and names.index(n) == i else f"_place_{i}" for i, n in enumerate(names)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*places, CORRUPT]])
    checked = places == names
    raw = (
        spark.read.schema(schema)
        .options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", enforceSchema=not checked)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(files)
    )
    arrival = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    columns = [
        _typed(name, kind) if name in places else F.lit(None).cast(kind).alias(name)
        for name, kind in MARKET_COLUMNS.items()
    ]
    return raw.select(*columns, CORRUPT, arrival.alias(ARRIVAL))


def _typed(name: str, kind: T.DataType) -> Column:
    text = missing_to_null(F.col(name))
    if isinstance(kind, T.BooleanType):
        return coerce_flag(text).alias(name)
    if isinstance(kind, T.IntegerType):
        # "3.0" is how a whole number looks in a column with gaps.
        return text.try_cast("double").try_cast("int").alias(name)
    if isinstance(kind, T.StringType):
        return text.alias(name)
    return text.try_cast(kind).alias(name)


def read_offer_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per offer of the landed result pages.

    Pages lie under ``country_code=/what=/page=``, or under ``country_code=/what=`` with
    ``page`` as a field, many lines to a file. ``pos`` is the offer's place on its page;
    ``arrival`` is the order in which the searches return offers.
    """
    schema = T.StructType(API_PAGE.fields + API_PAGE_PARTITIONS.fields)
    pages = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return explode_pages(pages)


def explode_pages(pages: DataFrame) -> DataFrame:
    """Offers of page rows, batch or streaming."""
    offers = pages.select(
        "country_code", "what", "page", F.posexplode("results").alias("pos", "offer")
    )
    return offers.select(
        "offer.*", "country_code", "what", "page", "pos", search_order().alias(ARRIVAL)
    )


def search_order() -> Column:
    """Country order, then title order, page and position; unknown ones last."""

    def place(known: list[str], name: str) -> Column:
        position = F.array_position(F.array(*[F.lit(item) for item in known]), F.col(name))
        return F.coalesce(F.when(position > 0, position), F.lit(len(known) + 1))

    return F.struct(
        place(SEARCH_COUNTRIES, "country_code").alias("country_place"),
        F.col("country_code"),
        place(SEARCH_TITLES, "what").alias("title_place"),
        F.col("what"),
        F.col("page"),
        F.col("pos"),
    )
