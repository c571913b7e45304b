"""Stored tables: Parquet folders or a PostgreSQL database."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from offermarket.schemas import TABLES

_LOAD = T.StructField("load", T.StringType())


def read_warehouse_table(
    spark: SparkSession,
    name: str,
    *,
    parquet_dir: str | None = None,
    jdbc: dict[str, str] | None = None,
    loads: DataFrame | None = None,
) -> DataFrame:
    """One stored table, or over JDBC also a query.

    From Parquet a table that was never written is empty. ``jdbc`` holds the
    reader's options; with ``partitionColumn``, bounds and ``numPartitions``
    the rows are fetched by that many tasks, and a ``name`` starting with
    ``select`` is passed on as a query. ``loads`` (column ``load``) names the
    loads whose rows count; folders of others are not read.
    """
    if (parquet_dir is None) == (jdbc is None):
        raise ValueError("give either parquet_dir or jdbc")
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc_options(name, jdbc)).load()
    schema = TABLES[name]
    try:
        stored = spark.read.schema(T.StructType([*schema.fields, _LOAD])).parquet(
            f"{parquet_dir.rstrip('/')}/{name}"
        )
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if loads is not None:
        stored = stored.join(loads.select(_LOAD.name), _LOAD.name, "left_semi")
    return stored.select(*schema.fieldNames())


def jdbc_options(name: str, jdbc: dict[str, str]) -> dict[str, str]:
    """Reader options; partitioned reads need the query as a derived table."""
    options = dict(jdbc)
    is_query = name.lstrip().lower().startswith("select")
    if not is_query:
        options["dbtable"] = name
    elif "partitionColumn" in options:
        options["dbtable"] = f"({name.strip().rstrip(';')}) AS derived"
    else:
        options["query"] = name.strip().rstrip(";")
    return options
