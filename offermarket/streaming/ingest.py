"""Incremental load of landed API pages."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from offermarket.plans.loading import Warehouse, load_offers_of_pages
from offermarket.schemas import API_PAGE, API_PAGE_PARTITIONS
from offermarket.sources.feeds import explode_pages
from offermarket.vocabulary import COUNTRY_ALIASES, DETECTED_SKILLS


def ingest_incremental(
    spark: SparkSession,
    landing: str,
    warehouse: str,
    checkpoint: str,
    *,
    files_per_batch: int | None = None,
    aliases: dict[str, str | None] = COUNTRY_ALIASES,
    dictionary: list[str] = DETECTED_SKILLS,
) -> StreamingQuery:
    """Load the pages that landed since the last run, then stop.

    The offer's key, not a time, decides what is new, so there is no watermark.
    Each batch is a load named by the stream's identity, which the checkpoint keeps,
    and its number: streams with other checkpoints never share a name, and a batch
    that runs again after a failure finishes its own load and adds nothing twice.
    """
    stored = Warehouse(spark, warehouse)
    schema = T.StructType(API_PAGE.fields + API_PAGE_PARTITIONS.fields)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    started = threading.Event()
    queries: list[StreamingQuery] = []

    def load(batch: DataFrame, batch_id: int) -> None:
        # The first batch may come before the starting call has returned the stream.
        started.wait()
        name = f"stream-{queries[0].id}-{batch_id:09d}"
        load_offers_of_pages(stored, batch, name, aliases, dictionary)

    query = (
        explode_pages(reader.json(landing))
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    queries.append(query)
    started.set()
    return query
