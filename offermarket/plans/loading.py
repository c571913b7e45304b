"""Loads of both feeds into a Parquet warehouse.

A load writes folders of its own (``load=<id>``) and counts once it is published:
one row in the table ``loads``, written last, names it. Readers and other loads see
published loads only, so one that broke off half way can run again and replace its
folders, which nobody relies on. A published load is never written again: given
the same rows it returns its report, given others it is refused. One load writes to
a warehouse at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermarket.operators import conform, merge, quality
from offermarket.operators.skills import bridge_pairs, offer_skill_names
from offermarket.schemas import ARRIVAL, CORRUPT, TABLES
from offermarket.sources.feeds import read_market_csv, read_offer_pages
from offermarket.sources.seeds import seed_dimensions
from offermarket.sources.warehouse import read_warehouse_table
from offermarket.staging import stage
from offermarket.vocabulary import API_SOURCE, COUNTRY_ALIASES, DETECTED_SKILLS, MARKET_SOURCE

OFFER_KEY = ["external_id", "source"]
Aliases = dict[str, str | None]


LOADS = T.StructType([T.StructField("load", T.StringType()), T.StructField("content", T.StringType())])
REPORT = T.StructType([T.StructField("metric", T.StringType()), T.StructField("n", T.LongType())])


@dataclass
class Warehouse:
    """The stored tables below one folder."""

    spark: SparkSession
    path: str

    def _read(self, folder: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def loads(self) -> DataFrame:
        """The published loads and checksums of what they were given."""
        return self._read(f"{self.path}/loads", LOADS)

    def table(self, name: str, with_load: str | None = None) -> DataFrame:
        """Rows of all published loads, and of one that is still being written."""
        loads = self.loads().select("load")
        if with_load is not None:
            loads = loads.unionByName(self.spark.createDataFrame([(with_load,)], "load string")).distinct()
        return read_warehouse_table(self.spark, name, parquet_dir=self.path, loads=loads)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def put(self, name: str, rows: DataFrame, load_id: str) -> DataFrame:
        """Write the rows of a load that is not published yet; returns them as stored."""
        if self.content(load_id) is not None:
            raise ValueError(f"load {load_id} is published and can't be written again")
        folder = f"{self.path}/{name}/load={load_id}"
        merge.write_table(rows, folder, mode="overwrite")
        return self.spark.read.schema(TABLES[name]).parquet(folder)

    def publish(self, load_id: str, content: str = "", report: DataFrame | None = None) -> DataFrame:
        """Make the rows of a load count; its report is kept beside it."""
        if report is not None:
            report.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/reports/load={load_id}")
        noted = self.spark.createDataFrame([(load_id, content)], LOADS)
        noted.coalesce(1).write.mode("append").parquet(f"{self.path}/loads")
        return self.report(load_id)

    def content(self, load_id: str) -> str | None:
        """Checksum of what a published load was given; None for others."""
        found = self.loads().filter(F.col("load") == load_id).first()
        return found.content if found else None

    def report(self, load_id: str) -> DataFrame:
        return self._read(f"{self.path}/reports/load={load_id}", REPORT)

    def published(self, load_id: str, content: str) -> bool:
        """Whether a load with these rows is published; one with other rows is an error."""
        known = self.content(load_id)
        if known is not None and known != content:
            raise ValueError(f"load {load_id} was published with other rows: give this one an id of its own")
        return known is not None


def checksum(rows: DataFrame) -> str:
    """Equal for the same rows in any order; where they lie in the feed plays no part."""
    hashed = F.xxhash64(*[c for c in rows.columns if c != ARRIVAL])
    total = rows.select(hashed.alias("h")).agg(
        F.count(F.lit(1)), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0))
    )
    return "/".join(str(part) for part in total.first())


def seed_warehouse(warehouse: Warehouse, load_id: str = "seed") -> None:
    """Reference countries and skills, where they are absent; a seed that ran stays as it is."""
    if warehouse.content(load_id) is not None:
        return
    countries, skills = seed_dimensions(warehouse.table("countries"), warehouse.table("skills"))
    warehouse.put("countries", countries, load_id)
    warehouse.put("skills", skills, load_id)
    warehouse.publish(load_id)


def load_market(
    warehouse: Warehouse, path: str, load_id: str | None = None, aliases: Aliases = COUNTRY_ALIASES
) -> DataFrame:
    """Load a market CSV; returns the load report."""
    load_id = load_id or uuid.uuid4().hex
    raw = stage(read_market_csv(warehouse.spark, path), "market-raw")
    content = checksum(raw)
    if warehouse.published(load_id, content):
        return warehouse.report(load_id)
    countries = warehouse.table("countries")
    # Lines that don't fit their header may hold values in the wrong columns.
    whole = raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    accepted, unknown = conform.split_known_country(whole, countries, aliases)
    offers = conform.conform_market(whole, countries, aliases)
    corrupt = raw.filter(F.col(CORRUPT).isNotNull())
    rejected = unknown.select("job_id").unionByName(corrupt.select("job_id"))
    report = _load_offers(warehouse, raw, accepted, rejected, offers, MARKET_SOURCE, load_id)
    counted = corrupt.agg(F.count(F.lit(1)).alias("n")).select(F.lit("corrupt").alias("metric"), "n")
    return warehouse.publish(load_id, content, report.unionByName(counted))


def load_pages(
    warehouse: Warehouse,
    path: str,
    load_id: str | None = None,
    aliases: Aliases = COUNTRY_ALIASES,
    dictionary: list[str] = DETECTED_SKILLS,
) -> DataFrame:
    """Load landed API pages; returns the load report."""
    offers = read_offer_pages(warehouse.spark, path)
    return load_offers_of_pages(
        warehouse, offers, load_id or uuid.uuid4().hex, aliases, dictionary
    )


def load_offers_of_pages(
    warehouse: Warehouse,
    offers: DataFrame,
    load_id: str,
    aliases: Aliases = COUNTRY_ALIASES,
    dictionary: list[str] = DETECTED_SKILLS,
) -> DataFrame:
    """Load API offers: new countries and companies first, then the offers.

    The pages are staged once as columns: countries and companies then read the
    few columns they need instead of parsing the JSON again.
    """
    raw = stage(offers, "pages-raw")
    content = checksum(raw)
    if warehouse.published(load_id, content):
        return warehouse.report(load_id)
    warehouse.put(
        "countries",
        conform.add_missing_countries(raw, warehouse.table("countries"), aliases),
        load_id,
    )
    countries = warehouse.table("countries", load_id)
    located = conform.locate_offers(raw, countries, aliases)
    warehouse.put(
        "companies",
        conform.upsert_companies(located, warehouse.table("companies")),
        load_id,
    )
    accepted, rejected = conform.split_titled(raw)
    companies = warehouse.table("companies", load_id)
    conformed = conform.conform_api(accepted, countries, companies, aliases)
    report = _load_offers(
        warehouse, raw, accepted, rejected, conformed, API_SOURCE, load_id, dictionary
    )
    return warehouse.publish(load_id, content, report)


def _load_offers(
    warehouse: Warehouse,
    raw: DataFrame,
    accepted: DataFrame,
    rejected: DataFrame,
    conformed: DataFrame,
    source: str,
    load_id: str,
    dictionary: list[str] = DETECTED_SKILLS,
) -> DataFrame:
    # One source is one folder, so only that part of the stored offers is read.
    stored = warehouse.table("jobs").filter(F.col("source") == source)
    new_rows = merge.insert_if_absent(stored, conformed, OFFER_KEY, [ARRIVAL])
    offers = warehouse.put("jobs", conform.finish_offers(new_rows, load_id), load_id)
    # Staged, because texts are searched once for new skills and for the bridge.
    names = stage(offer_skill_names(offers, dictionary), "offer-skills")
    new_skills = conform.upsert_skills(names, warehouse.table("skills"))
    warehouse.put("skills", new_skills, load_id)
    # The offers are new and their skills distinct: no pair can be stored yet.
    pairs = bridge_pairs(names, warehouse.table("skills", load_id))
    bridge = warehouse.put("job_skills", pairs, load_id)
    return quality.load_report(raw, accepted, rejected, offers, bridge)
