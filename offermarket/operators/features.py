"""From stored offers to the features of the salary model."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from offermarket.skew import global_row_number, hot_join, salted_lookup, sized_join
from offermarket.staging import new_folder, stage
from offermarket.vocabulary import (
    CATEGORICAL_COLUMNS,
    OTHER_TITLE,
    RARE_TITLE_ROWS,
    SALARY_CEILING,
    SALARY_FLOOR,
    SEED,
    TRAIN_PERCENT,
)

FEATURES = "features"
#: The feature that is a number.
NUMBER = "years_of_experience"


def training_extract(
    jobs: DataFrame, countries: DataFrame, job_skills: DataFrame, skills: DataFrame
) -> DataFrame:
    """Offers with a salary and a country, and their sorted list of skills."""
    named = sized_join(
        job_skills,
        skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill_name")),
        ["skill_id"],
        spread_by=["job_id"],
        always=False,
    )
    per_offer = named.groupBy(F.col("job_id").alias("id")).agg(
        F.array_sort(F.collect_set("skill_name")).alias("skills")
    )
    places = countries.select(F.col("id").alias("country_id"), F.col("name").alias("country"))
    return (
        jobs.filter(F.col("salary_avg") > 0)
        .join(places, "country_id")
        .select(
            "id",
            "job_title",
            "salary_avg",
            "experience_level",
            "years_of_experience",
            "is_remote_friendly",
            "job_category",
            "employment_type",
            "company_size",
            "industry",
            "country",
        )
        .join(per_offer, "id", "left")
        .withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    )


def salary_range(df: DataFrame, lo: float = SALARY_FLOOR, hi: float = SALARY_CEILING) -> DataFrame:
    """Offers strictly between the two salaries."""
    return df.filter((F.col("salary_avg") > lo) & (F.col("salary_avg") < hi))


def bucket_rare(
    df: DataFrame,
    col: str = "job_title",
    min_count: int = RARE_TITLE_ROWS,
    key: str = "id",
) -> DataFrame:
    """Values with fewer than ``min_count`` rows become "Other"; NULL stays."""
    common = (
        df.groupBy(col)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") >= min_count)
        .select(col, F.lit(True).alias("_common"))
    )
    joined = salted_lookup(df, common, [col], spread_by=[key], how="left")
    kept = F.when(F.col("_common") | F.col(col).isNull(), F.col(col)).otherwise(OTHER_TITLE)
    return joined.withColumn(col, kept).drop("_common").select(*df.columns)


def split_train_test(
    df: DataFrame, key: str = "id", pct: int = TRAIN_PERCENT, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Two parts by a digest of the key: the same rows under any partitioning."""
    draw = train_draw(F.col(key), seed)
    return df.filter(draw < pct), df.filter(draw >= pct)


def train_draw(key: Column, seed: int = SEED) -> Column:
    """A whole number from 0 to 99 per key and seed."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(100))


def model_columns(df: DataFrame) -> DataFrame:
    """Categories as text, years as a number: equal for training and scoring."""
    texts = [F.col(name).cast("string").alias(name) for name in CATEGORICAL_COLUMNS]
    others = [name for name in df.columns if name not in [*CATEGORICAL_COLUMNS, "years_of_experience"]]
    return df.select(
        *others, *texts, F.col("years_of_experience").cast("double").alias("years_of_experience")
    )


def _values(df: DataFrame, columns: list[str], lists: list[str], *keep: str) -> DataFrame:
    """``source, value`` of every value that a row holds, each once."""
    none = F.array().cast("array<string>")

    def entry(source: str, value: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), value.alias("value"))

    single = [entry(c, F.col(c)) for c in columns]
    many = [F.transform(F.array_distinct(F.coalesce(F.col(c), none)), partial(entry, c)) for c in lists]
    held = F.concat(*([F.array(*single)] if single else []), *many)
    return df.select(*keep, F.inline(held)).filter(F.col("value").isNotNull())


def number_values(rows: DataFrame, columns: list[str], lists: list[str]) -> DataFrame:
    """A dictionary ``source, value, idx, n_rows`` of all values of some columns, staged.

    The values are counted, sorted by ranges and numbered from 1 by range and offset: no
    task and no driver ever holds them all. Columns without a value have no entry.
    """
    counted = _values(rows, columns, lists).groupBy("source", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    return stage(global_row_number(counted, [F.asc("source"), F.asc("value")], "idx"), "dictionary")


def encode_skills(rows: DataFrame, col: str = "skills") -> Encoders:
    """One flag per skill of ``rows``, however many; unknown skills are ignored."""
    return Encoders.fit(rows, [], [col])


def encode_categories(rows: DataFrame, columns: list[str] = CATEGORICAL_COLUMNS) -> Encoders:
    """One flag per value of each column; NULL and unseen values give zeros."""
    return Encoders.fit(rows, columns, [])


@dataclass
class Encoders:
    """Numbers of the features: a dictionary of values, and the years as entry 0 of the vector."""

    dictionary: DataFrame
    size: int
    columns: list[str]
    lists: list[str]

    @classmethod
    def fit(cls, rows: DataFrame, columns: list[str], lists: list[str]) -> Encoders:
        dictionary = number_values(rows, columns, lists)
        return cls(dictionary, dictionary.count() + 1, columns, lists)

    def names(self) -> DataFrame:
        """``idx, feature`` of all entries of the vector."""
        flags = self.dictionary.select("idx", F.concat_ws("_flags_", "source", "value").alias("feature"))
        first = self.dictionary.sparkSession.range(1).select(F.col("id").alias("idx"), F.lit(NUMBER).alias("feature"))
        return first.unionByName(flags)

    def indexed(self, df: DataFrame) -> DataFrame:
        """``df`` with the sorted numbers of each row's values as ``indices``.

        Values meet their numbers in a join, in which frequent ones are split.
        """
        rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "rows-to-encode")
        key = ["source", "value"]
        held = _values(rows, self.columns, self.lists, "_row")
        found = hot_join(held, self.dictionary.select(*key, "idx"), self.dictionary.select(*key, "n_rows"), key, ["_row"])
        per_row = found.groupBy("_row").agg(F.array_sort(F.collect_set(F.col("idx").cast("int"))).alias("indices"))
        return (
            rows.join(per_row, "_row", "left")
            .withColumn("indices", F.coalesce("indices", F.array().cast("array<int>")))
            .drop("_row")
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the sparse vector ``features``: rows are written as a vector is stored, and read back as one."""
        flags = F.array_repeat(F.lit(1.0), F.size("indices"))
        vector = F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(self.size).alias("size"),
            F.concat(F.array(F.lit(0)), F.col("indices")).alias("indices"),
            F.concat(F.array(F.coalesce(F.col(NUMBER), F.lit(0.0))), flags).alias("values"),
        )
        encoded = self.indexed(df).withColumn(FEATURES, vector).drop("indices")
        path = new_folder(df.sparkSession, "encoded")
        encoded.write.parquet(path)
        kept = [f for f in encoded.schema.fields if f.name != FEATURES]
        return df.sparkSession.read.schema(StructType([*kept, StructField(FEATURES, VectorUDT())])).parquet(path)

    def save(self, path: str) -> None:
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        parts = [("column", c) for c in self.columns] + [("list", c) for c in self.lists]
        spark = self.dictionary.sparkSession
        spark.createDataFrame(parts, "kind string, name string").coalesce(1).write.mode("overwrite").json(f"{path}/inputs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoders:
        dictionary = spark.read.parquet(f"{path}/dictionary")
        parts = spark.read.schema("kind string, name string").json(f"{path}/inputs").collect()
        columns, lists = ([row["name"] for row in parts if row["kind"] == kind] for kind in ("column", "list"))
        return cls(dictionary, dictionary.count() + 1, columns, lists)


def training_report(df: DataFrame) -> DataFrame:
    """``(metric, n)``: what training leaves out of an extract, counted in one pass.

    Offers without years of experience are no training rows, and a category without
    any value in the range (1) is no feature.
    """
    inside = (F.col("salary_avg") > SALARY_FLOOR) & (F.col("salary_avg") < SALARY_CEILING)
    counts = {
        "offers": F.count(F.lit(1)),
        "salary out of range": F.count_if(~inside),
        "years missing": F.count_if(inside & F.col("years_of_experience").isNull()),
        "trained on": F.count_if(inside & F.col("years_of_experience").isNotNull()),
    }
    for name in CATEGORICAL_COLUMNS:
        counts[f"unused {name}"] = (F.count_if(inside & F.col(name).isNotNull()) == 0).cast("long")
    row = df.agg(*[value.alias(f"n_{i}") for i, value in enumerate(counts.values())])
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(f"n_{i}").alias("n")) for i, m in enumerate(counts)]
    return row.select(F.inline(F.array(*pairs)))


def assemble(columns: list[str], output_col: str = FEATURES) -> VectorAssembler:
    """Columns of numbers in one vector."""
    return VectorAssembler(inputCols=columns, outputCol=output_col)
