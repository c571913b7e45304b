"""Keys, first-wins and skew helpers."""

from conftest import rows
from pyspark.sql import functions as F

from offermarket.operators import conform, merge, quality
from offermarket.skew import blocked_row_number, hot_join, salted_lookup, sized_join
from offermarket.sources.warehouse import jdbc_options


def test_first_wins_ignores_partitioning(spark):
    data = [(k, i, f"{k}-{i}") for k in ("a", "b", None) for i in range(20)]
    df = spark.createDataFrame(data, "k string, i int, v string")
    for parts in (1, 3, 7):
        shuffled = df.repartition(parts, F.xxhash64("v", F.lit(parts)))
        first = merge.first_wins(shuffled, ["k"], ["i"])
        assert rows(first.filter("k is not null"), "k", "i") == [("a", 0), ("b", 0)]
        assert first.filter("k is null").count() == 20


def test_insert_if_absent(spark):
    target = spark.createDataFrame([("a", "x"), (None, "x")], "k string, s string")
    incoming = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 2), ("a", "y", 1), (None, "x", 1), (None, "x", 1)],
        "k string, s string, i int",
    )
    new = merge.insert_if_absent(target, incoming, ["k", "s"], ["i"])
    assert rows(new) == [("a", "y", 1), (None, "x", 1), (None, "x", 1)]


def test_keys(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", "c", 3)], "x string, y string, arrival int")
    keyed = conform.assign_keys(df, ["x", "y"], load_id="l1")
    assert keyed.select("id").distinct().count() == 3
    other = conform.assign_keys(df, ["x", "y"], load_id="l2")
    same = keyed.select("id").intersect(other.select("id"))
    assert same.count() == 1


def test_defaults_only_for_columns_not_given(spark):
    df = spark.createDataFrame([("1", None)], "id string, salary_currency string")
    row = conform.apply_defaults(df).first()
    assert row.salary_currency is None and row.salary_is_predicted is False
    assert row.created_at is not None


def test_broken_rules_are_counted(spark):
    countries = spark.createDataFrame(
        [("1", "FR", None), ("2", "FR", "x" * 101), ("3", None, "y"), ("4", None, "z")],
        "id string, code string, name string",
    )
    skills = spark.createDataFrame([("1", "a")], "id string, name string")
    bridge = spark.createDataFrame(
        [("9", "1"), ("9", "1"), ("9", "7")], "job_id string, skill_id string"
    )
    tables = {"countries": countries, "skills": skills, "job_skills": bridge}
    broken = quality.check_constraints(tables).filter("n_violations > 0")
    assert rows(broken, "table", "rule", "n_violations") == [
        ("countries", "length name <= 100", 1),
        ("countries", "not null name", 1),
        ("countries", "unique code", 1),
        ("job_skills", "foreign key skill_id", 1),
        ("job_skills", "unique job_id, skill_id", 1),
    ]


def test_skewed_joins_keep_every_row(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id"
    )
    lookup = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k3", 3)], "k string, v int"
    )
    plain = rows(facts.join(lookup, "k"), "id", "v")
    assert rows(salted_lookup(facts, lookup, ["k"], ["id"]), "id", "v") == plain
    counts = facts.groupBy("k").agg(F.count("*").alias("n_rows"))
    assert rows(hot_join(facts, lookup, counts, ["k"], ["id"]), "id", "v") == plain
    left = salted_lookup(facts, lookup.filter("v = 3"), ["k"], ["id"], how="left")
    assert left.count() == 3000
    for limit in (0, 1000):
        assert rows(sized_join(facts, lookup, ["k"], ["id"], limit), "id", "v") == plain


def test_hot_left_join_keeps_null_keys(spark):
    facts = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "cold").alias("k"), "id"
    )
    lookup = spark.createDataFrame([("hot", 1), (None, 5)], "k string, v int")
    counts = facts.filter("k is not null").groupBy("k").agg(F.count("*").alias("n_rows"))
    for share in (0.001, 0.9):
        got = hot_join(facts, lookup, counts, ["k"], ["id"], how="left", share=share)
        assert rows(got, "id", "v") == rows(facts.join(lookup, "k", "left"), "id", "v")


def test_blocked_row_number(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("o"))
    numbered = blocked_row_number(df, ["k"], "o", "n", block=50)
    for key in range(3):
        got = numbered.filter(F.col("k") == key).orderBy("o").select("n").collect()
        assert [row.n for row in got] == list(range(1, len(got) + 1))


def test_jdbc_options():
    base = {"url": "jdbc:postgresql://h/db"}
    assert jdbc_options("jobs", base)["dbtable"] == "jobs"
    assert jdbc_options("SELECT 1;", base)["query"] == "SELECT 1"
    split = {**base, "partitionColumn": "id", "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}
    assert jdbc_options("select * from jobs", split)["dbtable"] == "(select * from jobs) AS derived"
