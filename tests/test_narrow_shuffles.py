"""Skills of orders and customers, which go through shuffles as numbers."""

from datetime import datetime

import pytest

from offermarket.bindings import tables
from offermarket.bindings.tables import Market

LINES = [(1, 10), (1, 10), (1, 11), (1, 12), (2, 12), (3, 10), (3, 99), (None, 11), (4, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Parts 10 and 11 are one skill; part 10 comes twice, an order has no customer and a part no key."""
    path = tmp_path_factory.mktemp("market")
    day = datetime(1997, 5, 1)
    frames = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": (
            [(7, "c7", 0, 10.0, "BUILDING"), (8, "c8", 0, 10.0, "AUTO"), (9, "c9", 0, 1.0, "AUTO")],
            "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        ),
        "part": (
            [(11, "bolt", "B", "T"), (10, "bolt", "B", "T"), (10, "bolt", "B", "T"), (12, "ring", None, "T"), (None, "gear", "B", "T")],
            "p_partkey long, p_name string, p_brand string, p_type string",
        ),
        "orders": (
            [(1, 7, "O", 5.0, day, "1"), (2, 7, "O", 6.0, day, "1"), (3, 8, "F", 7.0, day, "2"), (4, None, "O", 8.0, day, "2")],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        ),
        "lineitem": (LINES, "l_orderkey long, l_partkey long"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("bound", [1 << 27, 0])
def test_skills_of_jobs_and_profiles(spark, monkeypatch, folder, bound):
    """With bound 0 parts are not broadcast."""
    monkeypatch.setattr(tables, "BROADCAST_BYTES", bound)
    m = Market(spark, folder)
    names = {r.id: r.name for r in m.skills.collect()}
    assert sorted((r.job_id or "", names[r.skill_id]) for r in m.job_skills.collect()) == [
        ("", "B bolt"), ("1", "B bolt"), ("1", "ring"), ("2", "ring"), ("3", "B bolt")
    ]
    assert {r.profile_id: sorted(r.skills) for r in m.profiles.collect()} == {7: ["B bolt", "ring"], 8: ["B bolt"], 9: []}
    assert sorted((r.job_id, r.skill_name) for r in m.rows.collect()) == [("1", "B bolt"), ("1", "ring"), ("2", "ring"), ("3", "B bolt")]


def test_lines_are_shuffled_without_names_and_keys(spark, folder):
    """Names and digests of skills join after the shuffle, and skills are not repeated by a salt."""
    plan = Market(spark, folder).rows._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and "_salt" not in plan
    assert not any("skill_id#" in line for line in exchanges)
