"""The hand-worked API load, in one go and incrementally."""

import os

import pytest
from conftest import rows
from fixtures import PAGES, offer, write_pages

from offermarket.operators import merge, quality
from offermarket.plans.loading import Warehouse, load_pages
from offermarket.sources.feeds import read_offer_pages
from offermarket.streaming.ingest import ingest_incremental


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    return write_pages(str(tmp_path_factory.mktemp("landing")))


@pytest.fixture(scope="module")
def loaded(spark, landing, tmp_path_factory):
    warehouse = Warehouse(spark, str(tmp_path_factory.mktemp("w") / "warehouse"))
    return warehouse, dict(rows(load_pages(warehouse, landing, "one")))


def test_pages(spark, landing):
    offers = read_offer_pages(spark, landing)
    ordered = offers.orderBy("arrival").select("id", "what", "page", "pos").collect()
    assert [(r.id, r.what) for r in ordered][:2] == [("a1", "data scientist"), ("a1", "data analyst")]
    assert [r.pos for r in ordered] == [0, 0, 0, 1, 2, 3]


def test_report(loaded):
    assert loaded[1] == {
        "read": 6, "accepted": 6, "rejected": 0, "inserted": 5, "duplicate": 1,
        "job_skills inserted": 2,
    }


def test_dimensions(loaded):
    tables = loaded[0].tables()
    assert rows(tables["countries"], "name", "code") == [("France", None), ("United Kingdom", None)]
    names = tables["companies"].join(
        tables["countries"].withColumnRenamed("name", "country").withColumnRenamed("id", "country_id"),
        "country_id",
    )
    assert set(rows(names, "name", "country")) == {
        ("Acme", "United Kingdom"), ("Acme Ltd", "United Kingdom"), ("Gamma", "France"),
    }
    assert names.count() == 3


def test_offers(loaded):
    jobs = loaded[0].table("jobs")
    a1 = jobs.filter("external_id = 'a1'").first()
    assert (a1.salary_currency, str(a1.posted_date), a1.salary_is_predicted) == (
        "GBP", "2026-07-01", True,
    )
    a2 = jobs.filter("external_id = 'a2'").first()
    assert (a2.salary_currency, str(a2.posted_date), a2.salary_is_predicted, a2.company_id) == (
        "USD", "2026-07-01", False, None,
    )
    assert jobs.filter("external_id = 'a3'").first().country_id is None
    assert jobs.select("id").distinct().count() == 5
    acme = loaded[0].table("companies").filter("name = 'Acme'").first()
    assert a1.company_id == acme.id
    assert quality.check_constraints(loaded[0].tables()).filter("n_violations > 0").count() == 0


def test_loading_again_adds_only_offers_without_a_key(spark, landing, loaded):
    warehouse = loaded[0]
    report = dict(rows(load_pages(warehouse, landing, "two")))
    assert report["inserted"] == 2
    assert warehouse.table("jobs").select("id").distinct().count() == 7
    assert warehouse.table("companies").count() == 3


def test_offer_without_title_is_rejected(spark, tmp_path):
    pages = {("us", "data engineer", 1): [offer("t1", ["US"], "A", title=None), offer("t2", ["US"], "A")]}
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    report = dict(rows(load_pages(warehouse, write_pages(str(tmp_path / "l"), pages), "x")))
    assert (report["rejected"], report["inserted"]) == (1, 1)


def test_incremental_equals_batch(spark, tmp_path):
    """Two landings that share offers; then a batch that runs twice."""
    landing, stored = str(tmp_path / "landing"), str(tmp_path / "warehouse")
    checkpoint = str(tmp_path / "checkpoint")

    def run(target=stored, progress=checkpoint):
        ingest_incremental(spark, landing, target, progress).awaitTermination()

    first = {key: value for key, value in PAGES.items() if key[0] == "gb"}
    write_pages(landing, first)
    run()
    write_pages(landing, {key: value for key, value in PAGES.items() if key[0] == "fr"})
    write_pages(landing, {("us", "AI engineer", 1): [offer("a1", ["US"], "New"), offer("a9", ["US"], "New")]})
    run()
    run()
    warehouse = Warehouse(spark, stored)
    jobs = warehouse.table("jobs")
    assert rows(jobs.filter("external_id is not null"), "external_id") == [
        ("a1",), ("a2",), ("a3",), ("a9",),
    ]
    assert jobs.filter("external_id is null").count() == 2

    batch = Warehouse(spark, str(tmp_path / "batch"))
    load_pages(batch, landing, "all")
    assert rows(quality.table_counts(batch.tables())) == rows(
        quality.table_counts(warehouse.tables())
    )

    # Lose the note that the last batch was committed: it runs again.
    commits = os.path.join(checkpoint, "commits")
    last = max(int(name) for name in os.listdir(commits) if name.isdigit())
    before = rows(quality.table_counts(warehouse.tables()))
    os.remove(os.path.join(commits, str(last)))
    crc = os.path.join(commits, f".{last}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    run()
    assert rows(quality.table_counts(Warehouse(spark, stored).tables())) == before


def test_cascade(loaded):
    tables = loaded[0].tables()
    gone = tables["jobs"].filter("external_id = 'a1'").withColumnRenamed("id", "job_id")
    kept = merge.delete_cascade(tables["job_skills"], gone, "job_id")
    assert kept.count() == 0


def _clean(warehouse):
    return quality.check_constraints(warehouse.tables()).filter("n_violations > 0").count() == 0


def test_two_streams_keep_each_other(spark, tmp_path):
    """Landings of their own, each with its checkpoint; then a checkpoint that was lost."""
    stored = str(tmp_path / "warehouse")

    def run(landing, checkpoint, ids, what="data engineer"):
        write_pages(str(tmp_path / landing), {("us", what, 1): [offer(i, ["US"], "Acme", description="SQL, Java") for i in ids]})
        ingest_incremental(spark, str(tmp_path / landing), stored, str(tmp_path / checkpoint)).awaitTermination()
        warehouse = Warehouse(spark, stored)
        assert _clean(warehouse)
        return rows(warehouse.table("jobs"), "external_id")

    assert run("one", "c1", ["a1", "a2"]) == [("a1",), ("a2",)]
    assert run("two", "c2", ["b1"]) == [("a1",), ("a2",), ("b1",)]
    # The first landing again with a new checkpoint: all of it is stored already, but for one offer.
    assert run("one", "c3", ["a3"], "AI engineer") == [("a1",), ("a2",), ("a3",), ("b1",)]


def test_loads_never_take_rows_from_others(spark, tmp_path):
    """The second load relies on a skill and a country of the first, which is then given again."""
    warehouse = Warehouse(spark, str(tmp_path / "w"))

    def load(name, folder, offers):
        path = write_pages(str(tmp_path / folder), {("us", "data engineer", 1): offers})
        return dict(rows(load_pages(warehouse, path, name, dictionary=["Cobol", "SQL"])))

    first = [offer("d1", ["US"], "Acme", description="Cobol")]
    report = load("day1", "l1", first)
    load("day2", "l2", [offer("d2", ["US"], "Acme", description="Cobol and SQL")])
    before = rows(quality.table_counts(warehouse.tables()))
    assert load("day1", "l3", first) == report
    with pytest.raises(ValueError, match="other rows"):
        load("day1", "l4", [offer("d1", ["US"], "Acme", description="SQL")])
    assert rows(quality.table_counts(warehouse.tables())) == before and _clean(warehouse)
    assert load("day3", "l5", [offer("d3", ["US"], "Acme", description="Cobol")])["inserted"] == 1
    assert rows(warehouse.table("skills"), "name") == [("Cobol",), ("SQL",)] and _clean(warehouse)


def test_a_load_that_broke_off_is_not_seen(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    path = write_pages(str(tmp_path / "l"), {("us", "data engineer", 1): [offer("d1", ["US"], "Acme")]})
    half = spark.createDataFrame([("x", None, "Nowhere", None)], warehouse.table("countries").schema)
    warehouse.put("countries", half, "broken")
    assert warehouse.table("countries").count() == 0
    assert dict(rows(load_pages(warehouse, path, "broken")))["inserted"] == 1
    assert rows(warehouse.table("countries"), "name") == [("United States",)] or warehouse.table("countries").count() == 1
    with pytest.raises(ValueError, match="published"):
        warehouse.put("countries", half, "broken")
