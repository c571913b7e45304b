"""The salary model on offers whose salary follows a known rule."""

import json
import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from offermarket import staging
from offermarket.bindings import queries
from offermarket.bindings.tables import Market
from offermarket.operators import dialogue, features, model
from offermarket.plans import pricing
from offermarket.vocabulary import BOOSTED_GRID, FOREST_GRID, PREDICTION_FAILED, SEARCH_DRAWS, SEARCH_FOLDS

FOREST = {"numTrees": [8], "maxDepth": [5], "minInstancesPerNode": [1, 2], "featureSubsetStrategy": ["sqrt"]}
BOOSTED = {
    "maxIter": [10], "maxDepth": [4], "stepSize": [0.1], "subsamplingRate": [0.9],
    "featureSubsetStrategy": ["1.0"], "minInstancesPerNode": [1, 3],
}


@pytest.fixture(scope="module")
def extract(spark):
    number = F.col("id")
    skills = F.filter(
        F.array(F.when(number % 2 == 0, "SQL"), F.when(number % 3 == 0, "Python"), F.lit("Excel")),
        lambda s: s.isNotNull(),
    )
    title = F.when(number < 5, "Rare").when(number % 2 == 0, "Analyst").otherwise("Engineer")
    salary = 30000 + 20000 * (number % 2) + 3000 * (number % 10) + 15000 * (number % 3 == 0).cast("int")
    return spark.range(600).select(
        number.cast("string").alias("id"),
        title.alias("job_title"),
        salary.cast("decimal(12,2)").alias("salary_avg"),
        F.lit("Senior").alias("experience_level"),
        F.when(number != 17, number % 10).cast("int").alias("years_of_experience"),
        (number % 5 == 0).alias("is_remote_friendly"),
        F.when(number % 7 != 0, "Data").alias("job_category"),
        F.lit(None).cast("string").alias("employment_type"),
        F.lit("S").alias("company_size"),
        F.lit("Finance").alias("industry"),
        F.when(number % 4 == 0, "France").otherwise("Germany").alias("country"),
        skills.alias("skills"),
    )


@pytest.fixture(scope="module")
def trained(extract):
    return pricing.train_models(
        extract, n_iter=2, folds=2, forest_grid=FOREST, boosted_grid=BOOSTED, n_reduced=6
    )


def test_boosted_beats_the_mean(extract, trained):
    values = {(r.model, r.metric): r.value for r in trained.metrics.collect()}
    mean = extract.agg(F.avg(F.col("salary_avg").cast("double"))).first()[0]
    spread = extract.agg(F.avg(F.abs(F.col("salary_avg").cast("double") - mean))).first()[0]
    assert values["boosted", "mae"] < spread / 2
    assert values["linear", "r2"] > 0.8
    assert {name for name, _ in values} == {"forest", "linear", "boosted", "reduced forest"}
    assert all(math.isfinite(value) for value in values.values())


def test_importances_have_names(trained):
    names = [row.feature for row in trained.importances.collect()]
    assert "years_of_experience" in names and len(names) == 6


def test_saved_model_predicts_the_same(extract, trained, tmp_path):
    path = str(tmp_path / "model")
    model.save_model(trained.pipeline, path)
    before = rows(model.score_salary(extract, trained.pipeline), "id", "predicted_salary")
    after = rows(model.score_salary(extract, model.load_model(path)), "id", "predicted_salary")
    assert before == after


def test_unseen_values_do_not_fail(spark, extract, trained):
    request = extract.filter("id = 8").withColumn("country", F.lit("Atlantis")).withColumn(
        "skills", F.array(F.lit("Cobol"), F.lit("SQL"))
    ).withColumn("years_of_experience", F.lit(None).cast("int"))
    row = model.score_salary(request, trained.pipeline).first()
    assert math.isfinite(row.predicted_salary)
    assert row.country == "Atlantis" and row.skills == ["Cobol", "SQL"]
    known = model.score_salary(request, trained.pipeline, known_titles=["Analyst", "Other"])
    assert math.isfinite(known.first().predicted_salary)


def test_features(extract):
    data = model.training_rows(extract)
    assert data.count() == 599
    encoders = model.fit_features(data)
    names = {r.idx: r.feature for r in encoders.names().collect()}
    assert sorted(names) == list(range(encoders.size)) and len(set(names.values())) == encoders.size
    assert not any(name.startswith("employment_type") for name in names.values())
    assert {n for n in names.values() if n.startswith("skills")} == {f"skills_flags_{s}" for s in ("Excel", "Python", "SQL")}
    encoded = {r.id: r for r in encoders.transform(data).collect()}
    assert len(encoded) == 599
    for number in (7, 6, 35):
        row = encoded[str(number)]
        assert row.features.size == encoders.size and list(row.features.indices) == sorted(set(row.features.indices))
        flags = {names[i] for i in row.features.indices if i}
        wanted = {f"skills_flags_{s}" for s in row.skills}
        columns = ["job_title", "experience_level", "is_remote_friendly", "job_category", "company_size", "industry", "country"]
        wanted |= {f"{c}_flags_{row[c]}" for c in columns if row[c] is not None}
        assert flags == wanted and row.features[0] == number % 10
    assert encoded["7"].job_category is None


def test_dictionary_of_hot_unseen_and_missing_values(spark):
    data = [(i, "hot" if i % 2 else f"v{i}", ["s"] * 2 + [f"s{i % 3}"] if i % 5 else None, float(i)) for i in range(200)]
    rows_ = spark.createDataFrame(data, "id int, country string, skills array<string>, years_of_experience double")
    encoders = features.Encoders.fit(rows_, ["country"], ["skills"])
    assert encoders.size == 1 + 101 + 4
    other = spark.createDataFrame([(1, "unseen", ["s", "unseen"], None), (2, None, None, 5.0), (2, None, None, 5.0)], rows_.schema)
    by_name = {r.feature: r.idx for r in encoders.names().collect()}
    got = sorted((r.id, r.features.toArray().nonzero()[0].tolist()) for r in encoders.transform(other).collect())
    assert got == [(1, [by_name["skills_flags_s"]]), (2, [0]), (2, [0])]
    empty = features.Encoders.fit(rows_.limit(0), ["country"], ["skills"])
    assert empty.size == 1 and empty.transform(other).first().features.size == 1


def test_rare_titles(extract):
    counts = dict(rows(features.bucket_rare(extract).groupBy("job_title").count()))
    assert counts == {"Other": 5, "Analyst": 297, "Engineer": 298}


def test_range_is_strict(extract):
    edge = extract.limit(2).withColumn("salary_avg", F.lit(5000).cast("decimal(12,2)"))
    assert features.salary_range(edge).count() == 0


def test_split_is_stable(extract):
    one = rows(features.split_train_test(extract)[0], "id")
    other = rows(features.split_train_test(extract.repartition(7))[0], "id")
    assert one == other and 400 < len(one) < 560


def test_grids_are_accepted():
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    drawn = model.sampled_grid(FOREST_GRID, 20, 42)
    assert len(drawn) == 20 and drawn == model.sampled_grid(FOREST_GRID, 20, 42)
    for setting in drawn:
        model._set(RandomForestRegressor(), setting)
    boosted = model.sampled_grid(BOOSTED_GRID, 20, 42)
    assert len({str(setting) for setting in boosted}) == 20
    for setting in boosted:
        model._set(GBTRegressor(), setting)


def test_settings_that_differ_in_size_are_one_fit():
    drawn = [{"numTrees": n, "maxDepth": d} for n, d in [(5, 3), (9, 3), (5, 4), (7, 3)]]
    assert model._paths(drawn, "numTrees") == [({"maxDepth": 3}, [5, 7, 9]), ({"maxDepth": 4}, [5])]


def test_paths_give_the_error_of_every_size(spark, extract, monkeypatch):
    data = pricing.TrainingSet.of(extract)
    folds = model.staged_folds(data.train, 3, 42)
    assert folds.rdd.getNumPartitions() == 1 and {r.fold for r in folds.select("fold").distinct().collect()} == {0, 1, 2}
    fit, held = folds.filter("fold <> 0"), folds.filter("fold = 0")
    params = {"maxDepth": 5, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt"}
    one = model.forest_path(fit, held, params, [6], 42)
    path = model.forest_path(fit, held, params, [6, 10], 42)
    assert path[6] == pytest.approx(one[6]) and set(path) == {6, 10}
    params = {"maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0", "minInstancesPerNode": 1}
    # Rounds build on each other: a shorter boosting is the beginning of a longer one.
    assert model.boosted_path(fit, held, params, [3, 6], 42)[3] == pytest.approx(model.boosted_path(fit, held, params, [3], 42)[3])


def test_training_rows_of_a_task_are_bounded(spark, extract, monkeypatch):
    """Files that Spark would pack into few partitions are dealt by rows, in the same order whatever was before."""
    monkeypatch.setattr(model, "ROWS_PER_TASK", 50)
    train = pricing.TrainingSet.of(extract).train
    folds = model.staged_folds(train.repartition(16), 3, 42)
    per_task = [len(rows_) for rows_ in folds.rdd.glom().collect()]
    assert len(per_task) == -(-train.count() // 50) > 8 and max(per_task) <= 100 and sum(per_task) == train.count()
    again = model.staged_folds(train.repartition(5, "label"), 3, 42)
    assert again.collect() == folds.collect()


def test_offers_of_a_saved_model_are_read_once(spark, extract, monkeypatch, tmp_path):
    asked = []
    monkeypatch.setattr(queries, "extract", lambda m: asked.append(1) or extract)
    found = queries.save_load_model(Market(spark, str(tmp_path))).collect()
    assert len(asked) == 1 and len(found) == 599 and all(row.is_same for row in found)


def test_the_winner_has_the_least_mean_error(extract):
    data = pricing.TrainingSet.of(extract)
    grid = {**FOREST, "numTrees": [2, 6], "maxDepth": [1, 6]}
    found = model.search_forest(data.train, n_iter=8, folds=2, grid=grid)
    scores = found.scores.groupBy("setting", "params").agg(F.avg("error").alias("error"), F.count("error").alias("n")).collect()
    assert len(scores) == 8 and {r.n for r in scores} == {2}
    assert json.loads(min(scores, key=lambda r: (r.error, r.setting)).params) == found.params
    assert found.params["maxDepth"] == 6 and found.bestModel.getNumTrees == found.params["numTrees"]


def test_logged_requests(spark, trained):
    conv = spark.createDataFrame(
        [
            (1, 0, "user", "combien vais-je gagner"),
            (1, 1, "assistant", '<think>x</think><ML_PREDICT>{"job_title":"Analyst","skills":["SQL"]}</ML_PREDICT>'),
            (1, 3, "assistant", "sorry"),
        ],
        "conv_id long, turn long, role string, text string",
    )
    got = {r.turn: r for r in dialogue.score_requests(conv, trained.pipeline).collect()}
    assert set(got) == {1, 3}
    assert got[1].answer.startswith("$") and "USD/an" in got[1].answer
    assert got[3].answer.startswith(PREDICTION_FAILED) and got[3].predicted_salary is None


def test_searches_keep_to_their_budget_and_are_shared(spark, monkeypatch):
    asked = []

    def record(train, estimator, grid, n_iter, folds, *rest):
        asked.append((type(estimator).__name__, grid, n_iter, folds))
        raise InterruptedError

    monkeypatch.setattr(model, "_search", record)
    monkeypatch.setattr(queries, "_once", lambda m, name, make: make())
    monkeypatch.setattr(queries, "ruled_extract", lambda m: None)
    encoders = features.Encoders(spark.range(0).selectExpr("id as idx", "'' as source", "'' as value"), 1, [], [])
    monkeypatch.setattr(pricing.TrainingSet, "of", lambda *_, **__: pricing.TrainingSet(encoders, spark.range(1), None))
    for name in ("search_forest", "search_boosted", "feature_importance", "reduced_forest"):
        with pytest.raises(InterruptedError):
            getattr(queries, name)(None)
    forest = ("RandomForestRegressor", {**FOREST_GRID, "numTrees": [20, 30, 50]}, 4, 2)
    assert asked == [forest, ("GBTRegressor", {**BOOSTED_GRID, "maxIter": [20, 30, 50]}, 4, 2), forest, forest]
    # The operators themselves search the whole grids.
    for search in (model.search_forest, model.search_boosted):
        with pytest.raises(InterruptedError):
            search(None)
    assert [call[1:] for call in asked[4:]] == [(FOREST_GRID, SEARCH_DRAWS, SEARCH_FOLDS), (BOOSTED_GRID, SEARCH_DRAWS, SEARCH_FOLDS)]


def test_shared_results_go_with_their_staged_tables(spark, sf_dir):
    m, made = Market(spark, sf_dir), []
    ask = lambda: queries._once(m, "test", lambda: made.append(1) or len(made))
    assert ask() == ask() == 1
    monkey = staging._clearings.get(staging.application_folder(spark), 0)
    staging._clearings[staging.application_folder(spark)] = monkey + 1
    assert ask() == 2


def test_a_model_must_halve_the_error_of_the_mean(spark):
    labels = spark.createDataFrame([(1.0,), (3.0,)], "label double")
    data = pricing.TrainingSet(None, labels, labels)
    for offset, halves in [(0.0, False), (0.5, False), (0.51, True), (-0.9, False)]:
        # The mean, 2, misses each by 1.
        guess = labels.withColumn("prediction", 2.0 - F.signum(2.0 - F.col("label")) * offset)
        row = queries._halves_error(data, guess, "any").first()
        assert row.n_rows == 2 and row.halves_error is halves
