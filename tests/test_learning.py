"""Training, selection, registry, scoring and streaming."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobsight.operators import features, registry, train
from jobsight.operators.train import TrainConfig
from jobsight.plans import workflows

SMALL = {"forest_trees": 5, "boosting_rounds": 2, "max_iterations": 20}
GROUPS = ["complete"] * 45 + ["cancelled"] * 30 + ["active"] * 15
TEAMS = ["Team A", "Team B", "Team C"]


@pytest.fixture(scope="module")
def class_rows(spark):
    return spark.createDataFrame(
        [(GROUPS[i], 1000 + 3 * i, 500 + 2 * i, TEAMS[i % 3]) for i in range(90)],
        "status_group string, budget_revenue long, budget_cost long, related_contacts string")


@pytest.fixture(scope="module")
def trained(spark, class_rows, tmp_path_factory):
    store = registry.Registry(spark, str(tmp_path_factory.mktemp("registry")))
    with pytest.raises(LookupError):
        store.active()
    done = workflows.train_model(class_rows, "Status Group", store, config=TrainConfig("", **SMALL))
    return store, done


def test_classification_trains(trained):
    _, done = trained
    assert done["experiment"]["task_type"] == "classification" and "f1_weighted" in done["result"].metrics
    results = done["result"].results
    assert [r["model_name"] for r in results] == [
        "logistic_regression", "random_forest", "gradient_boosting", "hist_gradient_boosting"]
    assert all(r["error"] is None for r in results)
    assert (done["result"].train_rows, done["result"].test_rows) == (72, 18)


def test_regression_trains(spark):
    df = spark.createDataFrame(
        [(250.0 + 8 * i, 600.0 + 12 * i, float(i % 9 + 1), TEAMS[i % 3]) for i in range(90)],
        "budget_cost double, budget_revenue double, scaffold_height double, related_contacts string")
    done = workflows.train_model(df, "budget_cost", task_type="regression", config=TrainConfig("", **SMALL))
    assert done["task_type"] == "regression" and done["result"].metrics["r2"] > 0.8
    assert done["result"].importance[0]["feature"] == "num__budget_revenue"


def test_text_target_is_no_regression_target(class_rows):
    with pytest.raises(ValueError, match="not trainable as regression"):
        workflows.train_model(class_rows, "status_group", task_type="regression")


def test_registry_and_scoring(spark, trained, class_rows):
    store, done = trained
    experiment = done["experiment"]["id"]
    assert store.active() == experiment == store.get(experiment)["id"]
    with pytest.raises(KeyError):
        store.set_active("nothing")
    store.set_active(experiment)
    records = class_rows.select(F.col("budget_revenue").cast("string").alias("Budget Revenue"), "related_contacts")
    unknown = spark.createDataFrame([(None, "Team X")], "`Budget Revenue` string, related_contacts string")
    got = workflows.predict_records(store, experiment, records.unionByName(unknown))
    assert got.columns == ["budget_revenue", "related_contacts", "prediction", "prediction_confidence"]
    rows = got.collect()
    assert len(rows) == 91 and {r.prediction for r in rows} <= set(GROUPS)
    assert all(1 / 3 - 1e-9 <= r.prediction_confidence <= 1 for r in rows)


def test_drift_and_template(trained, class_rows):
    store, done = trained
    experiment = done["experiment"]["id"]
    same = workflows.drift_check(store, experiment, class_rows).collect()
    assert {r.feature for r in same} == {"budget_revenue", "budget_cost", "related_contacts"}
    assert all(r.drift_score < 1e-9 for r in same)
    without = workflows.drift_check(store, experiment, class_rows.drop("budget_cost")).collect()
    assert {r.status for r in without if r.feature == "budget_cost"} == {"missing_in_current_data"}
    fields = workflows.intake_template(store, experiment, class_rows).orderBy("position").collect()
    assert [(f.field, f.type) for f in fields] == [
        ("related_contacts", "category"), ("budget_revenue", "number"), ("budget_cost", "number")]
    assert fields[0].suggested_values == TEAMS and fields[1].default_number == 1133.5


def test_missing_model_directory(spark, trained, tmp_path):
    store, done = trained
    row = store.get(done["experiment"]["id"])
    other = registry.Registry(spark, str(tmp_path / "other"))
    row["model_path"] = str(tmp_path / "gone")
    other._append("experiments", [tuple(row[part.split()[0]] for part in registry.EXPERIMENTS.split(", ")) ], registry.EXPERIMENTS)
    with pytest.raises(FileNotFoundError):
        other.load(row["id"])


def test_failing_candidate_is_recorded(class_rows):
    class Broken:
        def fit(self, _):
            raise RuntimeError("no luck")

    def models(config, rows, classes):
        good = train.candidate_models(config, rows, classes)["random_forest"]
        return {"broken": Broken(), "random_forest": good}

    config = TrainConfig("classification", **SMALL)
    result = train.train_and_select(class_rows, "status_group", config, models=models)
    assert result.best_model_name == "random_forest" and result.results[0]["error"] == "no luck"
    with pytest.raises(RuntimeError, match="No candidates completed"):
        train.train_and_select(class_rows, "status_group", config, models=lambda *_: {"broken": Broken()})


def test_feature_plan(spark):
    rows = [(f"id{i}", f"2024-01-{1 + i % 28:02d}", "common" if i % 100 else "odd", None if i % 4 else float(i), "", i % 2)
            for i in range(400)]
    df = spark.createDataFrame(rows, "code string, booked_on string, kind string, size double, due_time string, y long")
    plan = features.plan_features(df, "y")
    assert plan.date_columns == ["booked_on"]
    plan = features.fit_imputation(features.expand_dates(df, plan.date_columns), plan)
    assert plan.medians["size"] == 198.0 and plan.modes["kind"] == "common"
    assert plan.frequent["kind"] == ["common", "odd"] and "kind" in plan.categorical
    more = df.unionByName(spark.createDataFrame([("x", "bad", "new", None, None, 1)], df.schema))
    ready = features.imputed(more, plan).where("cat__kind is null").collect()
    assert len(ready) == 1 and ready[0].num__size == 198.0
    rare = features.FeaturePlan(categorical=["kind"])
    rare = features.fit_imputation(df.withColumn("kind", F.when(F.col("code") == "id7", "lone").otherwise(F.col("kind"))), rare)
    assert rare.rare["kind"] == ["lone"]
    assert features.FeaturePlan.from_json(plan.to_json()) == plan


def test_every_job_is_predicted(spark, monkeypatch):
    """The registered prediction takes each job of the table, not one of every client."""
    from types import SimpleNamespace

    from catalog import base, learning

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(learning, "classifier", lambda *_: (SimpleNamespace(active=lambda: None), None))
    monkeypatch.setattr(learning.workflows, "predict_records", lambda store, model, rows: rows)
    given = base.QUERIES["m12_m15_predict_records"](spark, sf)
    jobs = {r["project_no"] for r in base.raw_jobs(spark, sf).select("project_no").collect()}
    ids = [r["job_id"] for r in given.select("job_id").collect()]
    assert len(ids) == len(jobs) and set(ids) == jobs
