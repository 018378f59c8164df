"""Experiment registry: an append-only table, a model directory per experiment and the pointer
to the active model (M11-M14)."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from jobsight.session import path_exists

EXPERIMENTS = (
    "id string, created_at timestamp, dataset_path string, target_column string, task_type string, "
    "total_rows long, total_columns long, best_model_name string, metric_name string, metric_value double, "
    "model_path string, metadata string"
)
POINTERS = "experiment_id string, set_at timestamp"
SUMMARY = [
    "id", "created_at", "dataset_path", "target_column", "task_type", "best_model_name", "metric_name",
    "metric_value", "total_rows", "total_columns",
]


# --- table forms: any experiments and pointers DataFrame ---------------------------------------

def newest_experiments(experiments: DataFrame, limit: int = 100) -> DataFrame:
    """T5."""
    return experiments.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def experiment_summary(experiments: DataFrame) -> DataFrame:
    """The ten summary columns."""
    return experiments.select(*SUMMARY)


def resolve_active(experiments: DataFrame, pointers: DataFrame) -> DataFrame:
    """One row with the active experiment: the newest pointer if it names an experiment,
    otherwise the newest experiment; no row without experiments."""
    last = pointers.agg(F.max_by("experiment_id", "set_at").alias("id"))
    chosen = experiments.join(last, "id", "left_semi").select("id", F.lit(0).alias("choice"))
    newest = newest_experiments(experiments, 1).select("id", F.lit(1).alias("choice"))
    return chosen.unionByName(newest).orderBy("choice").limit(1).select(F.col("id").alias("active_experiment_id"))


def overview(experiments: DataFrame, pointers: DataFrame) -> DataFrame:
    """Number of experiments, time of the last one and the active model's score."""
    active = resolve_active(experiments, pointers).withColumnRenamed("active_experiment_id", "id")
    score = experiments.join(active, "id", "left_semi")
    column = lambda c: score.agg(F.max(c)).scalar().alias(f"active_{c}")
    return experiments.agg(
        F.count(F.lit(1)).alias("experiments"), F.max("created_at").alias("last_created_at")
    ).select("*", column("target_column"), column("metric_name"), column("metric_value"))


# --- the stored registry -----------------------------------------------------------------------

class Registry:
    """Experiments below one root folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def experiments(self) -> DataFrame:
        return self._read("experiments", EXPERIMENTS)

    def pointers(self) -> DataFrame:
        return self._read("active", POINTERS)

    def register(self, model: PipelineModel, **record) -> dict:
        """Save the model, then append its row; a row therefore always has a model."""
        experiment_id = str(uuid.uuid4())
        path = f"{self.root}/models/{experiment_id}"
        model.save(path)
        row = {"id": experiment_id, "created_at": datetime.now(timezone.utc), "model_path": path, **record}
        names = [part.split()[0] for part in EXPERIMENTS.split(", ")]
        self._append("experiments", [tuple(row[n] for n in names)], EXPERIMENTS)
        return row

    def list(self, limit: int = 100) -> DataFrame:
        return newest_experiments(self.experiments(), limit)

    def get(self, experiment_id: str) -> dict:
        found = self.experiments().where(F.col("id") == experiment_id).head()
        if found is None:
            raise KeyError(f"Experiment '{experiment_id}' not found.")
        return found.asDict()

    def load(self, experiment_id: str) -> tuple[PipelineModel, dict]:
        """M12."""
        record = self.get(experiment_id)
        if not path_exists(self.spark, record["model_path"]):
            raise FileNotFoundError(f"Model file missing: {record['model_path']}")
        return PipelineModel.load(record["model_path"]), record

    def set_active(self, experiment_id: str) -> None:
        self.get(experiment_id)
        self._append("active", [(experiment_id, datetime.now(timezone.utc))], POINTERS)

    def active(self) -> str:
        found = resolve_active(self.experiments(), self.pointers()).head()
        if found is None:
            raise LookupError("No model experiments found. Train a model first.")
        return found.active_experiment_id
