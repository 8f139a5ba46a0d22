"""The catalogue: datasets, their columns, cleaning logs, experiments, chats and workspaces as Parquet tables.

Every write goes into a `batch_id` partition that it replaces as a whole, so that a write repeated
after a failure leaves the same rows behind.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.scalars import json_payload, new_id, now
from larkspur.operators.profile import STATS_TYPE
from larkspur.operators.steps import Log
from larkspur.plans.automl import AutoTrain, TrainResult, leaderboard_rank, save_model
from larkspur.plans.cleaning import log_frame

# The catalogue tables.
SCHEMAS = {
    "datasets": "id string, workspace_id string, original_name string, storage_path string, file_size bigint, "
    "file_format string, status string, row_count bigint, column_count int, profile string, error string, "
    "created_at timestamp, parent_id string",
    "dataset_columns": "dataset_id string, position int, column_name string, data_type string, is_nullable boolean, "
    f"null_count bigint, unique_count bigint, sample_values array<string>, stats {STATS_TYPE}",
    "pipeline_logs": "id string, dataset_id string, step_name string, step_order int, applied_changes string, "
    "created_at timestamp",
    "ml_experiments": "id string, dataset_id string, target_column string, task_type string, model_type string, "
    "metrics map<string,double>, hyperparams string, artifact_path string, "
    "feature_importance map<string,double>, train_time_sec double, created_at timestamp",
    "workspaces": "id string, owner_id string, name string, created_at timestamp",
    "chat_sessions": "id string, workspace_id string, dataset_id string, title string, created_at timestamp",
    "chat_messages": "id string, session_id string, role string, content string, tool_calls string, "
    "token_usage map<string,int>, provider_used string, created_at timestamp",
}

#: Tables that are looked up by this column lie in a folder for each of its values.
FOLDERS = {"datasets": "workspace_id"}


class Catalog:
    """Tables under `root`, which must be reachable by every executor."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- storage --------------------------------------------------------------------------------

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def append(self, table: str, rows: DataFrame, batch: str | None = None) -> str:
        """Write rows, columns matched by name and missing ones null; repeating a batch replaces it."""
        batch = batch or uuid.uuid4().hex
        known = T.StructType.fromDDL(SCHEMAS[table])
        columns = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in known
        ]
        # Straight into its own folder: batches written at the same time do not meet.
        writer = rows.select(*columns).write.mode("overwrite")
        writer = writer.partitionBy(FOLDERS[table]) if table in FOLDERS else writer
        writer.parquet(f"{self.path(table)}/batch_id={batch}")
        return batch

    def read(self, table: str, with_batch: bool = False) -> DataFrame:
        schema = SCHEMAS[table] + ", batch_id string"
        try:
            found = self.spark.read.schema(schema).parquet(self.path(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], schema)
        names = T.StructType.fromDDL(schema).names
        return found.select(*(names if with_batch else names[:-1]))

    # --- writers --------------------------------------------------------------------------------

    def write_columns(self, profiles: DataFrame, samples: DataFrame | None = None, batch: str | None = None) -> str:
        """One row per column from a profile by `dataset_id`, with the most frequent values if given."""
        rows = profiles.withColumnRenamed("dtype", "data_type").withColumn("is_nullable", F.lit(True))
        if samples is not None:
            values = samples.groupBy("dataset_id", "column_name").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"])
                .alias("sample_values")
            )
            rows = rows.join(values, ["dataset_id", "column_name"], "left")
        return self.append("dataset_columns", rows, batch)

    def write_datasets(self, files: DataFrame, columns: DataFrame, batch: str | None = None) -> str:
        """One row per file: counts and profile JSON from its columns, status and error from `files`."""
        entry = F.struct(
            "position",
            F.col("column_name").alias("name"),
            F.col("data_type").alias("dtype"),
            "null_count",
            "unique_count",
            "stats",
        )
        found = columns.groupBy(F.col("dataset_id").alias("id")).agg(
            F.count("*").cast("int").alias("column_count"),
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("position")).alias("columns"),
        )
        parts = {k: F.col(k) for k in ("row_count", "column_count", "columns")}
        profile = F.when(F.col("column_count").isNotNull(), json_payload(**parts))
        rows = files.join(found, "id", "left").withColumn("profile", profile).withColumn("created_at", now())
        return self.append("datasets", rows, batch)

    def write_pipeline_log(self, dataset_id: str, logs: list[Log], batch: str | None = None) -> str:
        rows = log_frame(self.spark, logs)
        return self.append(
            "pipeline_logs",
            rows.withColumns({"id": new_id(), "dataset_id": F.lit(dataset_id), "created_at": now()}),
            batch,
        )

    def write_snapshot(self, df: DataFrame, name: str) -> str:
        """A transformed dataset as Parquet under `snapshots/`; returns its path."""
        path = f"{self.root}/snapshots/{name}"
        df.write.mode("overwrite").parquet(path)
        return path

    def write_experiments(
        self, dataset_id: str, trained: AutoTrain, artifacts: dict[str, str] | None = None, batch: str | None = None
    ) -> str:
        """One row per trained estimator, with the hyper-parameters it ran with."""
        rows = [
            (
                dataset_id, trained.target, trained.task, r.name, r.metrics,
                json.dumps(r.hyperparams), (artifacts or {}).get(r.name),
                r.feature_importance, r.train_time_sec,
            )
            for r in trained.results
        ]
        schema = (
            "dataset_id string, target_column string, task_type string, model_type string, "
            "metrics map<string,double>, hyperparams string, artifact_path string, "
            "feature_importance map<string,double>, train_time_sec double"
        )
        frame = self.spark.createDataFrame(rows, schema).withColumns({"id": new_id(), "created_at": now()})
        return self.append("ml_experiments", frame, batch)

    def save_best(self, dataset_id: str, best: TrainResult) -> str:
        return save_model(best.model, f"{self.root}/models/{dataset_id}-{best.name}-{uuid.uuid4().hex}")

    # --- readers --------------------------------------------------------------------------------

    def list_datasets(self, workspace_id: str) -> DataFrame:
        """Datasets of a workspace, newest first."""
        return newest_first(scope(self.read("datasets"), workspace_id))

    def get_by_id(self, dataset_id: str, workspace_id: str) -> DataFrame:
        """One dataset; that of another workspace looks missing."""
        return get_by_id(self.read("datasets"), dataset_id, workspace_id)

    def dataset_detail(self, dataset_id: str | None = None, workspace_id: str | None = None) -> DataFrame:
        """Datasets with their columns as an array."""
        datasets = self.read("datasets")
        if workspace_id is not None:
            datasets = scope(datasets, workspace_id)
        if dataset_id is not None:
            datasets = datasets.where(F.col("id") == dataset_id)
        return dataset_detail(datasets, self.read("dataset_columns"))

    def pipeline_logs(self, dataset_id: str) -> DataFrame:
        logs = self.read("pipeline_logs").where(F.col("dataset_id") == dataset_id)
        return logs.orderBy("created_at", "step_order")

    def leaderboard_for(self, dataset_id: str) -> DataFrame:
        """Experiments of a dataset with importances, ranked."""
        return leaderboard_for(self.read("datasets"), self.read("ml_experiments"), dataset_id)

    def session_messages(self, session_id: str | None = None) -> DataFrame:
        return session_messages(self.read("chat_messages"), session_id)

    def primary_workspaces(self) -> DataFrame:
        return primary_workspace(self.read("workspaces"))


# --- lookups over any tables of these shapes ----------------------------------------------------


def scope(df: DataFrame, workspace_id: str) -> DataFrame:
    return df.where(F.col("workspace_id") == workspace_id)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), "id")


def get_by_id(df: DataFrame, dataset_id: str, workspace_id: str) -> DataFrame:
    return scope(df, workspace_id).where(F.col("id") == dataset_id)


def dataset_detail(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """Each dataset with an array of its column profiles; missing counts are 0."""
    entry = F.struct(
        "position",
        F.col("column_name").alias("name"),
        F.col("data_type").alias("dtype"),
        F.coalesce("null_count", F.lit(0)).alias("null_count"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        "sample_values",
        "stats",
    )
    listed = columns.groupBy(F.col("dataset_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("position")).alias("columns")
    )
    return datasets.join(listed, "id", "left")


def leaderboard_for(datasets: DataFrame, experiments: DataFrame, dataset_id: str | None = None) -> DataFrame:
    if dataset_id is not None:
        datasets = datasets.where(F.col("id") == dataset_id)
        experiments = experiments.where(F.col("dataset_id") == dataset_id)
    named = datasets.select(F.col("id").alias("dataset_id"), "original_name")
    ranked = leaderboard_rank(experiments).join(named, "dataset_id")
    return ranked.orderBy("dataset_id", "task_type", "rank")


def session_messages(messages: DataFrame, session_id: str | None = None) -> DataFrame:
    """The chat log in time order, of one session or session by session."""
    if session_id is not None:
        messages = messages.where(F.col("session_id") == session_id)
    return messages.orderBy("session_id", "created_at")


def primary_workspace(workspaces: DataFrame) -> DataFrame:
    """The oldest workspace of every owner; equal times by id.

    A grouped minimum, which shrinks an owner's workspaces before the shuffle.
    """
    others = [c for c in workspaces.columns if c not in ("owner_id", "created_at", "id")]
    first = F.min(F.struct("created_at", "id", *others)).alias("first")
    return workspaces.groupBy("owner_id").agg(first).select("owner_id", "first.*")
