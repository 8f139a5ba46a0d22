"""Operations on a catalogued dataset, by its id within a workspace.

A dataset of another workspace looks missing to all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.charts import Chart
from larkspur.operators.profile import profile
from larkspur.plans.automl import AutoTrain, auto_train
from larkspur.plans.cleaning import Cleaning, StepCall
from larkspur.plans.tools import plot_chart, query_dataset
from larkspur.sources.catalog import Catalog


def open_dataset(catalog: Catalog, dataset_id: str, workspace_id: str) -> DataFrame:
    """The rows of a dataset; LookupError if the workspace has none of that id, ValueError if it could not be loaded."""
    entry = catalog.get_by_id(dataset_id, workspace_id).first()
    if entry is None:
        raise LookupError(f"no dataset {dataset_id}")
    if entry["status"] != "ready":
        raise ValueError(f"dataset {dataset_id} is {entry['status']}: {entry['error']}")
    if entry["storage_path"] is not None:
        return catalog.spark.read.parquet(entry["storage_path"])
    # a header without rows
    columns = catalog.read("dataset_columns").where(F.col("dataset_id") == dataset_id).orderBy("position")
    names = [r["column_name"] for r in columns.select("column_name").collect()]
    return catalog.spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def add_dataset(catalog: Catalog, df: DataFrame, workspace_id: str, name: str, parent_id: str | None = None) -> str:
    """Write a table as a dataset of the workspace, with its profile; returns its id.

    The entry comes last, so that a write that broke off leaves no dataset behind.
    """
    spark, key = catalog.spark, str(uuid.uuid4())
    path = catalog.write_snapshot(df, key)
    stored = spark.read.parquet(path)
    catalog.write_columns(profile(stored).withColumn("dataset_id", F.lit(key)), batch=key)
    entry = spark.createDataFrame(
        [(key, workspace_id, name, path, "parquet", "ready", stored.count(), parent_id)],
        "id string, workspace_id string, original_name string, storage_path string, file_format string, status string, "
        "row_count bigint, parent_id string",
    )
    catalog.write_datasets(entry, catalog.read("dataset_columns").where(F.col("dataset_id") == key), batch=key)
    return key


def clean_dataset(
    catalog: Catalog, dataset_id: str, workspace_id: str, steps: Iterable[StepCall | dict[str, Any]], name: str | None = None
) -> str:
    """Run the steps; the result is a new dataset that names this one as its parent, the log belongs to this one."""
    clean, logs = Cleaning(steps).run(open_dataset(catalog, dataset_id, workspace_id))
    made = add_dataset(catalog, clean, workspace_id, name or f"{dataset_id}-cleaned", dataset_id)
    catalog.write_pipeline_log(dataset_id, logs, batch=made)
    return made


def train_dataset(
    catalog: Catalog, dataset_id: str, workspace_id: str, target: str, task: str = "classification", **options: Any
) -> AutoTrain:
    """Train all estimators of the task, save the best model, and record one experiment for each."""
    trained = auto_train(open_dataset(catalog, dataset_id, workspace_id), target, task, **options)
    best = trained.best
    catalog.write_experiments(dataset_id, trained, {best.name: catalog.save_best(dataset_id, best)} if best else None)
    return trained


def query_by_id(catalog: Catalog, dataset_id: str, workspace_id: str, sql: str, **options: Any) -> DataFrame:
    return query_dataset(open_dataset(catalog, dataset_id, workspace_id), sql, **options)


def chart_by_id(catalog: Catalog, dataset_id: str, workspace_id: str, type: str, **options: Any) -> Chart:  # noqa: A002
    return plot_chart(open_dataset(catalog, dataset_id, workspace_id), type, **options)
