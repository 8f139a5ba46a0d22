"""Automatic training: one split, every registered estimator of the task, a ranked leaderboard."""

from __future__ import annotations

import logging
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.types import col
from larkspur.operators.estimators import Entry, list_for_task, settings, slot_importances, weighted
from larkspur.operators.features import Features, features_target, fit_features, split_xy
from larkspur.operators.metrics import classification_metrics, regression_metrics
from larkspur.operators.ranking import rank_within
from larkspur.operators.split import exact_split

log = logging.getLogger(__name__)

# The metric each task is ranked by.
PRIMARY = {"classification": "accuracy", "regression": "r2"}

ROWS_PER_TASK = 20_000
#: A task of training has at most so many rows, and about so many bytes of them.
MOST_ROWS, MOST_BYTES = 500_000, 128_000_000
#: Equal training rows are kept once with their number if there are at most so many kinds, and so many rows of each on average.
MOST_KINDS, LEAST_ALIKE = 100_000, 10
WEIGHT = "__weight"

LEADERBOARD_SCHEMA = (
    "name string, metrics map<string,double>, train_time_sec double, "
    "feature_importance map<string,double>, position int"
)


@dataclass
class TrainResult:
    name: str
    model: PipelineModel  # takes the raw table, adds `prediction` (and `predicted` class names)
    metrics: dict[str, float]
    feature_importance: dict[str, float] | None
    train_time_sec: float
    position: int  # registry order, the tie-break of the leaderboard
    hyperparams: dict[str, Any]  # all that the estimator ran with


@dataclass
class AutoTrain:
    task: str
    target: str
    results: list[TrainResult]
    leaderboard: DataFrame

    @property
    def best(self) -> TrainResult | None:
        first = best_model(self.leaderboard, self.task).first()
        return next((r for r in self.results if first and r.name == first["name"]), None)


def auto_train(
    df: DataFrame,
    target: str,
    task: str = "classification",
    test_size: float = 0.2,
    seed: int = 42,
    key: list[str] | None = None,
    features: list[str] | None = None,
    hyperparams: dict[str, dict[str, Any]] | None = None,
    parallelism: int = 3,
) -> AutoTrain:
    """Train every registered estimator of `task`; one that fails is logged and skipped.

    The test side has exactly ceil(test_size * rows) rows. Each side of the split is read once: the needed training columns are kept while the preparation is learnt, the
    prepared sides for all fits. Where few kinds of rows make up the table, models that weights tell the same as repeated rows are trained on
    one row of each kind, the others on all rows. `parallelism` fits that many models at a time.
    """
    entries = list_for_task(task)
    wanted, _ = split_xy(df, target, features)
    sides = exact_split(df.where(col(target).isNotNull()), test_size, seed, key)
    train, test = (side.select(*map(col, [*wanted, target])) for side in sides)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        prepared = fit_features(train, target, task, wanted)
    except Exception:
        train.unpersist()
        raise
    held, rows = _spread(train, len(prepared.slots))
    kinds, parts = _kinds(held, prepared, rows)
    train_xy, alike_xy = features_target(held, prepared), None
    if kinds is None:
        train_xy = train_xy.persist(StorageLevel.MEMORY_AND_DISK)
        train_xy.count()
        held.unpersist()
    else:
        alike_xy = features_target(kinds, prepared, WEIGHT).persist(StorageLevel.MEMORY_AND_DISK)
        test = _merged(test, prepared).repartition(parts)
    # Classes that only the test side has can never be predicted; they keep a label of their own.
    weight = None if kinds is None else WEIGHT
    test_xy = features_target(test, prepared, weight).fillna({"label": -1.0}).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(position: int, entry: Entry) -> TrainResult | None:
        try:
            started = time.time()
            estimator = entry.build(len(prepared.classes), **(hyperparams or {}).get(entry.name, {}))
            by_kind = weighted(estimator, WEIGHT) if alike_xy is not None else None
            model = by_kind.fit(alike_xy) if by_kind else estimator.fit(train_xy)
            scored = model.transform(test_xy).select("label", "prediction", *([weight] if weight else []))
            measure = classification_metrics if task == "classification" else regression_metrics
            quality = measure(scored, weight=weight)
            metrics = {k: float(v) for k, v in quality.first().asDict().items() if v is not None}
            importance = prepared.importance(slot_importances(model))
            whole = PipelineModel(stages=[*prepared.model.stages, model, *prepared.label_back()])
            return TrainResult(entry.name, whole, metrics, importance, time.time() - started, position, settings(estimator))
        except Exception as error:  # noqa: BLE001 - one bad estimator must not end the run
            log.warning("going on without an estimator, as %s failed with: %s", entry.name, error)
            return None

    try:
        if parallelism > 1:
            with ThreadPoolExecutor(parallelism) as pool:
                work = inheritable_thread_target(df.sparkSession)(fit)
                found = list(pool.map(work, range(len(entries)), entries))
        else:
            found = [fit(i, e) for i, e in enumerate(entries)]
    finally:
        for kept in (held, train_xy, test_xy, *([alike_xy] if alike_xy is not None else [])):
            kept.unpersist()
    results = [r for r in found if r is not None]
    return AutoTrain(task, target, results, leaderboard(df.sparkSession, results, task))


def _spread(df: DataFrame, slots: int) -> tuple[DataFrame, int]:
    """The kept training rows in as many partitions as their number, their size and the cluster call for; and their number.

    Growing trees runs a job per level, so a small table in many partitions is all overhead and a
    large one in few leaves cores idle, or makes tasks of any size. Data that already lies so is not shuffled.
    """
    rows, parts = df.count(), df.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    most = min(MOST_ROWS, max(ROWS_PER_TASK, MOST_BYTES // (100 + 12 * slots)))
    wanted = max(min(rows // ROWS_PER_TASK + 1, max(parts, cores)), -(-rows // most))
    if wanted == parts:
        return df, rows
    spread = (df.repartition(wanted) if wanted > parts else df.coalesce(wanted)).persist(StorageLevel.MEMORY_AND_DISK)
    spread.count()
    df.unpersist()
    return spread, rows


def _merged(df: DataFrame, prepared: Features) -> DataFrame:
    """One row for all that agree in features and target, with their number."""
    used = [*prepared.numeric, *prepared.categorical, *prepared.hashed, prepared.target]
    return df.groupBy(*map(col, used)).agg(F.count("*").cast("double").alias(WEIGHT))


def _kinds(df: DataFrame, prepared: Features, rows: int) -> tuple[DataFrame | None, int]:
    """The merged rows in few partitions, and how many; None if there are too many kinds to gain by it. A vector is taken for a kind of its own."""
    if any(type(df.schema[c].dataType).__name__ == "VectorUDT" for c in prepared.categorical):
        return None, 0
    used = [*prepared.numeric, *prepared.categorical, *prepared.hashed, prepared.target]
    found = df.agg(F.approx_count_distinct(F.xxhash64(*map(col, used)))).first()[0]
    if found > MOST_KINDS or found * LEAST_ALIKE > rows:
        return None, 0
    parts = found // ROWS_PER_TASK + 1
    return _merged(df, prepared).repartition(parts), parts


def leaderboard(spark: SparkSession, results: list[TrainResult], task: str) -> DataFrame:
    rows = [(r.name, r.metrics, r.train_time_sec, r.feature_importance, r.position) for r in results]
    return sort_leaderboard(spark.createDataFrame(rows, LEADERBOARD_SCHEMA), task)


def sort_leaderboard(board: DataFrame, task: str) -> DataFrame:
    """Primary metric descending, a missing metric last, equal scores in registry order."""
    return board.orderBy(F.col("metrics")[PRIMARY[task]].desc_nulls_last(), "position")


def best_model(board: DataFrame, task: str) -> DataFrame:
    return sort_leaderboard(board, task).limit(1)


def leaderboard_rank(experiments: DataFrame) -> DataFrame:
    """Rank experiments by their task's primary metric within each dataset: adds `rank`."""
    primary = F.create_map(*[F.lit(x) for pair in PRIMARY.items() for x in pair])
    score = F.col("metrics")[primary[F.col("task_type")]]
    order = [score.desc_nulls_last(), F.col("created_at"), F.col("model_type")]
    return rank_within(experiments, ["dataset_id", "task_type"], order)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The table with `prediction` (and for classes `predicted`), without the working columns."""
    scored = model.transform(df)
    kept = [c for c in ("prediction", "predicted") if c in scored.columns]
    return scored.select(*[col(c) for c in df.columns if c not in kept], *kept)
