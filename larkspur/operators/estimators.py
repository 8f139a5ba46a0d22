"""Estimator registry: every model the automatic training tries, by name and task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

SEED = 42
TASKS = ("classification", "regression")


@dataclass(frozen=True)
class Entry:
    name: str
    task: str
    build: Callable[..., Estimator]  # (classes, **hyperparams) -> estimator on `features` and `label`


ESTIMATORS: dict[str, Entry] = {}


def register_estimator(name: str, task: str) -> Callable:
    if task not in TASKS:
        raise ValueError(f"unknown task: {task}")

    def add(build: Callable[..., Estimator]) -> Callable[..., Estimator]:
        ESTIMATORS[name] = Entry(name, task, build)
        return build

    return add


def list_for_task(task: str) -> list[Entry]:
    if task not in TASKS:
        raise ValueError(f"unknown task: {task}")
    return [e for e in ESTIMATORS.values() if e.task == task]


@register_estimator("gbt_classifier", "classification")
def gbt_classifier(classes: int, **hyperparams: Any) -> Estimator:
    """Boosted trees; they are binary in Spark, so more classes are trained one against the rest."""
    trees = GBTClassifier(seed=SEED, **hyperparams)
    return trees if classes <= 2 else OneVsRest(classifier=trees, parallelism=2)


@register_estimator("random_forest_classifier", "classification")
def random_forest_classifier(classes: int, **hyperparams: Any) -> Estimator:
    return RandomForestClassifier(seed=SEED, **hyperparams)


@register_estimator("logistic_regression", "classification")
def logistic_regression(classes: int, **hyperparams: Any) -> Estimator:
    return LogisticRegression(**hyperparams)


@register_estimator("gbt_regressor", "regression")
def gbt_regressor(classes: int, **hyperparams: Any) -> Estimator:
    return GBTRegressor(seed=SEED, **hyperparams)


@register_estimator("random_forest_regressor", "regression")
def random_forest_regressor(classes: int, **hyperparams: Any) -> Estimator:
    return RandomForestRegressor(seed=SEED, **hyperparams)


def weighted(estimator: Estimator, weight: str) -> Estimator | None:
    """The estimator on rows that count `weight` times, if it learns the same from these as from repeated rows, else None.

    Forests draw rows one by one, and so do boosted trees of a sample; a least number of rows in a node counts rows, too.
    """
    member = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    boosted = isinstance(member, (GBTClassifier, GBTRegressor))
    if boosted and (member.getSubsamplingRate() != 1.0 or member.getMinInstancesPerNode() > 1):
        return None
    if not boosted and not isinstance(member, LogisticRegression):
        return None
    return estimator.copy({estimator.weightCol: weight})


def settings(estimator: Estimator) -> dict[str, Any]:
    """Every plain parameter of an estimator, defaults included; those of the member for one-against-rest."""
    member = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    found = {p.name: v for p, v in member.extractParamMap().items()}
    return {k: v for k, v in sorted(found.items()) if isinstance(v, (bool, int, float, str))}


def slot_importances(model: Model) -> list[float] | None:
    """Gain shares per feature slot; the members' average for one-against-rest; None for linear models."""
    if isinstance(model, OneVsRestModel):
        members = [slot_importances(m) for m in model.models]
        if any(m is None for m in members):
            return None
        return [sum(values) / len(values) for values in zip(*members)]
    found = getattr(model, "featureImportances", None)
    return None if found is None else [float(v) for v in found.toArray()]
