"""The cleaning plan: an ordered chain of steps with an audit log."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from larkspur.operators.steps import STEPS, Log


@dataclass
class StepCall:
    """A registered step with its parameters."""

    step: str
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.step not in STEPS:
            raise ValueError(f"unknown step: {self.step}; known: {', '.join(sorted(STEPS))}")


def step_from_spec(spec: dict[str, Any] | str) -> StepCall:
    """A step from ``{"step": name, "params": {...}}``, given as a dict or as JSON text."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    return StepCall(spec["step"], dict(spec.get("params") or {}))


class Cleaning:
    """Run steps in order; every step sees the output of the one before it."""

    def __init__(self, steps: Iterable[StepCall | dict[str, Any]]):
        self.steps = [s if isinstance(s, StepCall) else step_from_spec(s) for s in steps]

    def run(self, df: DataFrame) -> tuple[DataFrame, list[Log]]:
        logs = []
        for call in self.steps:
            df, log = STEPS[call.step](df, **call.params)
            logs.append({"step": call.step, **log})
        return df, logs


def log_frame(spark: SparkSession, logs: list[Log]) -> DataFrame:
    """The audit log as rows (step_name, step_order, applied_changes), one per step."""
    rows = [
        (log["step"], i, json.dumps({k: v for k, v in log.items() if k != "step"}, default=str))
        for i, log in enumerate(logs)
    ]
    return spark.createDataFrame(rows, "step_name string, step_order int, applied_changes string")
