"""Tools over one dataset: a read-only query and a chart by name."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from larkspur.operators.charts import CHARTS, Chart

VIEW = "dataset"


def query_dataset(df: DataFrame, sql: str, limit: int | None = None, args: dict[str, Any] | None = None) -> DataFrame:
    """Run one SELECT (or WITH ... SELECT) over `df`, which the text calls `dataset`; all rows, or at most `limit`.

    The text becomes a subquery, so that the parser itself refuses every statement that is not a
    query. The analysed plan decides the rest: its leaves must be leaves of `df`, and it may call nothing by reflection.
    """
    spark = df.sparkSession
    view = f"larkspur_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        text = sql.strip().rstrip(";")
        found = spark.sql(f"WITH {VIEW} AS (SELECT * FROM {view}) SELECT * FROM (\n{text}\n)", args)
    finally:
        spark.catalog.dropTempView(view)
    _check(found, df)
    return found if limit is None else found.limit(limit)


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _walk(node) -> Iterator[tuple[str, Any]]:
    """Every plan node and expression of a plan, those of subqueries included, as (class name, node)."""
    name = node.getClass().getSimpleName()
    yield name, node
    for child in _each(node.children()):
        yield from _walk(child)
    if hasattr(node, "expressions") and _is_plan(node):
        for expression in _each(node.expressions()):
            yield from _walk(expression)
    elif "Subquery" in name or name in ("Exists", "ListQuery"):
        plan = getattr(node, "plan", None)
        if plan is not None:
            yield from _walk(node.plan())


def _is_plan(node) -> bool:
    kind = node.getClass()
    while kind is not None:
        if kind.getSimpleName() == "LogicalPlan":
            return True
        kind = kind.getSuperclass()
    return False


def _check(found: DataFrame, df: DataFrame) -> None:
    own = list(_each(df._jdf.queryExecution().analyzed().collectLeaves()))
    for name, node in _walk(found._jdf.queryExecution().analyzed()):
        if "Reflect" in name:
            raise ValueError("the query calls a forbidden function")
        if not _is_plan(node) or node.children().size() or name in ("OneRowRelation", "CTERelationRef"):
            continue
        if not any(node.sameResult(leaf) for leaf in own):
            raise ValueError("the query reads something other than the dataset")


def plot_chart(df: DataFrame, type: str, **options: Any) -> Chart:  # noqa: A002 - the name of the field
    """The chart of a registered type."""
    if type not in CHARTS:
        raise ValueError(f"unknown chart type: {type}; known: {', '.join(sorted(CHARTS))}")
    return CHARTS[type](df, **options)
