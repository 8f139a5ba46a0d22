"""Projections, filters and replacement of single columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame

from larkspur.functions.types import check_columns, col


def select_column(df: DataFrame, column: str) -> DataFrame:
    check_columns(df, [column])
    return df.select(col(column))


def drop_nulls(df: DataFrame, column: str) -> DataFrame:
    check_columns(df, [column])
    return df.where(col(column).isNotNull())


def replace_columns(df: DataFrame, replacements: dict[str, Column]) -> DataFrame:
    """Overwrite columns in one projection; order and the other columns stay."""
    check_columns(df, list(replacements))
    return df.select(*[replacements.get(c, col(c)).alias(c) for c in df.columns])


def replace_column(df: DataFrame, column: str, expression: Column) -> DataFrame:
    return replace_columns(df, {column: expression})


def equals(column: str, value: Any) -> Column:
    """Equality in which None selects the nulls."""
    return col(column).isNull() if value is None else col(column) == value
