"""Scalar expressions: formats, fills, finite values, JSON payloads, keys and titles."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot, empty when the name has none (`.hidden` has none)."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


def file_format(path: Column) -> Column:
    """Lower-cased suffix without the dot."""
    return F.ltrim(file_suffix(path), F.lit("."))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def fill_null(column: Column, value: Any) -> Column:
    """Replace nulls; Spark widens the type when value and column differ (int + double -> double)."""
    return F.coalesce(column, value if isinstance(value, Column) else F.lit(value))


def to_float(column: Column) -> Column:
    return column.cast("double")


def zero_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def finite_only(column: Column) -> Column:
    """Null for NaN and the infinities, which chart data must not hold."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def json_payload(**parts: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]))


def new_id() -> Column:
    return F.expr("uuid()")


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped key that depends only on `parts`, so that a replayed write gets the same key."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def now() -> Column:
    return F.current_timestamp()


def histogram_title(column: str) -> str:
    return f"Distribution of {column}"


def bar_title(column: str, top_k: int) -> str:
    return f"Top {top_k} categories of {column}"
