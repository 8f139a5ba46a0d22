"""Whole-data type inference for columns that were read as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.types import col

# What a whole number, a decimal number and a truth value look like in a file.
INTEGER = r"^[+-]?\d+$"
DECIMAL = r"^([+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf)|NaN)$"
BOOLEAN = r"^(true|false)$"

def _kind(value: Column) -> Column:
    """What a present value looks like, as one bit: 1 whole, 2 decimal, 4 truth value, 8 anything else.

    The patterns come first because a cast that fails is slow; what they accept can be cast, except
    for whole numbers too long for a bigint.
    """
    fits = (F.length(value) < 19) | value.try_cast("bigint").isNotNull()
    return (
        F.when(value.isNull(), 0)
        .when(value.rlike(INTEGER) & fits, 1)
        .when(value.rlike(DECIMAL), 2)
        .when(value.rlike(BOOLEAN), 4)
        .otherwise(8)
    )


def _choice(kinds: Column) -> Column:
    return (
        F.when(kinds == 1, "bigint").when(kinds.isin(2, 3), "double").when(kinds == 4, "boolean").otherwise("string")
    )


def kinds(columns: list[str]) -> list[Column]:
    """The kind of every value, to be projected before `type_choices` aggregates it."""
    return [_kind(col(c)).alias(f"__kind{i}") for i, c in enumerate(columns)]


def type_choices(columns: list[str]) -> Column:
    """Aggregate over projected `kinds`: the types of text columns, in order, as an array of type names.

    bigint if every present value is a whole number, else double, else boolean (true / false), else
    string; a column without values is a string, and dates stay strings. Every value is looked at
    once, and a column needs one integer of state.
    """
    return F.array(*[_choice(F.bit_or(f"__kind{i}")) for i in range(len(columns))])


def infer_schema(df: DataFrame) -> dict[str, str]:
    """Types of all text columns, from one aggregate over all rows."""
    if not df.columns:
        return {}
    return dict(zip(df.columns, df.select(*kinds(df.columns)).agg(type_choices(df.columns)).first()[0]))


def apply_schema(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[col(c).cast(types[c]).alias(c) if c in types else col(c) for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """The text columns cast to the types their values have."""
    return apply_schema(df, infer_schema(df))
