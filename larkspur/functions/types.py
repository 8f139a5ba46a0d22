"""Type vocabulary and type predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The dtype spellings users of the dataset profile see.
DTYPE_NAMES = {
    T.ByteType: "Int8",
    T.ShortType: "Int16",
    T.IntegerType: "Int32",
    T.LongType: "Int64",
    T.FloatType: "Float32",
    T.DoubleType: "Float64",
    T.BooleanType: "Boolean",
    T.StringType: "String",
    T.BinaryType: "Binary",
    T.DateType: "Date",
    T.TimestampType: "Datetime(time_unit='us', time_zone='UTC')",
    T.TimestampNTZType: "Datetime(time_unit='us', time_zone=None)",
}


def dtype_name(data_type: T.DataType) -> str:
    if isinstance(data_type, T.DecimalType):
        return f"Decimal(precision={data_type.precision}, scale={data_type.scale})"
    if isinstance(data_type, T.ArrayType):
        return f"List({dtype_name(data_type.elementType)})"
    if isinstance(data_type, T.StructType):
        return "Struct({" + ", ".join(f"'{f.name}': {dtype_name(f.dataType)}" for f in data_type) + "})"
    return DTYPE_NAMES.get(type(data_type), data_type.simpleString())


def is_numeric(data_type: T.DataType) -> bool:
    """Integers, floats and decimals; booleans, dates and timestamps are not numeric."""
    return isinstance(data_type, T.NumericType)


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.StructType, T.MapType, T.VariantType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def check_columns(df: DataFrame, names: list[str]) -> list[str]:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    return names


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into null, the form every statistic works on."""
    field = df.schema[name]
    value = col(name).cast("double")
    if is_fractional(field.dataType):
        return F.when(~F.isnan(value), value)
    return value
