"""Exact nearest vectors by cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.types import check_columns, col


def cosine(vector: Column, other: Column) -> Column:
    """Cosine of two arrays as double; null when a length is zero or the sizes differ."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    return F.try_divide(dot(vector, other), F.sqrt(dot(vector, vector)) * F.sqrt(dot(other, other)))


def similar(df: DataFrame, vector: list[float], k: int = 10, column: str = "embedding", tie: str | None = None) -> DataFrame:
    """The k rows whose vector is closest to `vector`, best first, with their `similarity`."""
    check_columns(df, [column, *([tie] if tie else [])])
    query = F.array(*[F.lit(float(v)) for v in vector])
    scored = df.withColumn("similarity", cosine(col(column), query)).where(F.col("similarity").isNotNull())
    return scored.orderBy(F.desc("similarity"), *([col(tie)] if tie else [])).limit(k)
