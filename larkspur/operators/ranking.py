"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.types import col
from larkspur.session import cut_lineage


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of every group from 1 in the given order.

    A plain window would sort a whole group in one task. Here the rows are range-partitioned by group
    and order, so that a large group lies in several ranges; a row's number is its place in its range
    plus the group's rows in the ranges before. `order` must tell the rows of a group apart.
    """
    keys = [col(b) for b in by]
    ranged = df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    ranged = cut_lineage(ranged, "ranges")  # the ranges must not be drawn anew between the two uses
    named = [k.alias(f"__key{i}") for i, k in enumerate(keys)]
    sizes = ranged.groupBy(F.col("__range").alias("__in"), *named).agg(F.count("*").alias("__rows"))
    # A group has at most one row per range here, however large it is.
    before = Window.partitionBy(*[f"__key{i}" for i in range(len(by))]).orderBy("__in")
    earlier = F.sum("__rows").over(before.rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("__start", F.coalesce(earlier, F.lit(0))).drop("__rows")
    place = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order))
    same = F.col("__range") == F.col("__in")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"__key{i}"))
    joined = ranged.withColumn("__place", place).join(starts, same)
    return joined.select(*map(col, df.columns), (F.col("__start") + F.col("__place")).cast("long").alias(name))
