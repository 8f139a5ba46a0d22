"""Vectors of whole numbers: what the clustering and the whitening of embeddings share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import field, lean

SCALE = 256
#: Entries beyond this have no exact double and are an error, not a dropped row.
LARGEST = 2.0**53
#: Up to this size squared distances of a few thousand entries fit 64 bits.
SMALL = 2**25


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds numbers only."""
    each = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(each, F.lit(False))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every entry, as long."""

    def entry(x: Column) -> Column:
        y = F.floor(x * scale)
        return F.when(F.abs(x * scale) <= LARGEST, y).otherwise(F.raise_error(F.lit("an entry of a vector is too large")))

    return F.transform(vector, entry)


def whole_vectors(df: DataFrame, key: str, vector: str, dimension: int | None, scale: int) -> DataFrame:
    """Rows (id, x) of the vectors that hold finite numbers only; without `dimension`, those of the commonest length.

    Names of other columns do not matter; rows without an id and repeated rows stay.
    """
    named = df.select(field(key).cast("long").alias("id"), field(vector).cast("array<double>").alias("v"))
    rows = named.where(finite(F.col("v")))
    if dimension is None:
        common = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
        dimension = common["size"] if common else 0
    return rows.where(F.size("v") == F.lit(dimension)).select("id", whole(F.col("v"), scale).alias("x"))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """The vectors of a batch as rows of 64-bit integers, or of Python's own where products would not fit."""
    flat = np.asarray(batch.column(column).flatten(), dtype=np.int64)
    rows = flat.reshape(batch.num_rows, -1)
    return rows if not flat.size or int(np.abs(flat).max()) <= SMALL else rows.astype(object)


SUMS = "part int, entry int, high long, low long"


def sums_of(df: DataFrame, count: Callable[[pa.RecordBatch, dict[int, np.ndarray]], None]) -> dict[int, list[int]]:
    """Exact sums over all rows: `count` adds a batch to one array of integers per part.

    Tasks send one row per part and entry; Spark adds up high and low halves apart, so no sum leaves 64 bits. The result
    has as many numbers as parts and entries, whatever the number of rows.
    """

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                count(batch, totals)
        rows = [(p, e, int(v) >> 32, int(v) & 0xFFFFFFFF) for p, row in totals.items() for e, v in enumerate(row.tolist())]
        parts, entries, high, low = zip(*rows, strict=True) if rows else ([], [], [], [])
        arrays = [pa.array(parts, pa.int32()), pa.array(entries, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "high", "low"])

    summed = df.mapInArrow(add, SUMS).groupBy("part", "entry").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found: dict[int, list[int]] = {}
    for row in summed.orderBy("part", "entry").collect():
        found.setdefault(row["part"], []).append((row["high"] << 32) + row["low"])
    return found
