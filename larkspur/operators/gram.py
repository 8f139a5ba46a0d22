"""Sums of products of many columns in one pass, with gaps left out pair by pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "xy", "x", "y", "xx", "yy")


def pair_sums(df: DataFrame, centre: list[float], scale: list[float]) -> DataFrame:
    """One row per pair of columns a < b, over the rows where both are present: [a, b, n, xy, x, y, xx, yy].

    All columns are doubles, null is a gap. Values are taken as (value - centre) / scale, which keeps sums of squares from
    cancelling. A batch adds its matrix products (values, squares and presence masks) to the task's; a task sends one row per pair.
    """
    width = len(df.columns)
    middle, spread = np.array(centre), np.array(scale)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]  # nulls become NaN
            values = (np.column_stack(columns).astype(float) - middle) / spread
            present = ~np.isnan(values)
            values[~present] = 0
            mask = present.astype(float)
            total += [mask.T @ mask, values.T @ values, values.T @ mask, (values * values).T @ mask]
        a, b = np.triu_indices(width, 1)
        count, product, own, square = total
        sums = [count[a, b], product[a, b], own[a, b], own[b, a], square[a, b], square[b, a]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a.astype(np.int32), b.astype(np.int32), *sums)], ["a", "b", *SUMS])

    schema = "a int, b int, " + ", ".join(f"{s} double" for s in SUMS)
    return df.mapInArrow(products, schema).groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])
