"""A reproducible train / test split."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.types import check_columns, col
from larkspur.operators.charts import is_complex

#: Bits of a hash that rows are ordered by, and of them those that one counting pass looks at: the driver gets 2**15 rows at most.
HASH_BITS, DIGIT_BITS = 60, 15


def _digest(df: DataFrame, seed: int, key: list[str] | None) -> Column:
    names = check_columns(df, list(key or df.columns))
    parts = [F.to_json(col(c)) if is_complex(df, c) else col(c).cast("string") for c in names]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _check(test_size: float) -> None:
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")


def in_test(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: list[str] | None = None) -> Column:
    """True for the rows of the test side, decided by the MD5 of seed and key alone.

    The side of a row does not depend on partitions or order. Without a key all columns count, so
    identical rows fall on the same side.
    """
    _check(test_size)
    return _digest(df, seed, key) < F.lit(format(int(test_size * 2**32), "08x"))


def _orders(df: DataFrame, seed: int, key: list[str] | None) -> Iterator[tuple[DataFrame, Column, int]]:
    """What rows are ordered by: the MD5 of the key, then of all columns; equal rows by their place in the table."""
    for names in [key, None] if key else [None]:
        yield df, F.conv(F.substring(_digest(df, seed, names), 1, HASH_BITS // 4), 16, 10).cast("long"), HASH_BITS
    place = next(n for n in (f"place_{i}" for i in range(len(df.columns) + 1)) if n not in df.columns)
    # A column of its own: a filter would number only the rows that it looks at.
    yield df.withColumn(place, F.monotonically_increasing_id()), F.col(place), 64


def exact_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, key: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, test) where the test side has exactly ceil(test_size * rows) rows: those that come first by MD5.

    The last row of the test side is found by counting digits of the hash, highest first: a pass counts the rows of each digit
    within the digits found so far, so nothing is sorted or moved. Two or three passes do for most tables.
    The sides do not depend on partitions, only which of several equal rows is on which side does; `df` is read
    once a pass, so keep a table that is expensive or changes between reads.
    """
    _check(test_size)
    before, tied, left = F.lit(False), F.lit(True), None
    for rows, order, bits in _orders(df, seed, key):
        prefix, shift = 0, bits
        while shift > 0:
            step = min(DIGIT_BITS, shift)
            within = tied if shift == bits else tied & (F.shiftrightunsigned(order, shift) == F.lit(prefix))
            shift -= step
            digit = F.shiftrightunsigned(order, shift).bitwiseAND(2**step - 1)
            counts = sorted((r["digit"], r["count"]) for r in rows.where(within).groupBy(digit.alias("digit")).count().collect())
            if left is None:
                left = math.ceil(test_size * sum(n for _, n in counts))
            reach = list(accumulate((n for _, n in counts), initial=0))
            # the digit that the last row falls into, or one past the end where digits end with it
            edge = next((i for i, n in enumerate(reach[1:]) if n > left), len(counts))
            cut = counts[edge][0] if edge < len(counts) else 2**step
            left -= reach[edge]
            prefix = (prefix << step) + cut
            if left == 0:
                test = before | (tied & (F.shiftrightunsigned(order, shift) < F.lit(prefix)))
                return tuple(rows.where(side).select(*map(col, df.columns)) for side in (~test, test))
        before |= tied & (order < F.lit(prefix))
        tied &= order == F.lit(prefix)
    raise RuntimeError("the table changed between two reads")


def train_test_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, key: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a threshold on the hash: nothing is read, the test side is near `test_size` of the rows."""
    test = in_test(df, test_size, seed, key)
    return df.where(~test), df.where(test)
