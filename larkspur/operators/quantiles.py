"""Exact quantiles that stay distributed.

Spark's exact `percentile` keeps one entry per distinct value in a single buffer, which no task can
hold for a column of a trillion different prices. Here a rank sketch of every column comes with the first
aggregate. It gives two values that lie just under and over each wanted rank; plain counts below and up to these values, one
aggregate without a shuffle of rows, tell exactly what lies between. Once that is little, its values are fetched. Edges follow ranks, so
this takes two scans after the first however the values are spread, and two more for each further factor of some hundred rows.
A sketch that missed, or a coarse one, costs another pass but no exactness: every pass counts, and leaves out at least one value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.types import check_columns, col, number, numeric_columns

SKETCH = 2048  # size of a rank sketch: some 50 KB for a column and task, ranks off by 0.24 % at most, 99 times in 100
FINISH_ROWS = 131_072  # values fetched to end the search, shared by all ranges


def _rank_error() -> float:
    """Share of all rows that a sketch's rank may be off, as stated for such sketches."""
    return 2.296 / SKETCH**0.9021


@dataclass
class _Range:
    """Order statistics with 0-based `ranks` among the values between `low` and `high`, both left out; `below` values come before."""

    column: str
    ranks: list[int]
    low: float
    high: float
    below: int
    rows: int
    sketch: bytes | None = None
    edges: list[float] = field(default_factory=list)

    def cuts(self, v: Column) -> list[Column]:
        """What to count: values below and up to every edge."""
        return [c for e in self.edges for c in (v < F.lit(e), v <= F.lit(e))]

    def parts(self, counts: list[int]) -> list[_Range]:
        """The range in parts, in order, by these counts; an edge is a part of its own."""
        bounds, at = [], self.low
        for e in self.edges:
            bounds += [(at, e, None), (at, e, e)]
            at = e
        bounds.append((at, self.high, None))
        reach = [self.below, *counts, self.below + self.rows]
        found = []
        for (low, high, value), start, stop in zip(bounds, reach[:-1], reach[1:], strict=True):
            ranks = [k for k in self.ranks if start <= k < stop]
            found.append(_Range(self.column, ranks, low, high, start, stop - start, edges=[] if value is None else [value]))
        return found

    def holds(self, v: Column) -> Column:
        return (v > F.lit(self.low)) & (v < F.lit(self.high))

    def shares(self) -> list[float]:
        """Where in the range, from 0 to 1, the edges should lie."""
        first, last = ((r - self.below + 0.5) / self.rows for r in (min(self.ranks), max(self.ranks)))
        return [max(0.0, first - _rank_error()), min(1.0, last + _rank_error())]


def _value(df: DataFrame, column: str) -> Column:
    return number(df, column).cast("double")


def _sketch(df: DataFrame, r: _Range) -> Column:
    v = _value(df, r.column)
    return F.kll_sketch_agg_double(F.when(r.holds(v), v), F.lit(SKETCH))


def _find_edges(df: DataFrame, ranges: list[_Range]) -> None:
    """Edges of all ranges: from the sketch they have, or a new one."""
    new = [r for r in ranges if r.sketch is None]
    if new:
        row = df.agg(*[_sketch(df, r).alias(str(i)) for i, r in enumerate(new)]).first()
        for i, r in enumerate(new):
            r.sketch = row[i]
    edges = [F.kll_sketch_get_quantile_double(F.lit(bytes(r.sketch)), F.array(*map(F.lit, r.shares()))) for r in ranges]
    row = df.sparkSession.range(1).select(*[e.alias(str(i)) for i, e in enumerate(edges)]).first()
    for i, r in enumerate(ranges):
        r.edges = sorted(set(row[i]))


def _count_edges(df: DataFrame, ranges: list[_Range], nested: list[_Range]) -> tuple[list[list[int]], list[bytes]]:
    """Per range, the values below and up to each edge; and a sketch for each range of `nested`."""
    counts = [F.array(*map(F.count_if, r.cuts(_value(df, r.column)))) for r in ranges]
    row = df.agg(*[c.alias(str(i)) for i, c in enumerate([*counts, *[_sketch(df, r) for r in nested]])]).first()
    return list(row[: len(ranges)]), list(row[len(ranges) :])


def _narrow(df: DataFrame, ranges: list[_Range], found: dict[tuple[str, int], float]) -> list[_Range]:
    """One pass: ranks that fall on an edge are found, others are left in the smaller ranges between."""
    _find_edges(df, ranges)
    inner = {}
    for i, r in enumerate(ranges):
        expected = (r.shares()[1] - r.shares()[0]) * r.rows
        if len(r.edges) > 1 and expected > FINISH_ROWS // len(ranges):
            inner[i] = r.parts([0] * len(r.cuts(F.lit(0))))[2]
    counts, sketches = _count_edges(df, ranges, list(inner.values()))
    sketch_of = dict(zip(inner, sketches, strict=True))
    left = []
    for i, r in enumerate(ranges):
        for part in r.parts(counts[i]):
            if not part.ranks:
                continue
            if part.edges:
                found.update({(r.column, k): part.edges[0] for k in part.ranks})
                continue
            if i in inner and (part.low, part.high) == (inner[i].low, inner[i].high):
                part.sketch = sketch_of[i]
            left.append(part)
    return left


def _fetch(df: DataFrame, ranges: list[_Range], found: dict[tuple[str, int], float]) -> None:
    """The values of ranges that are known to be small."""
    values = [_value(df, r.column) for r in ranges]
    held = [F.when(r.holds(v), v).alias(str(i)) for i, (r, v) in enumerate(zip(ranges, values, strict=True))]
    wide = df.where(reduce(Column.__or__, [r.holds(v) for r, v in zip(ranges, values, strict=True)])).select(*held)
    long = wide.unpivot([], [col(str(i)) for i in range(len(ranges))], "range", "v").where(F.col("v").isNotNull())
    rows = long.groupBy(F.col("range").cast("int").alias("range"), "v").count().collect()
    reached = [r.below for r in ranges]
    for row in sorted(rows):
        r, before = ranges[row["range"]], reached[row["range"]]
        reached[row["range"]] += row["count"]
        found.update({(r.column, k): row["v"] for k in r.ranks if before <= k < before + row["count"]})


def _search(df: DataFrame, ranges: list[_Range]) -> dict[tuple[str, int], float]:
    """The value of every (column, rank)."""
    found: dict[tuple[str, int], float] = {}
    while ranges:
        if sum(r.rows for r in ranges) <= FINISH_ROWS:
            _fetch(df, ranges, found)
            break
        ranges = _narrow(df, ranges, found)
    return found


def _interpolate(count: int, probability: float) -> tuple[int, int, float]:
    position = probability * (count - 1)
    lower = math.floor(position)
    return lower, min(lower + 1, count - 1), position - lower


def quantiles(
    df: DataFrame,
    columns: list[str] | None = None,
    probabilities: list[float] = (0.25, 0.5, 0.75),
    approximate: bool = False,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per numeric column; nulls and NaN are left out.

    Columns without any value map to a list of None. `approximate` trades exactness for one pass.
    """
    columns = check_columns(df, list(columns)) if columns is not None else numeric_columns(df)
    probabilities = list(probabilities)
    if not columns:
        return {}
    if approximate:
        row = df.agg(
            *[F.percentile_approx(number(df, c), probabilities).alias(str(i)) for i, c in enumerate(columns)]
        ).first()
        return {c: list(row[i]) if row[i] else [None] * len(probabilities) for i, c in enumerate(columns)}

    infinite = float("inf")
    facts = []
    for c in columns:
        v = _value(df, c)
        whole = _Range(c, [], -infinite, infinite, 0, 0)
        finite = F.count_if(whole.holds(v))
        facts += [F.array(F.count(v), F.count_if(v == F.lit(-infinite)), finite), _sketch(df, whole)]
    row = df.agg(*[f.alias(str(i)) for i, f in enumerate(facts)]).first()

    ranges, counts, found = [], {}, {}
    for i, c in enumerate(columns):
        (count, negative, finite), sketch = row[2 * i], row[2 * i + 1]
        counts[c] = count
        for p in probabilities if count else []:
            ranks = sorted(set(_interpolate(count, p)[:2]))
            found |= {(c, k): -infinite if k < negative else infinite for k in ranks if not negative <= k < negative + finite}
            inside = [k for k in ranks if negative <= k < negative + finite]
            if inside:
                ranges.append(_Range(c, inside, -infinite, infinite, negative, finite, sketch))
    if {r.column: r.rows for r in ranges} and sum({r.column: r.rows for r in ranges}.values()) <= FINISH_ROWS:
        together: dict[str, _Range] = {}  # few rows: all ranks of a column share one range
        for r in ranges:
            first = together.setdefault(r.column, r)
            first.ranks = sorted({*first.ranks, *r.ranks})
        ranges = list(together.values())
    found |= _search(df, ranges)

    result: dict[str, list[float | None]] = {}
    for c in columns:
        result[c] = []
        for p in probabilities:
            if not counts[c]:
                result[c].append(None)
                continue
            lower, upper, part = _interpolate(counts[c], p)
            low, high = found[c, lower], found[c, upper]
            result[c].append(low if low == high or part == 0 else (1 - part) * low + part * high)
    return result


def medians(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantiles(df, columns, [0.5], approximate).items()}


def quartiles(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per numeric column: column_name, q1, q3."""
    found = quantiles(df, columns, [0.25, 0.75], approximate)
    rows = [(c, q1, q3) for c, (q1, q3) in found.items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, q1 double, q3 double")
