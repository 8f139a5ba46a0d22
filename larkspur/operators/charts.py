"""Chart aggregates: bounded tables with a frontend-agnostic spec.

The aggregate runs in the executors; only the bounded result (bins, top categories, matrix cells,
sampled points) is ever fetched, by `Chart.spec`. New chart types register with `register_chart`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.scalars import bar_title, finite_only, histogram_title
from larkspur.functions.types import check_columns, col, is_fractional, is_numeric, numeric_columns
from larkspur.operators.columns import equals
from larkspur.operators.profile import categorical_columns, correlation_matrix, count_name, value_counts

# The chart and axis types a spec may name.
CHART_TYPES = ("bar", "line", "scatter", "histogram", "heatmap", "pie")
AXIS_TYPES = ("category", "numeric", "time")

AXIS_STRUCT = T.StructType([T.StructField(k, T.StringType()) for k in ("key", "label", "type")])
CHART_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("x_axis", AXIS_STRUCT),
        T.StructField("y_axis", AXIS_STRUCT),
        T.StructField(
            "series",
            T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("data", T.StringType())])),
        ),
        T.StructField("metadata", T.StringType()),
    ]
)

CHARTS: dict[str, Callable[..., "Chart"]] = {}
KNOWN_TYPES = set(CHART_TYPES)


def register_chart(name: str) -> Callable:
    def add(helper: Callable[..., Chart]) -> Callable[..., Chart]:
        CHARTS[name] = helper
        KNOWN_TYPES.add(name)
        return helper

    return add


@dataclass
class Axis:
    key: str
    label: str
    type: str = "category"

    def as_dict(self) -> dict[str, str]:
        return {"key": self.key, "label": self.label, "type": self.type}


@dataclass
class Chart:
    """A chart's data as a DataFrame (one row per mark) with its description."""

    type: str
    title: str
    x_axis: Axis
    y_axis: Axis
    name: str
    data: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)

    def spec(self) -> dict[str, Any]:
        """The JSON-ready spec; fetches the bounded data and validates it."""
        rows = [r.asDict(recursive=True) for r in finite_rows(self.data).collect()]
        return validate_chart(
            {
                "type": self.type,
                "title": self.title,
                "x_axis": self.x_axis.as_dict(),
                "y_axis": self.y_axis.as_dict(),
                "series": [{"name": self.name, "data": rows}],
                "metadata": self.metadata,
            }
        )


def finite_rows(df: DataFrame) -> DataFrame:
    """NaN and the infinities of every floating column become null."""
    return df.select(
        *[
            (finite_only(col(f.name)) if is_fractional(f.dataType) else col(f.name)).alias(f.name)
            for f in df.schema
        ]
    )


def validate_chart(spec: dict[str, Any]) -> dict[str, Any]:
    """Check types and axes and that no number is NaN or infinite; returns the spec."""
    if spec.get("type") not in KNOWN_TYPES:
        raise ValueError(f"unknown chart type: {spec.get('type')}")
    for axis in ("x_axis", "y_axis"):
        found = spec.get(axis) or {}
        if not found.get("key") or "label" not in found or found.get("type", "category") not in AXIS_TYPES:
            raise ValueError(f"bad {axis}: {found}")
    if not isinstance(spec.get("title"), str) or not isinstance(spec.get("series"), list):
        raise ValueError("a chart needs a title and a list of series")
    for series in spec["series"]:
        for row in series["data"]:
            for key, value in row.items():
                if isinstance(value, float) and not math.isfinite(value):
                    raise ValueError(f"value of {key} is not finite")
    return spec


def chart_frame(spark: SparkSession, specs: Iterable[dict[str, Any]]) -> DataFrame:
    """Specs as rows of CHART_SCHEMA; data points and metadata as JSON."""
    rows = [
        {
            **{k: s[k] for k in ("type", "title", "x_axis", "y_axis")},
            "series": [{"name": x["name"], "data": json.dumps(x["data"], default=str)} for x in s["series"]],
            "metadata": json.dumps(s["metadata"], default=str),
        }
        for s in specs
    ]
    return spark.createDataFrame(rows, CHART_SCHEMA)


# --- histogram ----------------------------------------------------------------------------------


@dataclass
class _Bins:
    """Equal-width bins over [low, high]; the last one is closed."""

    low: float
    high: float
    bins: int

    def __post_init__(self):
        if self.low == self.high:
            # Half a unit on each side, or more where a double is too coarse for that.
            half = max(0.5, math.ulp(self.low) * self.bins)
            self.low, self.high = self.low - half, self.high + half

    @property
    def edges(self) -> list[float]:
        step = (self.high - self.low) / self.bins
        return [i * step + self.low for i in range(self.bins)] + [self.high]

    def number(self, value: Column) -> Column:
        """The bin of a value. Division may land one bin off at an edge, so the edges decide."""
        edges = F.array(*[F.lit(float(e)) for e in self.edges])
        last = self.bins - 1
        guess = F.floor((value - self.low) / (self.high - self.low) * self.bins).cast("int")
        guess = F.greatest(F.least(guess, F.lit(last)), F.lit(0))
        return (
            F.when(value < F.get(edges, guess), guess - 1)
            .when((value >= F.get(edges, guess + 1)) & (guess < last), guess + 1)
            .otherwise(guess)
        )


def _ranges(df: DataFrame, columns: list[str], bins: int) -> tuple[dict[str, _Bins], dict[str, int]]:
    """Bins of every column that has finite values, and the number of values left out as not finite."""
    if bins < 1:
        raise ValueError("a histogram needs at least one bin")
    facts = [
        F.struct(
            F.min(finite_only(col(c))).alias("low"),
            F.max(finite_only(col(c))).alias("high"),
            (F.count(col(c)) - F.count(finite_only(col(c)))).alias("left_out"),
        ).alias(str(i))
        for i, c in enumerate(columns)
    ]
    row = df.agg(*facts).first() if columns else []
    found = {c: _Bins(row[i]["low"], row[i]["high"], bins) for i, c in enumerate(columns) if row[i]["low"] is not None}
    return found, {c: row[i]["left_out"] for i, c in enumerate(columns)}


def _binned(df: DataFrame, ranges: dict[str, _Bins]) -> DataFrame:
    """Rows per occupied bin of every column in one job: (position, number, count)."""
    numbers = [b.number(finite_only(col(c))).alias(str(i)) for i, (c, b) in enumerate(ranges.items())]
    long = df.select(*numbers).unpivot([], [col(str(i)) for i in range(len(ranges))], "position", "number")
    return (
        long.where(F.col("number").isNotNull())
        .groupBy(F.col("position").cast("int").alias("position"), "number")
        .agg(F.count("*").alias("count"))
    )


def histogram_rows(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Histograms of several numeric columns: (column_name, bin, count), empty bins with 0."""
    return _histogram_rows(df, _ranges(df, columns, bins)[0])


def _histogram_rows(df: DataFrame, ranges: dict[str, _Bins]) -> DataFrame:
    spark = df.sparkSession
    edges = [
        (c, i, j, float(edge)) for i, (c, b) in enumerate(ranges.items()) for j, edge in enumerate(b.edges[: b.bins])
    ]
    frame = spark.createDataFrame(edges, "column_name string, position int, number int, bin double")
    if not ranges:
        return frame.select("column_name", "bin", F.lit(0).cast("long").alias("count"))
    counted = frame.join(_binned(df, ranges), ["position", "number"], "left")
    return counted.select("column_name", "bin", F.coalesce("count", F.lit(0)).alias("count"))


@register_chart("histogram")
def histogram(df: DataFrame, column: str, bins: int = 30) -> Chart:
    """Equal-width counts of the non-null values; `bin` is the left edge. No values, no rows."""
    check_columns(df, [column])
    if not is_numeric(df.schema[column].dataType):
        raise ValueError(f"column {column} is not numeric")
    ranges, left_out = _ranges(df, [column], bins)
    data = _histogram_rows(df, ranges).select("bin", "count").orderBy("bin")
    return _histogram_chart(column, data, left_out[column])


def _histogram_chart(column: str, data: DataFrame, left_out: int) -> Chart:
    return Chart(
        "histogram",
        histogram_title(column),
        Axis("bin", column, "numeric"),
        Axis("count", "Frequency", "numeric"),
        column,
        data,
        {"not_finite": left_out} if left_out else {},
    )


# --- categories ---------------------------------------------------------------------------------


def top_k_categories(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values, null included; equal counts by value, nulls last."""
    return value_counts(df, column).orderBy(F.desc(count_name(column)), col(column).asc_nulls_last()).limit(k)


@register_chart("bar")
def bar(df: DataFrame, column: str, top_k: int = 20) -> Chart:
    return _bar_chart(column, top_k, top_k_categories(df, column, top_k))


def _bar_chart(column: str, top_k: int, data: DataFrame) -> Chart:
    return Chart(
        "bar",
        bar_title(column, top_k),
        Axis(column, column, "category"),
        Axis(count_name(column), "Count", "numeric"),
        column,
        data,
    )


@register_chart("pie")
def pie(df: DataFrame, column: str, top_k: int = 10) -> Chart:
    """The k most frequent values with their share of all rows, and the rest as "Other"."""
    top = top_k_categories(df, column, top_k).toDF("category", "count")
    top = top.withColumn("category", F.col("category").cast("string")).collect()
    total = df.count()
    rest = total - sum(r["count"] for r in top)
    rows = [(r["category"], r["count"], r["count"] / total) for r in top]
    if rest:
        other = "Other"
        while other in {r["category"] for r in top}:  # a real category has that name
            other += " (rest)"
        rows.append((other, rest, rest / total))
    data = df.sparkSession.createDataFrame(rows, "category string, count bigint, share double")
    return Chart(
        "pie",
        f"Share of {column}",
        Axis("category", column, "category"),
        Axis("count", "Count", "numeric"),
        column,
        data,
        {"total": total, "other_rows": rest},
    )


# --- points, lines and matrices -----------------------------------------------------------------


@register_chart("scatter")
def scatter(df: DataFrame, x: str, y: str, max_points: int = 1000, key: list[str] | None = None) -> Chart:
    """At most `max_points` points, chosen by the MD5 of the row's key so that the sample is repeatable."""
    check_columns(df, [x, y, *(key or [])])
    parts = [col(c).cast("string") if not is_complex(df, c) else F.to_json(col(c)) for c in key or df.columns]
    points = df.where(finite_only(col(x)).isNotNull() & finite_only(col(y)).isNotNull())
    data = (
        points.select(F.md5(F.concat_ws("|", *parts)).alias("__order"), col(x).alias("__x"), col(y).alias("__y"))
        .orderBy("__order", "__x", "__y")
        .limit(max_points)
        .select(F.col("__x").alias(x), *([F.col("__y").alias(y)] if y != x else []))
    )
    return Chart(
        "scatter", f"{y} by {x}", Axis(x, x, "numeric"), Axis(y, y, "numeric"), y, data, {"max_points": max_points}
    )


def is_complex(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.ArrayType, T.MapType, T.StructType))


# What `date_trunc` can cut a time to.
GRAINS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond")


# The least number of microseconds between two times cut to a grain (a day may lack an hour).
_SECOND = 1_000_000
_DAY = 23 * 3600 * _SECOND
LEAST_STEP = {
    "year": 365 * _DAY, "quarter": 90 * _DAY, "month": 28 * _DAY, "week": 7 * _DAY, "day": _DAY, "hour": 1800 * _SECOND,
    "minute": 60 * _SECOND, "second": _SECOND, "millisecond": 1000, "microsecond": 1,
}

MAX_POINTS = 8000


def thinned(points: DataFrame, time: str, value: str, least: int, most: int, max_points: int) -> DataFrame:
    """At most `max_points` points that draw the same line: first, last, least and largest of each of `max_points` / 4 spans of time.

    `points` has one row per time, between the microseconds `least` and `most`. Of equal values the earliest counts, and nulls are neither
    least nor largest. It is one aggregate, combined before the shuffle: a task sends at most one row per span.
    """
    width = (most - least) // (max_points // 4) + 1
    moment, amount = F.unix_micros(col(time)), col(value)
    span = F.call_function("div", moment - least, F.lit(width))

    def ranked(by: Column) -> Column:
        return F.when(amount.isNotNull(), F.struct(amount.alias("v"), by.alias("m"), col(time).alias("t")))

    point = F.struct(col(time).alias("t"), amount.alias("v"))
    low, high = F.min(ranked(moment)), F.max(ranked(-moment))
    ends = points.groupBy(span.alias("__span")).agg(
        F.min_by(point, moment).alias("first"), F.max_by(point, moment).alias("last"), low.alias("low"), high.alias("high")
    )
    marks = [F.col("first"), F.col("last"), *[F.when(F.col(c).isNotNull(), F.struct(f"{c}.t", f"{c}.v")) for c in ("low", "high")]]
    each = ends.select(F.explode(F.array_distinct(F.array_compact(F.array(*marks)))).alias("p"))
    return each.select(F.col("p.t").alias(time), F.col("p.v").alias(value))


@register_chart("line")
def line(
    df: DataFrame, time: str, value: str | None = None, grain: str = "day", how: str = "mean", max_points: int = MAX_POINTS
) -> Chart:
    """One point per `grain` of the time column: the row count, or mean / sum / min / max of `value`.

    More than `max_points` points are thinned: each of `max_points` / 4 spans of time keeps its first, last, least and largest.
    """
    check_columns(df, [time, *([value] if value else [])])
    functions = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    if how not in functions:
        raise ValueError(f"unknown aggregate: {how}")
    if grain.lower() not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    if max_points < 4:
        raise ValueError("max_points must be at least 4")
    key = value or "count"
    aggregate = functions[how](finite_only(col(value))) if value else F.count("*")
    moment = F.date_trunc(grain, col(time))
    data = df.where(col(time).isNotNull()).groupBy(moment.alias(time)).agg(aggregate.alias(key))
    least, most = df.agg(F.min(F.unix_micros(moment)), F.max(F.unix_micros(moment))).first()
    # points are counted only where the times allow for too many
    if least is not None and (most - least) // LEAST_STEP[grain.lower()] >= max_points and data.count() > max_points:
        data = thinned(data, time, key, least, most, max_points)
    data = data.orderBy(col(time))
    label = f"{how} of {value}" if value else "Count"
    return Chart("line", f"{label} per {grain}", Axis(time, time, "time"), Axis(key, label, "numeric"), key, data)


@register_chart("heatmap")
def heatmap(df: DataFrame, columns: list[str] | None = None) -> Chart:
    """The correlation matrix in long form: (x, y, value)."""
    data = correlation_matrix(df, columns).withColumnRenamed("correlation", "value").orderBy("x", "y")
    return Chart("heatmap", "Correlation", Axis("x", "Column"), Axis("y", "Column"), "correlation", data)


def importance_chart(spark: SparkSession, name: str, importance: dict[str, float] | None) -> Chart:
    """Feature importances as a bar chart, largest first."""
    rows = spark.createDataFrame([(name, importance or {})], "name string, importance map<string,double>")
    data = rows.select(F.explode("importance").alias("feature", "importance"))
    return Chart(
        "bar",
        f"Feature importance of {name}",
        Axis("feature", "Feature", "category"),
        Axis("importance", "Importance", "numeric"),
        name,
        data.orderBy(F.desc("importance"), "feature"),
    )


# --- views over a whole dataset -----------------------------------------------------------------


def drilldown(df: DataFrame, column: str, value: Any = ..., of: str | None = None, **options: Any) -> Chart:
    """The chart that fits a column; with `value`, the chart of column `of` over the rows that have it."""
    check_columns(df, [column])
    if value is not ...:
        df = df.where(equals(column, value))
        column = of or column
    if is_numeric(df.schema[column].dataType):
        return histogram(df, column, **options)
    return bar(df, column, **options)


def _chart_counts(
    df: DataFrame, bins: int, max_categories: int
) -> tuple[dict[str, _Bins], dict[str, int], list[str], DataFrame | None]:
    ranges, left_out = _ranges(df, numeric_columns(df), bins)
    categories = categorical_columns(df, max_categories)
    parts = []
    if ranges:
        parts.append(_histogram_rows(df, ranges).select(
            F.lit("histogram").alias("type"), "column_name", "bin", F.lit(None).cast("string").alias("category"), "count"
        ))
    if categories:
        wide = df.select(*[col(c).cast("string").alias(str(i)) for i, c in enumerate(categories)])
        names = F.array(*[F.lit(c) for c in categories])
        long = wide.unpivot([], [col(str(i)) for i in range(len(categories))], "position", "category")
        parts.append(
            long.groupBy("position", "category")
            .agg(F.count("*").alias("count"))
            .select(
                F.lit("bar").alias("type"),
                F.get(names, F.col("position").cast("int")).alias("column_name"),
                F.lit(None).cast("double").alias("bin"),
                "category",
                "count",
            )
        )
    return ranges, left_out, categories, reduce(DataFrame.unionByName, parts) if parts else None


def auto_chart_rows(df: DataFrame, bins: int = 30, max_categories: int = 50) -> DataFrame:
    """All automatic charts as one long table: (type, column_name, bin, category, count).

    A histogram per numeric column and the counts of every categorical column with at most
    `max_categories` values; other columns are skipped.
    """
    rows = _chart_counts(df, bins, max_categories)[3]
    if rows is None:
        schema = "type string, column_name string, bin double, category string, count bigint"
        return df.sparkSession.createDataFrame([], schema)
    return rows


def auto_charts(df: DataFrame, bins: int = 30, max_categories: int = 50, top_k: int = 20) -> list[Chart]:
    """The automatic charts one by one, from a single counting job over bounded results."""
    ranges, left_out, categories, counts = _chart_counts(df, bins, max_categories)
    if counts is None:
        return []
    spark = df.sparkSession
    found: dict[str, list] = {}
    for r in counts.collect():
        found.setdefault(r["column_name"], []).append(r)
    charts = []
    for c in df.columns:
        rows = found.get(c, [])
        if c in ranges:
            points = sorted((r["bin"], r["count"]) for r in rows)
            charts.append(_histogram_chart(c, spark.createDataFrame(points, "bin double, count bigint"), left_out[c]))
        elif c in categories:
            ranked = sorted(rows, key=lambda r: (-r["count"], r["category"] is None, r["category"] or ""))[:top_k]
            schema = T.StructType([T.StructField(c, T.StringType()), T.StructField(count_name(c), T.LongType())])
            data = spark.createDataFrame([(r["category"], r["count"]) for r in ranked], schema)
            charts.append(_bar_chart(c, top_k, data))
    return charts
