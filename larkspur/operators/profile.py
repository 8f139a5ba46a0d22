"""Column profiles: counts, distinct values, numeric statistics, samples, correlation, outliers.

A profile costs one wide aggregate plus one distinct count per data type, whatever the number of
columns. Distinct counting unpivots the columns of one type to (column, value) and groups twice, so
hot values shrink before the shuffle and no task sees a whole column.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.scalars import finite_only, json_payload, to_float, zero_if_null
from larkspur.functions.types import (
    check_columns,
    col,
    dtype_name,
    is_fractional,
    is_nested,
    is_numeric,
    number,
    numeric_columns,
)
from larkspur.operators.gram import pair_sums
from larkspur.operators.quantiles import quantiles

STATS_TYPE = "struct<min:double,max:double,mean:double,std:double>"
LONG_VALUE = 63  # longer strings are grouped by their SHA-256, which is 64 characters
PAIRS_PER_PASS = 300
LOST = 1e-6  # a variance below this share of its sum of squares has lost too many digits


# --- counts -------------------------------------------------------------------------------------


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def column_count(df: DataFrame) -> int:
    return len(df.columns)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Nulls of every column, in one aggregate."""
    columns = columns or df.columns
    if not columns:
        return {}
    row = df.agg(*[F.count_if(col(c).isNull()).alias(str(i)) for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def columns_with_nulls(df: DataFrame) -> list[str]:
    return [c for c, n in null_counts(df).items() if n > 0]


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null is a value."""
    check_columns(df, [column])
    return df.groupBy(col(column)).agg(F.count("*").alias(count_name(column)))


def count_name(column: str) -> str:
    """The name of the count next to `column`, which may itself be called `count`."""
    return "count" if column != "count" else "rows"


# --- distinct values ----------------------------------------------------------------------------


def _comparable(field: T.StructField) -> Column:
    """The column in the form its values are compared in: one type per family, nested as JSON."""
    value = col(field.name)
    if is_nested(field.dataType):
        return F.to_json(F.struct(value.alias("v")))
    if isinstance(field.dataType, T.IntegralType):
        return value.cast("long")
    if is_fractional(field.dataType):
        return value.cast("double")
    return value


def _key(data_type: T.DataType, value: Column) -> Column:
    """A short grouping key: long texts are replaced by a digest of the whole text."""
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.when(F.length(value) > LONG_VALUE, F.sha2(value.cast("binary"), 256)).otherwise(value.cast("string"))
    return value


def _families(df: DataFrame, columns: list[str]) -> list[tuple[T.DataType, list[tuple[int, Column]]]]:
    """Positions and comparable expressions of `columns`, grouped by data type."""
    families: dict[str, tuple[T.DataType, list[tuple[int, Column]]]] = {}
    typed = df.select(*[_comparable(df.schema[c]).alias(str(i)) for i, c in enumerate(columns)]).schema
    for i, c in enumerate(columns):
        data_type = typed[i].dataType
        families.setdefault(data_type.simpleString(), (data_type, []))[1].append((i, _comparable(df.schema[c])))
    return list(families.values())


def _words(data_type: T.DataType, value: Column) -> tuple[Column, Column, Column]:
    """64 neighbouring whole numbers or days share a row with one bit each: (group, bits, distinct values of the bits).

    Numbers that lie close, such as ids, codes and dates, thus move as a 64th of their distinct values; numbers that lie apart as one
    row each, as without bits. Null has a group of its own, without bits.
    """
    number = F.unix_date(value).cast("long") if isinstance(data_type, T.DateType) else value
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(63).cast("int"))
    return F.shiftright(number, 6), F.bit_or(bit), F.coalesce(F.bit_count("__content"), F.lit(1))


def unique_counts(df: DataFrame, columns: list[str] | None = None, by: list[str] = ()) -> DataFrame:
    """Exact distinct values per column, null counted as one value: [*by, position, unique_count]."""
    columns = list(columns or df.columns)
    parts = []
    keys = [col(b) for b in by]
    for data_type, members in _families(df, columns):
        wide = df.select(*keys, *[_key(data_type, value).alias(str(i)) for i, value in members])
        long = wide.unpivot(keys, [col(str(i)) for i, _ in members], "__position", "__value")
        if isinstance(data_type, (T.LongType, T.DateType)):
            group, content, distinct = _words(data_type, F.col("__value"))
        else:
            group, content, distinct = F.col("__value"), F.count("*"), F.lit(1)
        parts.append(
            long.groupBy(*keys, "__position", group.alias("__group"))
            .agg(content.alias("__content"))
            .groupBy(*keys, F.col("__position").cast("int").alias("position"))
            .agg(F.sum(distinct).cast("long").alias("unique_count"))
        )
    return reduce(DataFrame.unionByName, parts)


def _rough_unique_count(df: DataFrame, column: str) -> Column:
    null = F.when(F.count_if(col(column).isNull()) > 0, 1).otherwise(0)
    return (F.approx_count_distinct(_comparable(df.schema[column])) + null).cast("long")


def sample_values(df: DataFrame, columns: list[str] | None = None, n: int = 5, by: list[str] = ()) -> DataFrame:
    """The n most frequent non-null values per column, ties ascending.

    Returns [*by, column_name, value, count, rank]. The ranking keeps n rows per column and task
    before its shuffle, so a column of unique values does not meet in one task.
    """
    columns = check_columns(df, list(columns or df.columns))
    keys = [col(b) for b in by]
    parts = []
    for _, members in _families(df, columns):
        wide = df.select(*keys, *[value.alias(str(i)) for i, value in members])
        counts = (
            wide.unpivot(keys, [col(str(i)) for i, _ in members], "__position", "__value")
            .where(F.col("__value").isNotNull())
            .groupBy(*keys, "__position", "__value")
            .agg(F.count("*").alias("count"))
        )
        order = Window.partitionBy(*keys, "__position").orderBy(F.desc("count"), F.asc("__value"))
        parts.append(
            counts.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= n)
            .withColumn("__value", F.col("__value").cast("string"))
        )
    names = F.array(*[F.lit(c) for c in columns])
    return reduce(DataFrame.unionByName, parts).select(
        *keys, F.get(names, F.col("__position").cast("int")).alias("column_name"), F.col("__value").alias("value"), "count", "rank"
    )


# --- profile ------------------------------------------------------------------------------------


def _stats(df: DataFrame, name: str) -> Column:
    """min, max, mean and sample deviation, or null when there is no number to describe."""
    if not is_numeric(df.schema[name].dataType):
        return F.lit(None).cast(STATS_TYPE)
    value = number(df, name)
    return F.when(
        F.count(value) > 0,
        F.struct(
            to_float(F.min(value)).alias("min"),
            to_float(F.max(value)).alias("max"),
            F.avg(value).alias("mean"),
            zero_if_null(F.stddev_samp(value)).alias("std"),
        ),
    ).cast(STATS_TYPE)


def profile(
    df: DataFrame, columns: list[str] | None = None, by: list[str] = (), approximate: bool = False
) -> DataFrame:
    """One row per column: [*by, position, column_name, dtype, row_count, null_count, unique_count, stats].

    With `by`, every group (for example every source file) gets its own profile in the same jobs.
    `approximate` sketches the distinct counts, which leaves a single pass without a large shuffle.
    """
    keys = [col(b) for b in by]
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in by]
    check_columns(df, columns)
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            F.lit(dtype_name(df.schema[c].dataType)).alias("dtype"),
            F.count_if(col(c).isNull()).alias("null_count"),
            _stats(df, c).alias("stats"),
            *([_rough_unique_count(df, c).alias("unique_count")] if approximate else []),
        )
        for i, c in enumerate(columns)
    ]
    wide = df.groupBy(*keys).agg(F.count("*").alias("row_count"), F.array(*rows).alias("columns"))
    facts = wide.select(*keys, "row_count", F.inline("columns"))
    found = facts if approximate else facts.join(unique_counts(df, columns, by), [*by, "position"], "left")
    return found.select(
        *keys,
        "position",
        "column_name",
        "dtype",
        "row_count",
        "null_count",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        "stats",
    )


def profile_column(df: DataFrame, column: str) -> DataFrame:
    return profile(df.select(col(column)), [column])


def dataset_profile(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """The nested form: row_count, column_count and an array with one struct per column."""
    keys = [col(b) for b in by]
    entry = F.struct("position", F.col("column_name").alias("name"), "dtype", "null_count", "unique_count", "stats")
    return (
        profile(df, by=by)
        .groupBy(*keys)
        .agg(
            F.first("row_count").alias("row_count"),
            F.count("*").cast("int").alias("column_count"),
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("position")).alias("columns"),
        )
    )


def profile_json(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """The nested profile as one JSON payload per dataset."""
    nested = dataset_profile(df, by)
    parts = {k: F.col(k) for k in ("row_count", "column_count", "columns")}
    return nested.select(*[col(b) for b in by], "row_count", "column_count", json_payload(**parts).alias("profile"))


def profile_dict(df: DataFrame) -> dict[str, Any]:
    """The nested profile as a driver value; one entry per column. Columns without numbers carry no stats."""
    if not df.columns:
        return {"row_count": df.count(), "column_count": 0, "columns": []}
    result = dataset_profile(df).first().asDict(recursive=True)
    for entry in result["columns"]:
        if entry["stats"] is None:
            del entry["stats"]
    return result


# --- choosing columns ---------------------------------------------------------------------------


def categorical_columns(df: DataFrame, max_categories: int = 50, columns: list[str] | None = None) -> list[str]:
    """Non-numeric, non-nested columns with at most `max_categories` values, null counted as one.

    A sketch rules out the columns that are far above the limit, so that only the few close ones are
    counted exactly.
    """
    wanted = [
        f.name
        for f in df.schema
        if not is_numeric(f.dataType) and not is_nested(f.dataType) and (columns is None or f.name in columns)
    ]
    if not wanted:
        return []
    rough = df.agg(*[F.approx_count_distinct(col(c)).alias(str(i)) for i, c in enumerate(wanted)]).first()
    near = [c for i, c in enumerate(wanted) if rough[i] <= 2 * max_categories + 10]
    if not near:
        return []
    exact = {r["position"]: r["unique_count"] for r in unique_counts(df.select(*map(col, near)), near).collect()}
    return [c for i, c in enumerate(near) if exact.get(i, 0) <= max_categories]


# --- correlation and outliers -------------------------------------------------------------------


def _pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are present; null, not an error, without variance."""
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x)))


def _centred_pearson(x: Column, y: Column) -> Column:
    """Correlation of columns without gaps whose mean was taken off: plain sums, shared by all pairs."""
    return F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)))


def _products(
    values: DataFrame, fact: dict[str, Any], pairs: list[tuple[str, str]]
) -> tuple[list[tuple[str, str, float | None]], list[tuple[str, str]]]:
    """The correlations that sums of products give, both ways round, and the pairs whose sums lost too many digits."""
    names = list(fact)
    varying = [c for c in names if fact[c]["varies"]]
    known: dict[tuple[str, str], float | None] = {p: None for p in pairs if not (fact[p[0]]["varies"] and fact[p[1]]["varies"])}
    if len(varying) > 1:
        found = pair_sums(
            values.select(*[col(str(names.index(c))) for c in varying]),
            [fact[c]["mean"] for c in varying],
            [fact[c]["max"] - fact[c]["min"] for c in varying],
        )
        n, x, y = F.col("n"), F.col("xx") - F.col("x") * F.try_divide("x", "n"), F.col("yy") - F.col("y") * F.try_divide("y", "n")
        sound = (n > 0) & (x > LOST * F.col("xx")) & (y > LOST * F.col("yy"))
        value = F.try_divide(F.col("xy") - F.col("x") * F.try_divide("y", "n"), F.sqrt(x) * F.sqrt(y))
        for row in found.select("a", "b", F.when(sound, value).alias("r")).where("r IS NOT NULL AND NOT isnan(r)").collect():
            known[varying[row["a"]], varying[row["b"]]] = row["r"]
    both = [(*names, r) for p, r in known.items() for names in (p, p[::-1])]
    return both, [p for p in pairs if p not in known]


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are present: [x, y, correlation].

    The diagonal is 1, a column without variance gives null. Up to `PAIRS_PER_PASS` pairs are one aggregate; more are
    matrix products, in one pass as well. The driver holds a row per pair, as the result does.
    """
    columns = check_columns(df, list(columns)) if columns is not None else numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "x string, y string, correlation double")
    values = {c: finite_only(col(c)) for c in columns}
    facts = [
        F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), (F.min(v) < F.max(v)).alias("varies"))
        for v in values.values()
    ]
    row = df.agg(F.count("*").alias("rows"), *[f.alias(f"c{i}") for i, f in enumerate(facts)]).first()
    fact = {c: row[f"c{i}"] for i, c in enumerate(columns)}

    # Where nothing is missing, the mean is taken off first and sums of products are enough.
    whole = {c for c in columns if fact[c]["n"] == row["rows"] and row["rows"]}
    centred = df.select(
        *[(values[c] - F.lit(fact[c]["mean"] if c in whole else 0.0)).alias(str(i)) for i, c in enumerate(columns)]
    )
    place = {c: col(str(i)) for i, c in enumerate(columns)}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    parts = []
    if len(pairs) > PAIRS_PER_PASS:
        known, pairs = _products(df.select(*[v.cast("double").alias(str(i)) for i, v in enumerate(values.values())]), fact, pairs)
        parts.append(df.sparkSession.createDataFrame(known, "x string, y string, correlation double"))
    pairs.sort(key=lambda p: not whole.issuperset(p))
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        entries = []
        for a, b in pairs[start : start + PAIRS_PER_PASS]:
            if not (fact[a]["varies"] and fact[b]["varies"]):
                value = F.lit(None).cast("double")
            else:
                value = (_centred_pearson if whole.issuperset((a, b)) else _pearson)(place[a], place[b])
            entries += [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), value.alias("correlation")) for x, y in ((a, b), (b, a))]
        parts.append(centred.agg(F.array(*entries).alias("p")).select(F.inline("p")))
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "x string, y string, correlation double")
    return reduce(DataFrame.unionByName, [*parts, diagonal])


def fences(
    df: DataFrame, columns: list[str] | None = None, threshold: float = 1.5, approximate: bool = False
) -> dict[str, dict[str, float]]:
    """Quartiles and IQR fences of every numeric column that has values."""
    found = {}
    for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75], approximate).items():
        if q1 is not None:
            reach = threshold * (q3 - q1)
            found[c] = {"q1": q1, "q3": q3, "lower": q1 - reach, "upper": q3 + reach}
    return found


def outside(df: DataFrame, column: str, fence: dict[str, float]) -> Column:
    """True for values beyond the fences; false for null and NaN."""
    value = number(df, column)
    return F.coalesce((value < fence["lower"]) | (value > fence["upper"]), F.lit(False))


def outlier_report(
    df: DataFrame, columns: list[str] | None = None, threshold: float = 1.5, approximate: bool = False
) -> DataFrame:
    """Fences and the number of values outside them, one row per numeric column."""
    found = fences(df, columns, threshold, approximate)
    if not found:
        return df.sparkSession.createDataFrame(
            [], "column_name string, q1 double, q3 double, lower double, upper double, outliers bigint"
        )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.lit(float(f[k])).alias(k) for k in ("q1", "q3", "lower", "upper")],
            F.count_if(outside(df, c, f)).alias("outliers"),
        )
        for c, f in found.items()
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
