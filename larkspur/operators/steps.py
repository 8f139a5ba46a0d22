"""Cleaning steps: each takes a DataFrame and returns the cleaned one with an audit log.

A step runs at most a few aggregates to learn its constants and then adds one lazy projection or
filter, so a chain of steps stays a chain of narrow operations over the scan. New steps register
with `register_step`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.scalars import fill_null
from larkspur.functions.types import check_columns, col, is_nested, is_numeric, number, numeric_columns
from larkspur.operators.columns import replace_columns
from larkspur.operators.profile import categorical_columns, fences, outside
from larkspur.operators.quantiles import medians
from larkspur.operators.ranking import rank_within
from larkspur.session import cut_lineage

Log = dict[str, Any]
Step = Callable[..., tuple[DataFrame, Log]]

STEPS: dict[str, Step] = {}

UNKNOWN = "Unknown"  # fixed value: the fill of non-numeric columns
BROADCAST_BYTES = 32 * 1024 * 1024  # a code table up to this size is broadcast
HOT_SHARE = 1_000  # a value with more than 1/HOT_SHARE of the rows is salted
SALTS = 64


def register_step(name: str) -> Callable[[Step], Step]:
    def add(step: Step) -> Step:
        STEPS[name] = step
        return step

    return add


# --- missing values -----------------------------------------------------------------------------


@register_step("handle_missing")
def handle_missing(
    df: DataFrame, strategy: str = "mean", value: Any = None, approximate: bool = False
) -> tuple[DataFrame, Log]:
    """Fill or drop missing values; columns without nulls are neither touched nor logged.

    mean / median: numbers get the statistic (integers become double), anything else "Unknown".
    fill: `value` goes to the columns it fits, or is a dict of column to value.
    drop: rows with any null are removed.
    """
    if strategy not in ("mean", "median", "drop", "fill"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "fill" and value is None:
        raise ValueError("strategy 'fill' needs a value")

    fields = {f.name: f for f in df.schema}
    facts = {c: [F.count_if(col(c).isNull())] for c in df.columns}
    for c, found in facts.items():
        found.append(F.avg(number(df, c)) if strategy == "mean" and is_numeric(fields[c].dataType) else F.lit(None))
    any_null = reduce(Column.__or__, [col(c).isNull() for c in df.columns], F.lit(False))
    row = df.agg(
        F.count_if(any_null).alias("rows"),
        *[F.struct(*[e.alias(k) for k, e in zip(("nulls", "mean"), found)]).alias(f"c{i}")
          for i, found in enumerate(facts.values())],
    ).first()
    nulls = {c: row[f"c{i}"]["nulls"] for i, c in enumerate(df.columns)}
    means = {c: row[f"c{i}"]["mean"] for i, c in enumerate(df.columns)}
    missing = [c for c in df.columns if nulls[c] > 0]
    log: Log = {"strategy": strategy, "affected": []}

    if strategy == "drop":
        log["affected"] = [{"column": c, "fill": None} for c in missing]
        log["removed_rows"] = row["rows"]
        return (df.dropna("any") if missing else df), log

    numeric = [c for c in missing if is_numeric(fields[c].dataType)]
    if strategy == "median":
        fills: dict[str, Any] = dict(medians(df, numeric, approximate))
    elif strategy == "mean":
        fills = {c: means[c] for c in numeric}
    else:
        fills = {c: v for c in missing if (v := _fitting(fields[c], value)) is not None}

    replacements = {}
    for c in missing:
        if strategy != "fill" and not is_numeric(fields[c].dataType):
            fills[c] = UNKNOWN
        if c not in fills:
            continue
        fill = fills[c]
        if fill is not None:
            replacements[c] = _filled(fields[c], fill)
        log["affected"].append({"column": c, "fill": fill})
    return replace_columns(df, replacements), log


def _fitting(field: T.StructField, value: Any) -> Any:
    """The constant for this column: from a dict by name, else only where the kinds agree."""
    if isinstance(value, dict):
        return value.get(field.name)
    if isinstance(value, bool):
        return value if isinstance(field.dataType, T.BooleanType) else None
    if isinstance(value, (int, float)):
        return value if is_numeric(field.dataType) else None
    return value if isinstance(field.dataType, T.StringType) else None


def _filled(field: T.StructField, fill: Any) -> Column:
    column = col(field.name)
    if is_numeric(field.dataType):
        whole = isinstance(field.dataType, T.IntegralType) and isinstance(fill, int)
        return fill_null(column.cast("long" if whole else "double"), fill)
    if isinstance(fill, str):
        text = F.to_json(column) if is_nested(field.dataType) else column.cast("string")
        return fill_null(text, fill)
    return fill_null(column, fill)


# --- outliers -----------------------------------------------------------------------------------


@register_step("remove_outliers")
def remove_outliers(
    df: DataFrame,
    method: str = "iqr",
    threshold: float = 1.5,
    columns: list[str] | None = None,
    approximate: bool = False,
) -> tuple[DataFrame, Log]:
    """Keep the rows whose numbers all lie within the IQR fences of the input, missing ones included."""
    if method != "iqr":
        raise ValueError(f"unknown method: {method}")
    found = fences(df, columns, threshold, approximate)
    log: Log = {"method": method, "threshold": threshold, "affected": []}
    if not found:
        return df, log
    beyond = {c: outside(df, c, f) for c, f in found.items()}
    row = df.agg(*[F.count_if(out).alias(str(i)) for i, out in enumerate(beyond.values())]).first()
    log["affected"] = [
        {"column": c, "lower": f["lower"], "upper": f["upper"], "removed_rows": row[i]}
        for i, (c, f) in enumerate(found.items())
    ]
    return df.where(~reduce(Column.__or__, beyond.values())), log


# --- encoding -----------------------------------------------------------------------------------


@register_step("encode_categorical")
def encode_categorical(
    df: DataFrame, method: str = "onehot", columns: list[str] | None = None, max_categories: int = 50
) -> tuple[DataFrame, Log]:
    """Encode categorical columns as indicators (`onehot`) or as 0..k-1 in value order (`label`).

    Without `columns`, label encoding takes all non-numeric columns, whatever their number of values. One-hot, whose
    schema would have no bound, takes those with at most `max_categories` values and logs the others as
    `skipped`; naming such a column is an error.
    """
    if method not in ("onehot", "label"):
        raise ValueError(f"unknown method: {method}")
    if columns is not None:
        check_columns(df, columns)
    plain = [f.name for f in df.schema if not is_numeric(f.dataType) and not is_nested(f.dataType)]
    if columns is not None:
        chosen = list(columns)
    else:
        chosen = plain if method == "label" else categorical_columns(df, max_categories)
    skipped = [c for c in plain if c not in chosen] if columns is None else []
    if chosen:
        encoded, log = _one_hot(df, chosen, max_categories) if method == "onehot" else _label(df, chosen)
    else:
        encoded, log = df, {"method": method, "affected": []}
    return encoded, {**log, "skipped": skipped} if skipped else log


def distinct_values(df: DataFrame, columns: list[str], max_categories: int) -> dict[str, list[Any]]:
    """The sorted values of columns that have at most `max_categories`, nulls last; else an error."""
    rough = df.agg(*[F.approx_count_distinct(col(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    found = {}
    for i, c in enumerate(columns):
        # The sketch errs by a few per cent, so twice the limit is certainly beyond it.
        rows = [] if rough[i] > 2 * max_categories + 10 else df.select(col(c).alias("v")).distinct().collect()
        if not rows and rough[i] or len(rows) > max_categories:
            raise ValueError(f"column {c} has more than {max_categories} categories")
        values = sorted(r["v"] for r in rows if r["v"] is not None)
        found[c] = values + [None] * any(r["v"] is None for r in rows)
    return found


def _one_hot(df: DataFrame, columns: list[str], max_categories: int) -> tuple[DataFrame, Log]:
    names: dict[str, list[str]] = {}
    indicators: dict[str, list[Column]] = {}
    for c, values in distinct_values(df, columns, max_categories).items():
        labels = [str(v).lower() if isinstance(v, bool) else str(v) for v in values if v is not None]
        if None in values:
            labels.append(next(n for n in ("null", *(f"null_{i}" for i in range(1, len(values) + 1))) if n not in labels))
        names[c] = [f"{c}_{label}" for label in labels]
        indicators[c] = [
            (col(c).isNull() if v is None else F.coalesce(col(c) == F.lit(v), F.lit(False))).cast("int").alias(name)
            for v, name in zip(values, names[c])
        ]
    produced = [n for c in df.columns for n in names.get(c, [c])]
    if len(set(produced)) < len(produced):
        raise ValueError("one-hot column names collide with existing columns")
    projection = [e for c in df.columns for e in indicators.get(c, [col(c)])]
    affected = [{"column": c, "columns": names[c]} for c in columns]
    return df.select(*projection), {"method": "onehot", "affected": affected}


def value_codes(df: DataFrame, column: str) -> DataFrame:
    """Codes 0..k-1 of the non-null values in ascending order, for any number of values: (value, code, rows)."""
    values = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("rows"))
    return rank_within(values, [], [F.col("value")], "code").withColumn("code", F.col("code") - 1)


def _label(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Log]:
    affected = []
    order = df.columns
    for c in columns:
        codes = cut_lineage(value_codes(df, c), "codes")
        size = F.sum(F.octet_length(F.col("value").cast("string")) + 16)
        facts = codes.agg(F.count("*").alias("values"), F.sum("rows").alias("rows"), size.alias("bytes")).first()
        if (facts["bytes"] or 0) <= BROADCAST_BYTES:
            df = _attach_small(df, c, codes)
        else:
            df = _attach_large(df, c, codes, facts["rows"])
        affected.append({"column": c, "categories": facts["values"]})
    return df.select(*map(col, order)), {"method": "label", "affected": affected}


def _attach_small(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Replace the column by its code through a broadcast of the codes, whose bytes were counted."""
    table = codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    found = df.join(F.broadcast(table), col(column) == F.col("__value"), "left")
    return found.select(*[col(c) for c in df.columns if c != column], F.col("__code").alias(column))


def _attach_large(df: DataFrame, column: str, codes: DataFrame, rows: int) -> DataFrame:
    """Replace the column by its code through a shuffle in which nulls and hot values are spread."""
    others = [col(c) for c in df.columns if c != column]
    # Fewer than HOT_SHARE values can each hold more than that share, so this list has a bound.
    frequent = codes.where(F.col("rows") > rows / HOT_SHARE)
    hot = [r["h"] for r in frequent.select(F.xxhash64("value").alias("h")).distinct().collect()]

    def is_hot(value: Column) -> Column:
        return F.xxhash64(value).isin(hot)

    spread = F.floor(F.rand() * SALTS).cast("int") if not others else F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")
    salted = df.withColumn("__salt", F.when(col(column).isNull() | is_hot(col(column)), spread).otherwise(0))
    copies = F.when(is_hot(F.col("value")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    table = codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"), F.explode(copies).alias("__copy"))
    same = (col(column) == F.col("__value")) & (F.col("__salt") == F.col("__copy"))
    return salted.join(table, same, "left").select(*others, F.col("__code").alias(column))


# --- scaling ------------------------------------------------------------------------------------


@register_step("normalize")
def normalize(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, Log]:
    """Z-score of the numeric columns: (x - mean) / sample deviation; a constant column becomes 0."""
    columns = check_columns(df, list(columns)) if columns is not None else numeric_columns(df)
    if not columns:
        return df, {"method": "zscore", "affected": []}
    row = df.agg(
        *[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(number(df, c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    replacements, affected = {}, []
    for i, c in enumerate(columns):
        mean, std = row[f"m{i}"], row[f"s{i}"] or 0.0
        affected.append({"column": c, "mean": mean, "std": std})
        if mean is not None:
            value = col(c).cast("double")
            replacements[c] = (value - mean) / std if std else value - value
    return replace_columns(df, replacements), {"method": "zscore", "affected": affected}
