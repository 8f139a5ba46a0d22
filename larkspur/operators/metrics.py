"""Quality of predictions, computed from small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.types import col


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None) -> DataFrame:
    """Rows of each pair; a row counts as often as its whole `weight` says."""
    rows = F.sum(col(weight)).cast("long") if weight else F.count("*")
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(rows.alias("rows"))


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None
) -> DataFrame:
    """One row (accuracy, f1_macro); F1 is averaged over the classes in labels or predictions."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0)
    sides = confusion(df, label, prediction, weight).select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("rows").alias("actual"),
                         F.lit(0).cast("long").alias("predicted"), hit.alias("hits")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"),
                         F.col("rows").alias("predicted"), F.lit(0).cast("long").alias("hits")),
            )
        )
    )
    classes = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")])
    return classes.agg(
        F.try_divide(F.sum("hits"), F.sum("actual")).alias("accuracy"),
        F.avg(2.0 * F.col("hits") / (F.col("actual") + F.col("predicted"))).alias("f1_macro"),
    )


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None
) -> DataFrame:
    """One row (r2, rmse, mae); a constant label gives r2 1 for a perfect prediction, else 0."""
    y, error = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    if weight:
        # var_pop has no weights: the mean comes first, then the deviations from it
        w = col(weight)
        mean = df.agg(F.try_divide(F.sum(w * y), F.sum(F.when(y.isNotNull(), w)))).first()[0]
        sse, sst = F.sum(w * error * error), F.sum(w * (y - F.lit(mean)) * (y - F.lit(mean)))
        known = F.sum(F.when(error.isNotNull(), w))
        squared, absolute = F.try_divide(sse, known), F.try_divide(F.sum(w * F.abs(error)), known)
    else:
        sse, sst = F.sum(error * error), F.var_pop(y) * F.count(y)
        squared, absolute = F.avg(error * error), F.avg(F.abs(error))
    r2 = F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1.0 - F.try_divide(sse, sst))
    return df.agg(r2.alias("r2"), F.sqrt(squared).alias("rmse"), absolute.alias("mae"))
