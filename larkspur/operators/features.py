"""Features and target: from a plain table to the vectors the estimators train on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline as Stages
from pyspark.ml.feature import (
    FeatureHasher,
    Imputer,
    IndexToString,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
    VectorSizeHint,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.types import check_columns, col, is_nested, is_numeric, number
from larkspur.operators.profile import categorical_columns

#: Vector slots of a column that has too many values for one indicator each.
HASH_SLOTS = 64
#: Classes that a target may have; the driver holds their names, and a forest counts each in every node.
MAX_CLASSES = 10_000


@dataclass
class Features:
    """A fitted preparation: `model` adds `features` and, when the target is there, `label`."""

    model: PipelineModel
    target: str
    task: str
    numeric: list[str]
    categorical: list[str]  # indicators and vectors
    hashed: list[str]
    classes: list[str]  # empty for regression
    slots: list[str]  # the source column of every vector slot

    def importance(self, slots: list[float] | None) -> dict[str, float] | None:
        """Slot importances summed by source column."""
        if slots is None:
            return None
        found = dict.fromkeys([*self.numeric, *self.categorical, *self.hashed], 0.0)
        for name, value in zip(self.slots, slots):
            found[name] += value
        return found

    def label_back(self) -> list[IndexToString]:
        """For classification, the stage that turns a predicted index into the class name."""
        if not self.classes:
            return []
        return [IndexToString(inputCol="prediction", outputCol="predicted", labels=self.classes)]


def split_xy(df: DataFrame, target: str, features: list[str] | None = None) -> tuple[list[str], str]:
    """The feature columns and the target column."""
    check_columns(df, [target, *(features or [])])
    if features and target in features:
        raise ValueError("the target cannot be a feature")
    return list(features or [c for c in df.columns if c != target]), target


def _numeric_like(df: DataFrame, column: str) -> bool:
    return is_numeric(df.schema[column].dataType) or isinstance(df.schema[column].dataType, T.BooleanType)


def fit_features(
    df: DataFrame,
    target: str,
    task: str,
    features: list[str] | None = None,
    max_categories: int = 50,
    hash_slots: int = HASH_SLOTS,
) -> Features:
    """Learn the preparation on (training) rows.

    Numbers and booleans: mean for missing values. Text and dates with at most `max_categories`
    values: indicators; with more: indicators of `hash_slots` hash slots, none for null. Vectors pass as
    they are; rows without one are an error. Nested columns and those without any value are left out.
    The driver and the models hold one entry per class, however many there are.
    """
    if task not in ("classification", "regression"):
        raise ValueError(f"unknown task: {task}")
    wanted, target = split_xy(df, target, features)
    vectors = [c for c in wanted if type(df.schema[c].dataType).__name__ == "VectorUDT"]
    numeric = [c for c in wanted if _numeric_like(df, c)]
    rest = [c for c in wanted if c not in numeric and c not in vectors and not is_nested(df.schema[c].dataType)]
    known = df.where(col(target).isNotNull())
    counted = [*numeric, *rest, *vectors]
    facts = [F.count(_as_number(df, c) if c in numeric else col(c)).alias(str(i)) for i, c in enumerate(counted)]
    facts += [F.first(col(c), ignorenulls=True).alias(f"v{i}") for i, c in enumerate(vectors)]
    found = known.agg(F.count("*").alias("rows"), *facts).first()
    filled = {c: found[str(i)] for i, c in enumerate(counted)}
    numeric, rest = ([c for c in kind if filled[c]] for kind in (numeric, rest))
    vectors = vectors if found["rows"] else []
    for c in vectors:
        if filled[c] < found["rows"]:
            raise ValueError(f"{found['rows'] - filled[c]} rows have no vector in {c}; fill or drop them first")
    widths = {c: found[f"v{i}"].size for i, c in enumerate(vectors)}
    categorical = categorical_columns(known, max_categories, rest) if rest else []
    hashed = [c for c in rest if c not in categorical]
    if not (numeric or rest or vectors):
        raise ValueError("no usable feature column")

    stages, inputs = [], []
    casts = [f"CAST({_sql(c)} AS DOUBLE) AS `__n{i}`" for i, c in enumerate(numeric)]
    casts += [f"CAST({_sql(c)} AS STRING) AS `__c{i}`" for i, c in enumerate(categorical)]
    casts += [f"CAST({_sql(c)} AS STRING) AS `__h{i}`" for i, c in enumerate(hashed)]
    if casts:
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(casts)} FROM __THIS__"))
    if numeric:
        raw, mean = ([f"__{k}{i}" for i in range(len(numeric))] for k in "nm")
        stages.append(Imputer(strategy="mean", inputCols=raw, outputCols=mean))
        inputs += mean
    if categorical:
        texts, indexes, flags = ([f"__{k}{i}" for i in range(len(categorical))] for k in "cif")
        stages.append(
            StringIndexer(
                inputCols=texts, outputCols=indexes, stringOrderType="alphabetAsc", handleInvalid="keep"
            )
        )
        stages.append(OneHotEncoder(inputCols=indexes, outputCols=flags, dropLast=False))
        inputs += flags
    for i in range(len(hashed)):
        stages.append(FeatureHasher(inputCols=[f"__h{i}"], outputCol=f"__g{i}", numFeatures=hash_slots))
        inputs.append(f"__g{i}")
    stages += [VectorSizeHint(inputCol=c, size=widths[c]) for c in vectors]
    stages.append(VectorAssembler(inputCols=inputs + vectors, outputCol="features", handleInvalid="keep"))

    classes: list[str] = []
    if task == "classification":
        values = known.select(col(target).alias("v")).distinct().orderBy("v")
        texts = values.limit(MAX_CLASSES + 1).select(F.col("v").cast("string").alias("v")).collect()
        if len(texts) > MAX_CLASSES:
            raise ValueError(f"{target} has over {MAX_CLASSES} different values: too many for classes")
        classes = list(dict.fromkeys(r["v"] for r in texts))

    model = Stages(stages=stages).fit(known)
    sizes = [s for stage in model.stages if hasattr(stage, "categorySizes") for s in stage.categorySizes]
    slots = list(numeric)
    for c, size in zip(categorical, sizes):
        slots += [c] * size
    for c in hashed:
        slots += [c] * hash_slots
    for c in vectors:
        slots += [c] * widths[c]
    return Features(model, target, task, numeric, categorical + vectors, hashed, classes, slots)


def _as_number(df: DataFrame, column: str):
    if isinstance(df.schema[column].dataType, T.BooleanType):
        return col(column)
    return number(df, column)


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def features_target(df: DataFrame, prepared: Features, weight: str | None = None) -> DataFrame:
    """The rows with a known target as (features, label), and their weights if a column has them."""
    kept = [col(weight)] if weight else []
    known = df.where(col(prepared.target).isNotNull())
    ready = prepared.model.transform(known)
    if prepared.classes:
        indexer = StringIndexerModel.from_labels(prepared.classes, "__class", "__label", handleInvalid="keep")
        ready = indexer.transform(ready.withColumn("__class", col(prepared.target).cast("string")))
        label = F.when(F.col("__label") < len(prepared.classes), F.col("__label"))
        # estimators read the number of classes here; they would not look for more than 100 by themselves
        named = {"ml_attr": {"type": "nominal", "name": "label", "vals": prepared.classes}}
        return ready.select("features", label.alias("label", metadata=named), *kept)
    return ready.select("features", col(prepared.target).cast("double").alias("label"), *kept)
