import logging
import math
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import estimators, features, metrics, split
from larkspur.plans import automl
from larkspur.sources.catalog import Catalog


@pytest.fixture(scope="module")
def toy(spark):
    """1,000 rows: the class follows x and c, z is noise with gaps."""
    rng = random.Random(5)
    rows = []
    for i in range(1000):
        x, c, z = rng.random(), rng.choice("abc"), rng.random()
        rows.append((i, x, c, None if i % 9 == 0 else z, f"text{i}", "yes" if x + (c == "a") * 0.5 > 0.7 else "no", 3 * x + (c == "b")))
    return spark.createDataFrame(rows, "id int, x double, c string, z double, note string, target string, amount double")


@pytest.fixture(scope="module")
def trained(toy):
    return automl.auto_train(toy.drop("amount"), "target", key=["id"], features=["x", "c", "z"])


def test_split_is_stable(spark, sf001):
    lines = spark.read.parquet(f"{sf001}/lineitem.parquet")
    key = ["l_orderkey", "l_linenumber"]
    train, test = split.train_test_split(lines, key=key)
    assert train.count() + test.count() == lines.count()
    assert 0.15 < test.count() / lines.count() < 0.25
    _, again = split.train_test_split(lines.repartition(7), key=key)
    assert test.exceptAll(again).count() == 0 and again.exceptAll(test).count() == 0
    assert split.train_test_split(lines, seed=1, key=key)[1].exceptAll(test).count() > 0
    with pytest.raises(ValueError):
        split.train_test_split(lines, 1.0)


def test_split_without_key(spark):
    df = spark.createDataFrame([(i % 10, [i % 10], {"k": None}) for i in range(100)], "a int, b array<int>, c map<string,int>")
    train, test = split.train_test_split(df, 0.5)
    assert train.select("a").distinct().intersect(test.select("a").distinct()).count() == 0


def test_exact_split(spark, sf001):
    lines = spark.read.parquet(f"{sf001}/lineitem.parquet")
    key = ["l_orderkey", "l_linenumber"]
    for size in (0.2, 0.333, 0.999):
        train, test = split.exact_split(lines, size, key=key)
        assert test.count() == math.ceil(size * lines.count()) and train.count() + test.count() == lines.count()
        assert train.columns == test.columns == lines.columns
    train, test = split.exact_split(lines, key=key)
    again = split.exact_split(lines.repartition(7), key=key)[1]
    assert test.exceptAll(again).count() == 0 and train.unionByName(test).exceptAll(lines).count() == 0
    wide = split.train_test_split(lines, 0.25, key=key)[1]  # both order rows by the same hash
    assert test.exceptAll(wide).count() == 0
    with pytest.raises(ValueError):
        split.exact_split(lines, 0)


@pytest.mark.parametrize("rows", [0, 1, 7, 1000])
def test_exact_split_of_equal_rows(spark, rows):
    """A third are one row, a third share a key, null keys too: the count is exact on any deal, `place_0` is a user's column."""
    df = spark.range(rows, numPartitions=3).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 2, F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 1, F.col("id")).alias("place_0"),
    )
    for key in (["k"], None):
        train, test = split.exact_split(df, key=key)
        assert test.count() == math.ceil(0.2 * rows) and train.count() == rows - math.ceil(0.2 * rows)
        assert train.unionAll(test).exceptAll(df).count() == 0 and train.columns == df.columns


def test_training_side_is_exact(spark, monkeypatch):
    """Rows without a target count for neither side."""
    seen = []
    monkeypatch.setattr(automl, "exact_split", lambda df, *rest: seen.append(split.exact_split(df, *rest)) or seen[0])
    monkeypatch.setattr(automl, "list_for_task", lambda task: [])
    df = spark.range(101).select("id", (F.col("id") % 2).alias("x"), F.when(F.col("id") < 93, F.col("id") % 2).alias("target"))
    automl.auto_train(df, "target", key=["id"])
    assert [side.count() for side in seen[0]] == [74, 19]


def predictions(spark, pairs, kind="string"):
    return spark.createDataFrame(pairs, f"label {kind}, prediction {kind}")


def test_classification_metrics(spark):
    # class a: 2·2/(3+2), class b: 2·1/(2+2), class x only predicted: 0
    found = metrics.classification_metrics(
        predictions(spark, [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("b", "x")])
    ).first()
    assert found["accuracy"] == pytest.approx(0.6)
    assert found["f1_macro"] == pytest.approx((0.8 + 0.5 + 0) / 3)


def test_regression_metrics(spark):
    found = metrics.regression_metrics(predictions(spark, [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "double")).first()
    assert found["r2"] == pytest.approx(0.5) and found["mae"] == pytest.approx(1 / 3)
    constant = [(2.0, 2.0), (2.0, 2.0)]
    assert metrics.regression_metrics(predictions(spark, constant, "double")).first()["r2"] == 1.0
    assert metrics.regression_metrics(predictions(spark, [(2.0, 2.0), (2.0, 3.0)], "double")).first()["r2"] == 0.0


def test_features(toy):
    assert features.split_xy(toy, "target", ["x"]) == (["x"], "target")
    with pytest.raises(ValueError):
        features.split_xy(toy, "target", ["target"])
    prepared = features.fit_features(toy, "target", "classification", ["x", "c", "z", "note"])
    assert prepared.numeric == ["x", "z"] and prepared.categorical == ["c"] and prepared.hashed == ["note"]
    assert prepared.classes == ["no", "yes"]
    assert prepared.slots == ["x", "z", "c", "c", "c", "c"] + ["note"] * features.HASH_SLOTS
    ready = features.features_target(toy, prepared)
    assert ready.columns == ["features", "label"] and ready.first()["features"].size == 6 + features.HASH_SLOTS
    empty = toy.withColumn("gone", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="no usable feature"):
        features.fit_features(empty, "target", "classification", ["gone"])


def test_feature_of_many_values(spark):
    rows = [(i, f"city{i % 60}", "yes" if i % 60 < 30 else "no") for i in range(1800)]
    df = spark.createDataFrame(rows, "id int, city string, y string")
    found = automl.auto_train(df, "y", key=["id"], features=["city"], hyperparams={"gbt_classifier": {"maxIter": 5}})
    assert found.best.metrics["accuracy"] > 0.8 and found.best.metrics["accuracy"] <= 1
    assert all(r.hyperparams for r in found.results)
    settings = {r.name: r.hyperparams for r in found.results}
    assert settings["gbt_classifier"]["maxIter"] == 5 and settings["random_forest_classifier"]["numTrees"] == 20


def test_target_of_many_classes(spark):
    rows = [(i, float(i % 150), f"k{i % 150:03}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, x double, y string")
    prepared = features.fit_features(df, "y", "classification", ["x"])
    assert len(prepared.classes) == 150
    ready = features.features_target(df, prepared)
    model = estimators.random_forest_classifier(150, maxDepth=10, numTrees=3, maxBins=256).fit(ready)
    assert model.numClasses == 150
    assert metrics.classification_metrics(model.transform(ready).select("label", "prediction")).first()["accuracy"] > 0.5


def test_target_with_too_many_classes(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_CLASSES", 30)
    df = spark.range(31).selectExpr("id AS y", "id AS x")
    with pytest.raises(ValueError, match="too many"):
        features.fit_features(df, "y", "classification", ["x"])
    assert len(features.fit_features(df.where("y < 30"), "y", "classification", ["x"]).classes) == 30


def test_missing_vector_is_an_error(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), 1.0), (None, 2.0)], ["v", "y"])
    with pytest.raises(ValueError, match="1 rows have no vector in v"):
        features.fit_features(df, "y", "regression", ["v"])


def test_leaderboard(trained):
    board = trained.leaderboard.collect()
    assert {r["name"] for r in board} == {"gbt_classifier", "random_forest_classifier", "logistic_regression"}
    accuracy = [r["metrics"]["accuracy"] for r in board]
    assert accuracy == sorted(accuracy, reverse=True) and accuracy[0] > 0.85
    assert sum(r["train_time_sec"] for r in board) < 60
    for r in board:
        if r["name"] == "logistic_regression":
            assert r["feature_importance"] is None
        else:
            assert sum(r["feature_importance"].values()) == pytest.approx(1)
            assert max(r["feature_importance"], key=r["feature_importance"].get) == "x"
    assert trained.best.name == board[0]["name"]


def test_saved_model_predicts_the_same(spark, toy, trained, tmp_path):
    for result in trained.results:
        path = automl.save_model(result.model, str(tmp_path / result.name))
        unseen = toy.drop("target", "amount").where("id % 3 = 0")
        before = automl.score(result.model, unseen).orderBy("id").collect()
        after = automl.score(automl.load_model(path), unseen).orderBy("id").collect()
        assert before == after and {r["predicted"] for r in before} <= {"yes", "no"}
        assert before[0].asDict().keys() == {"id", "x", "c", "z", "note", "prediction", "predicted"}


def test_experiments(spark, trained, tmp_path):
    store = Catalog(spark, str(tmp_path))
    store.append("datasets", spark.createDataFrame([("d", "toy")], "id string, original_name string"))
    best = store.save_best("d", trained.best)
    store.write_experiments("d", trained, artifacts={trained.best.name: best})
    ranked = store.leaderboard_for("d").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3] and ranked[0]["model_type"] == trained.best.name
    assert ranked[0]["artifact_path"] == best and ranked[0]["original_name"] == "toy"
    assert store.leaderboard_for("other").count() == 0


def test_regression_and_failing_estimator(toy, caplog):
    @estimators.register_estimator("broken", "regression")
    def broken(classes, **_):
        raise RuntimeError("no luck")

    @estimators.register_estimator("linear", "regression")
    def linear(classes, **hyperparams):
        from pyspark.ml.regression import LinearRegression

        return LinearRegression(**hyperparams)

    try:
        with caplog.at_level(logging.WARNING):
            found = automl.auto_train(
                toy.drop("target"), "amount", "regression", key=["id"], features=["x", "c"],
                hyperparams={"gbt_regressor": {"maxIter": 3}, "random_forest_regressor": {"numTrees": 3}},
            )
    finally:
        del estimators.ESTIMATORS["broken"], estimators.ESTIMATORS["linear"]
    board = found.leaderboard.collect()
    assert [r["name"] for r in board][0] == "linear" and len(board) == 3
    assert board[0]["metrics"]["r2"] > 0.99 and "broken failed" in caplog.text
    with pytest.raises(ValueError):
        estimators.list_for_task("ranking")


def test_many_classes_and_unseen_class(spark):
    rows = [(i, float(i % 3), f"k{i % 3}") for i in range(120)]
    df = spark.createDataFrame(rows, "id int, x double, y string")
    _, test = split.train_test_split(df, key=["id"])
    one = test.first()["id"]
    df = df.withColumn("y", F.when(F.col("id") == one, "unseen").otherwise(F.col("y")))
    found = automl.auto_train(df, "y", key=["id"], features=["x"], hyperparams={"gbt_classifier": {"maxIter": 2}})
    board = {r["name"]: r for r in found.leaderboard.collect()}
    assert board.keys() == {"gbt_classifier", "random_forest_classifier", "logistic_regression"}
    assert 0.5 < board["gbt_classifier"]["metrics"]["accuracy"] < 1
    assert board["gbt_classifier"]["feature_importance"].keys() == {"x"}


def test_sort_puts_missing_metric_last(spark):
    rows = [("a", {"f1_macro": 1.0}, 0.1, None, 0), ("b", {"accuracy": 0.5}, 0.1, None, 1), ("c", {"accuracy": 0.5}, 0.1, None, 2)]
    board = spark.createDataFrame(rows, automl.LEADERBOARD_SCHEMA)
    assert [r["name"] for r in automl.sort_leaderboard(board, "classification").collect()] == ["b", "c", "a"]
    assert automl.best_model(board, "classification").first()["name"] == "b"


def test_tasks_of_training_are_bounded(spark, monkeypatch):
    """More rows are more tasks, not larger ones, whatever the number of cores."""
    monkeypatch.setattr(automl, "MOST_ROWS", 50)
    monkeypatch.setattr(automl, "ROWS_PER_TASK", 10)
    df = spark.range(3000, numPartitions=2).persist()
    spread, rows = automl._spread(df, 1)
    sizes = spread.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert rows == sum(sizes) == 3000 and max(sizes) <= 60
    spread.unpersist()


def test_rows_alike_are_trained_on_once(spark, monkeypatch):
    """Models and measures are those of all rows, also with gaps; the forest still draws from the rows."""
    rows = spark.range(4000).select(
        "id", (F.col("id") % 5).alias("x"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("z"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("c"),
    ).withColumn("y", F.when(F.col("x") * 2 + F.coalesce("z", F.lit(0)) + F.col("id") % 2 > 7, "a").otherwise("b"))
    rows = rows.withColumn("t", F.col("x") * 3.0 + F.coalesce("z", F.lit(9)) + F.col("id") % 2)
    seen = []
    monkeypatch.setattr(automl, "weighted", lambda e, w, of=automl.weighted: seen.append((type(e).__name__, of(e, w) is not None)) or of(e, w))
    for task, target in (("classification", "y"), ("regression", "t")):
        found = {}
        for most in (100_000, 0):
            monkeypatch.setattr(automl, "MOST_KINDS", most)
            found[most] = automl.auto_train(rows, target, task, key=["id"], features=["x", "z", "c"]).results
        assert [r.name for r in found[0]] == [r.name for r in found[100_000]] and found[0]
        for by_kind, by_row in zip(found[100_000], found[0], strict=True):
            assert by_kind.hyperparams == by_row.hyperparams
            assert by_kind.metrics == pytest.approx(by_row.metrics, rel=1e-6, abs=1e-9), by_kind.name
    assert dict(seen) == {
        "GBTClassifier": True, "RandomForestClassifier": False, "LogisticRegression": True, "GBTRegressor": True, "RandomForestRegressor": False,
    }
