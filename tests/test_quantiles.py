import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import quantiles as Q

PROBABILITIES = [0, 0.1, 0.25, 0.333, 0.5, 0.75, 0.99, 1]


def draws(kind, n=3000):
    rng = random.Random(7)
    return {
        "even": lambda: [float(i) for i in range(n)],
        "heavy_tail": lambda: [rng.gauss(0, 1) ** 9 for _ in range(n)],
        "two_values": lambda: [rng.choice([1.0, 2.0]) for _ in range(n)],
        "constant": lambda: [4.0] * n,
        "hot_value": lambda: [3.5 if i % 3 == 0 else rng.random() * 7 for i in range(n)],
        "extremes": lambda: [rng.choice([1e308, -1e308, 5e-324, 0.0, 1.0, rng.random()]) for _ in range(n)],
    }[kind]()


@pytest.mark.parametrize("kind", ["even", "heavy_tail", "two_values", "constant", "hot_value", "extremes"])
@pytest.mark.parametrize("tiny", [False, True])
def test_equals_sorting(spark, monkeypatch, kind, tiny):
    if tiny:  # many passes with a coarse sketch
        monkeypatch.setattr(Q, "SKETCH", 16)
        monkeypatch.setattr(Q, "FINISH_ROWS", 8)
    values = draws(kind)
    df = spark.createDataFrame([(v,) for v in values], "a double")
    found = Q.quantiles(df, probabilities=PROBABILITIES)["a"]
    ordered = sorted(values)
    for p, got in zip(PROBABILITIES, found):
        low, high, part = Q._interpolate(len(ordered), p)
        expected = ordered[low] if ordered[low] == ordered[high] else (1 - part) * ordered[low] + part * ordered[high]
        assert got == pytest.approx(expected, rel=1e-12)


def test_matches_percentile_on_integers_and_nulls(spark):
    df = spark.range(1001).select(F.when(F.col("id") % 5 != 0, F.col("id") * 3).alias("a"))
    expected = df.agg(F.percentile("a", [0.25, 0.5, 0.75])).first()[0]
    assert Q.quantiles(df)["a"] == expected


def test_missing_and_infinite(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in [-inf, -inf, 1.0, 2.0, inf, float("nan"), None]], "a double")
    assert Q.quantiles(df, probabilities=[0, 0.25, 0.5, 0.75, 1])["a"] == [-inf, -inf, 1.0, 2.0, inf]
    assert Q.quantiles(spark.createDataFrame([(None,)], "a double"))["a"] == [None, None, None]
    assert Q.quantiles(spark.createDataFrame([("x",)], "a string")) == {}


def test_quartiles_and_median(people):
    assert Q.medians(people, ["age"]) == {"age": 30.0}
    assert Q.quartiles(people).first().asDict() == {"column_name": "age", "q1": 27.5, "q3": 35.0}


def test_approximate(spark):
    found = Q.quantiles(spark.range(1000), ["id"], [0.5], approximate=True)["id"][0]
    assert found == pytest.approx(500, abs=2)


def test_many_columns(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 40))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], [f"c{i}" for i in range(40)])
    found = Q.medians(df, df.columns)
    assert [found[f"c{i}"] for i in range(40)] == pytest.approx(np.median(data, axis=0).tolist())


SPREADS = {
    "uniform": "rand(1)",
    "log_normal": "exp(5 * randn(2))",
    "decades": "pow(10D, 600 * rand(3) - 300)",
    "one_value": "if(rand(4) < 0.99, 7D, rand(5))",
}


def test_passes_do_not_depend_on_the_spread(spark, monkeypatch):
    """Two scans after the first aggregate: counts at the edges, and the values between them."""
    passes = []
    for name, cost in (("_count_edges", 1), ("_fetch", 1)):
        real = getattr(Q, name)
        monkeypatch.setattr(Q, name, lambda *a, real=real, cost=cost: (passes.append(cost), real(*a))[1])
    df = spark.range(300_000).selectExpr(*[f"{e} AS {n}" for n, e in SPREADS.items()]).cache()
    local = df.toPandas()
    for name in SPREADS:
        passes.clear()
        found = Q.quantiles(df, [name], [0.25, 0.5, 0.9])[name]
        assert found == pytest.approx(list(local[name].quantile([0.25, 0.5, 0.9])), rel=1e-12)
        assert sum(passes) <= 2
    passes.clear()
    together = Q.quantiles(df, list(SPREADS), [0.25, 0.5, 0.9])
    assert sum(passes) <= 2
    assert together["decades"] == pytest.approx(list(local["decades"].quantile([0.25, 0.5, 0.9])), rel=1e-12)
    df.unpersist()


def test_one_pass_more_for_few_rows_to_fetch(spark, monkeypatch):
    """Ranges too large to fetch are narrowed again, from the sketches that came with the counts."""
    monkeypatch.setattr(Q, "FINISH_ROWS", 100)
    passes = []
    for name in ("_count_edges", "_fetch"):
        real = getattr(Q, name)
        monkeypatch.setattr(Q, name, lambda *a, real=real, name=name: (passes.append(name), real(*a))[1])
    df = spark.range(100_000).selectExpr("pow(10D, 600 * rand(3) - 300) AS v").cache()
    local = df.toPandas()["v"]
    assert Q.quantiles(df, ["v"], [0.1, 0.5])["v"] == pytest.approx(list(local.quantile([0.1, 0.5])), rel=1e-12)
    assert 2 <= passes.count("_count_edges") <= 4 and passes.count("_fetch") == 1
    df.unpersist()
