import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import profile as P

NAN, INF = float("nan"), float("inf")


def by_name(df):
    return {c["name"]: c for c in P.profile_dict(df)["columns"]}


def test_people(people):
    found = P.profile_dict(people)
    assert found["row_count"] == 4 and found["column_count"] == 3
    assert [c["name"] for c in found["columns"]] == ["name", "age", "city"]
    age = found["columns"][1]
    assert (age["dtype"], age["null_count"], age["unique_count"]) == ("Int64", 1, 4)
    stats = {k: round(v, 4) for k, v in age["stats"].items()}
    assert stats == {"min": 25.0, "max": 40.0, "mean": 31.6667, "std": 7.6376}
    assert "stats" not in found["columns"][0] and found["columns"][2]["unique_count"] == 2


def test_empty_frame(spark):
    found = P.profile_dict(spark.createDataFrame([], "a int, b string"))
    assert found["row_count"] == 0
    assert [(c["null_count"], c["unique_count"]) for c in found["columns"]] == [(0, 0), (0, 0)]
    assert all("stats" not in c for c in found["columns"])
    assert P.profile_dict(spark.range(3).select()) == {"row_count": 3, "column_count": 0, "columns": []}


def test_one_row_has_zero_deviation(spark):
    assert by_name(spark.createDataFrame([(5,)], "a int"))["a"]["stats"] == {"min": 5, "max": 5, "mean": 5, "std": 0}


def test_all_null_columns(spark):
    found = by_name(spark.createDataFrame([(None, None), (None, None)], "a double, b string"))
    assert found["a"]["null_count"] == 2 and found["a"]["unique_count"] == 1 and "stats" not in found["a"]
    assert found["b"]["unique_count"] == 1


def test_nan_is_a_value_but_no_number(spark):
    found = by_name(spark.createDataFrame([(NAN,), (1.0,), (3.0,), (0.0,), (-0.0,), (None,)], "a double"))["a"]
    assert found["null_count"] == 1 and found["unique_count"] == 5  # NaN, 1, 3, 0, null
    assert found["stats"]["max"] == 3.0 and found["stats"]["mean"] == 1.0


def test_booleans_and_dates_have_no_stats(spark):
    df = spark.createDataFrame([(True, dt.date(2024, 1, 1)), (None, None)], "a boolean, b date")
    found = by_name(df)
    assert found["a"]["dtype"] == "Boolean" and "stats" not in found["a"] and found["a"]["unique_count"] == 2
    assert found["b"]["dtype"] == "Date" and "stats" not in found["b"]


def test_nested_decimal_and_odd_names(spark):
    df = spark.sql(
        "SELECT array(1, 2) AS `a.b`, map('k', 1) AS m, CAST(1.50 AS DECIMAL(5,2)) AS `we``ird`, 'x' AS position, 1 AS value"
        " UNION ALL SELECT array(1, 2), map('k', 2), 2.25, 'y', 2"
    )
    found = by_name(df)
    assert found["a.b"]["unique_count"] == 1 and found["m"]["unique_count"] == 2
    assert found["we`ird"]["stats"]["max"] == 2.25
    assert found["position"]["unique_count"] == 2 and found["value"]["unique_count"] == 2


def test_long_texts_are_told_apart(spark):
    base = "x" * 5000
    df = spark.createDataFrame([(base,), (base + "a",), (base + "b",), (base,), ("short",)], "t string")
    assert by_name(df)["t"]["unique_count"] == 4


def test_profile_by_group_matches_single_profiles(spark, people):
    grouped = P.profile(people, by=["city"]).where("city = 'Hanoi'").drop("city").orderBy("position").collect()
    single = P.profile(people.where("city = 'Hanoi'").drop("city")).orderBy("position").collect()
    assert grouped == single


@pytest.mark.parametrize("parts", [1, 7])
def test_independent_of_partitions(spark, sf001, parts):
    lines = spark.read.parquet(f"{sf001}/lineitem.parquet")

    def counts(df):
        return sorted(P.profile(df).select("column_name", "null_count", "unique_count", "stats.min", "stats.max").collect())

    assert counts(lines) == counts(lines.repartition(parts))


def test_sample_values(spark):
    df = spark.createDataFrame([(v,) for v in "ccbbaad"] + [(None,)] * 9, "v string")
    rows = P.sample_values(df, n=3).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in rows] == [("a", 2), ("b", 2), ("c", 2)]


def test_value_counts_keep_null(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "v string")
    assert {(r["v"], r["count"]) for r in P.value_counts(df, "v").collect()} == {("a", 1), (None, 2)}


def test_categorical_gate(spark):
    rows = [(str(i), str(i % 50), str(i % 51), i) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, fifty string, fifty_one string, n int")
    assert P.categorical_columns(df, 50) == ["fifty"]
    assert P.numeric_columns(df) == ["n"]


def test_distinct_whole_numbers_and_dates(spark):
    """Neighbours share words of 64 bits: signs, ends of the range, edges of words, nulls, groups."""
    numbers = [-1, 0, 1, 63, 64, 65, -63, -64, -65, 2**63 - 1, -(2**63), None, None, 0, 2**62]
    days = [dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(1, 1, 1), dt.date(9999, 12, 31), None, dt.date(2024, 2, 29)]
    rows = [(i % 2, n, days[i % len(days)], None if n is None else n % 100) for i, n in enumerate(numbers * 3)]
    df = spark.createDataFrame(rows, "g int, n long, d date, b tinyint").repartition(4)
    found = {r["position"]: r["unique_count"] for r in P.unique_counts(df).collect()}
    assert found == {i: len({r[i] for r in rows}) for i in range(4)}
    grouped = {(r["g"], r["position"]): r["unique_count"] for r in P.unique_counts(df, ["n", "d"], by=["g"]).collect()}
    assert grouped == {(g, i - 1): len({r[i] for r in rows if r[0] == g}) for g in (0, 1) for i in (1, 2)}


def test_many_correlations_are_products(spark, monkeypatch):
    """Twenty-six columns with gaps, far means, huge scales, constants, and columns constant only where their partner is present."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(400, 26))
    data[:, 1] += data[:, 0] * 3
    data[:, 2] += 1e9
    data[:, 3] *= 1e150
    data[:, 4] = 7.0
    data[rng.random(data.shape) < 0.1] = NAN
    data[:, 5] = np.where(np.arange(400) < 200, 2.5, data[:, 5])
    data[200:, 6] = NAN  # 5 is constant where 6 is present
    data[:200, 7] = NAN  # 6 and 7 never meet
    data[3, 8] = INF
    rows = [tuple(None if math.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(r)) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, ", ".join(f"`c.{i}` double" for i in range(26))).repartition(5)
    products = {(r["x"], r["y"]): r["correlation"] for r in P.correlation_matrix(df).collect()}
    monkeypatch.setattr(P, "PAIRS_PER_PASS", 1000)
    plain = {(r["x"], r["y"]): r["correlation"] for r in P.correlation_matrix(df).collect()}
    assert products.keys() == plain.keys() and len(plain) == 676
    for pair, value in plain.items():
        assert (products[pair] is None) == (value is None), pair
        assert value is None or math.isclose(products[pair], value, abs_tol=1e-7 if "c.2" in pair else 1e-10), pair
    assert plain["c.5", "c.6"] is None and plain["c.6", "c.7"] is None and plain["c.0", "c.4"] is None
    monkeypatch.setattr(P, "PAIRS_PER_PASS", 300)
    assert all(r["correlation"] is None for r in P.correlation_matrix(df.limit(0)).collect() if r["x"] != r["y"])


def test_correlation(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 3))
    rows = [(*map(float, r), 1.0) for r in data] + [(None, 1.0, 2.0, 1.0), (NAN, 5.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    found = {(r["x"], r["y"]): r["correlation"] for r in P.correlation_matrix(df).collect()}
    assert len(found) == 16 and found["a", "a"] == 1.0
    assert math.isclose(found["a", "b"], np.corrcoef(data[:, 0], data[:, 1])[0, 1], abs_tol=1e-12)
    assert found["a", "b"] == found["b", "a"] and found["a", "k"] is None


def test_outlier_report(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(1000.0,), (None,), (NAN,)], "a double")
    row = P.outlier_report(df).first()
    assert (row["q1"], row["q3"], row["outliers"]) == (2.5, 7.5, 1)
    assert P.outlier_report(spark.createDataFrame([(None,)], "a double")).count() == 0


def test_approximate_counts(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 10).alias("few"))
    found = {r["column_name"]: r for r in P.profile(df, approximate=True).collect()}
    assert found["few"]["unique_count"] == 10 and found["few"]["null_count"] == 500
    assert found["id"]["unique_count"] == pytest.approx(5000, rel=0.2)


def test_groups_named_like_our_own(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 2, 2.0)], "value string, n int, count double")
    found = {(r["value"], r["column_name"]): r["unique_count"] for r in P.profile(df, by=["value"]).collect()}
    assert found == {("a", "n"): 1, ("a", "count"): 2, ("b", "n"): 1, ("b", "count"): 1}
    assert P.sample_values(df.select("value", "n"), n=1).count() == 2
