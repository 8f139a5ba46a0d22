import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import charts as C
from larkspur.plans.tools import plot_chart

NAN, INF = float("nan"), float("inf")


def points(chart):
    return chart.spec()["series"][0]["data"]


@pytest.mark.parametrize("bins", [1, 7, 20, 30])
def test_histogram_equals_numpy(spark, sf001, bins):
    lines = spark.read.parquet(f"{sf001}/lineitem.parquet")
    for column in ("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber"):
        counts, edges = np.histogram(lines.select(column).toPandas()[column].to_numpy(), bins=bins)
        found = points(C.histogram(lines, column, bins))
        assert [p["count"] for p in found] == counts.tolist(), column
        assert [p["bin"] for p in found] == edges[:-1].tolist(), column


def test_histogram_on_edges_gaps_and_constants(spark):
    values = [0.0, 0.1, 0.2, 0.30000000000000004, 0.3, 1.0, 1.0]
    found = points(C.histogram(spark.createDataFrame([(v,) for v in values], "a double"), "a", 10))
    assert [p["count"] for p in found] == np.histogram(values, bins=10)[0].tolist()
    found = points(C.histogram(spark.createDataFrame([(4,), (4,)], "a int"), "a", 5))
    assert [p["count"] for p in found] == np.histogram([4, 4], bins=5)[0].tolist() and found[0]["bin"] == 3.5
    big = points(C.histogram(spark.createDataFrame([(1e18,)] * 3, "a double"), "a", 5))
    assert sum(p["count"] for p in big) == 3


def test_histogram_without_finite_values(spark):
    chart = C.histogram(spark.createDataFrame([(None,), (NAN,), (INF,)], "a double"), "a")
    assert points(chart) == [] and chart.metadata == {"not_finite": 2}
    with pytest.raises(ValueError, match="not numeric"):
        C.histogram(spark.createDataFrame([("x",)], "a string"), "a")
    with pytest.raises(ValueError, match="no such column"):
        C.histogram(spark.range(1), "b")


def test_histogram_spec(people):
    spec = C.histogram(people, "age", 3).spec()
    assert spec["type"] == "histogram" and spec["title"] == "Distribution of age"
    assert spec["x_axis"] == {"key": "bin", "label": "age", "type": "numeric"}
    assert spec["y_axis"] == {"key": "count", "label": "Frequency", "type": "numeric"}
    json.dumps(spec)


def test_bar_ties_and_null(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "c", None, None, "d"]], "v string")
    chart = C.bar(df, "v", 4)
    assert chart.title == "Top 4 categories of v"
    assert [(p["v"], p["count"]) for p in points(chart)] == [("c", 2), (None, 2), ("a", 1), ("b", 1)]


def test_pie(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbcd"], "v string")
    found = points(C.pie(df, "v", 2))
    assert [(p["category"], p["count"]) for p in found] == [("a", 3), ("b", 2), ("Other", 2)]
    assert sum(p["share"] for p in found) == pytest.approx(1)


def test_scatter_is_repeatable_and_finite(spark, sf001):
    lines = spark.read.parquet(f"{sf001}/lineitem.parquet")
    key = ["l_orderkey", "l_linenumber"]
    first = C.scatter(lines, "l_quantity", "l_tax", 50, key).data.collect()
    assert first == C.scatter(lines.repartition(7), "l_quantity", "l_tax", 50, key).data.collect() and len(first) == 50
    odd = spark.createDataFrame([(1.0, NAN), (INF, 2.0), (3.0, 4.0), (None, 1.0)], "x double, y double")
    assert points(C.scatter(odd, "x", "y")) == [{"x": 3.0, "y": 4.0}]


def test_line_is_thinned(spark):
    """At most max_points, with first, last and the extremes of every span; gaps stay gaps, short lines stay whole."""
    rows = [(i, None if i % 7 == 0 else float((i * 7919) % 1009)) for i in range(5000)]
    df = spark.createDataFrame(rows, "i long, v double").selectExpr("timestamp_micros(i * 3000000 + 11) AS t", "v")
    full = C.line(df, "t", "v", "microsecond", "max", max_points=5000).data.collect()
    thin = C.line(df, "t", "v", "microsecond", "max", max_points=80).data.collect()
    assert len(full) == 5000 and len(thin) <= 80 and set(thin) <= set(full)
    assert thin[0] == full[0] and thin[-1] == full[-1] and [r["t"] for r in thin] == sorted(r["t"] for r in thin)
    width = (4999 * 3000000) // 20 + 1
    for span in range(20):
        inside = [(i, v) for i, v in rows if i * 3000000 // width == span]
        values = [v for _, v in inside if v is not None]
        kept = [r["v"] for r in thin if (int(r["t"].timestamp() * 10**6 + 0.5) - 11) // width == span]
        assert min(values) in kept and max(values) in kept and kept[0] == inside[0][1] and kept[-1] == inside[-1][1]
    none = df.selectExpr("t", "CAST(NULL AS double) AS v")
    assert len(C.line(none, "t", "v", "microsecond", "max", max_points=8).data.collect()) == 4
    assert C.line(df.limit(0), "t", "v", "microsecond", max_points=8).data.collect() == []
    with pytest.raises(ValueError):
        C.line(df, "t", "v", max_points=3)


def test_line(spark):
    df = spark.createDataFrame(
        [("2024-01-02 05:00:00", 1.0), ("2024-01-01 01:00:00", 2.0), ("2024-01-01 09:00:00", 4.0)], "t string, v double"
    ).withColumn("t", F.col("t").cast("timestamp"))
    assert [r["v"] for r in C.line(df, "t", "v").data.collect()] == [3.0, 1.0]
    assert [r["count"] for r in C.line(df, "t").data.collect()] == [2, 1]
    assert [r["v"] for r in C.line(df, "t", "v", "month", "sum").data.collect()] == [7.0]


def test_heatmap_has_no_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (3.0, 6.0, 1.0)], "a double, b double, k double")
    found = {(p["x"], p["y"]): p["value"] for p in points(C.heatmap(df))}
    assert found["a", "b"] == pytest.approx(1) and found["a", "k"] is None and found["k", "k"] == 1


def test_auto_charts(spark):
    rows = [(i, i / 7, f"id{i}", f"c{i % 50}", f"d{i % 51}", i % 2 == 0, NAN if i == 0 else 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "n int, x double, id string, fifty string, fifty_one string, flag boolean, odd double")
    specs = [c.spec() for c in C.auto_charts(df, bins=10)]
    assert [(s["type"], s["series"][0]["name"]) for s in specs] == [
        ("histogram", "n"), ("histogram", "x"), ("bar", "fifty"), ("bar", "flag"), ("histogram", "odd"),
    ]
    for spec in specs:
        for p in spec["series"][0]["data"]:
            assert all(not isinstance(v, float) or math.isfinite(v) for v in p.values())
    single = {c.name: points(c) for c in (C.histogram(df, "n", 10), C.bar(df, "fifty"))}
    assert specs[0]["series"][0]["data"] == single["n"] and specs[2]["series"][0]["data"] == single["fifty"]
    assert C.chart_frame(spark, specs).count() == 5
    assert C.auto_charts(spark.createDataFrame([], "a string").select()) == []


def test_validate():
    good = {
        "type": "bar", "title": "t", "x_axis": {"key": "a", "label": "a"}, "y_axis": {"key": "b", "label": "b", "type": "numeric"},
        "series": [{"name": "s", "data": [{"a": "x", "b": 1}]}], "metadata": {},
    }
    assert C.validate_chart(good) is good
    for change in (
        {"type": "radar"}, {"x_axis": {"label": "a"}}, {"y_axis": {"key": "b", "label": "b", "type": "odd"}}, {"title": None},
        {"series": [{"name": "s", "data": [{"b": NAN}]}]},
    ):
        with pytest.raises(ValueError):
            C.validate_chart({**good, **change})


def test_drilldown(people):
    assert C.drilldown(people, "age").type == "histogram"
    assert C.drilldown(people, "city").type == "bar"
    assert points(C.drilldown(people, "city", "Hanoi", of="name")) == [{"name": "Alice", "count": 1}, {"name": "Carol", "count": 1}]
    assert points(C.drilldown(people, "age", None, of="name")) == [{"name": "Carol", "count": 1}]


def test_register_chart(people):
    @C.register_chart("counter")
    def counter(df, column):
        data = df.agg(F.count(column).alias("n")).withColumn("what", F.lit(column))
        return C.Chart("counter", "Count", C.Axis("what", "what"), C.Axis("n", "n", "numeric"), column, data)

    assert points(plot_chart(people, "counter", column="age")) == [{"n": 3, "what": "age"}]
    assert plot_chart(people, "bar", column="city").type == "bar"
    with pytest.raises(ValueError, match="unknown chart type"):
        plot_chart(people, "radar")


def test_importance_chart(spark):
    assert [p["feature"] for p in points(C.importance_chart(spark, "m", {"a": 0.2, "b": 0.8}))] == ["b", "a"]
    assert points(C.importance_chart(spark, "m", None)) == []


def test_columns_named_like_our_own(spark):
    rows = [("a", 1, "x", "p"), ("a", 2, "x", "q"), ("b", 3, "y", "q")]
    df = spark.createDataFrame(rows, "count string, position int, value string, category string")
    assert points(C.bar(df, "count")) == [{"count": "a", "rows": 2}, {"count": "b", "rows": 1}]
    assert [p["count"] for p in points(C.pie(df, "count"))] == [2, 1]
    assert [c.type for c in C.auto_charts(df, bins=2)] == ["bar", "histogram", "bar", "bar"]
    for chart in C.auto_charts(df, bins=2):
        chart.spec()
