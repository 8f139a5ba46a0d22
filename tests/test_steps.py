import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import columns as C
from larkspur.operators import steps as S
from larkspur.plans.cleaning import Cleaning, StepCall, log_frame, step_from_spec

NAN = float("nan")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_mean_fill(people):
    df, log = S.handle_missing(people)
    assert dict(df.dtypes)["age"] == "double" and df.columns == people.columns
    assert log["affected"][0]["column"] == "age" and log["affected"][0]["fill"] == pytest.approx(31.6667, abs=1e-4)
    assert df.where("name = 'Carol'").first()["age"] == pytest.approx(31.6667, abs=1e-4)
    assert len(log["affected"]) == 1  # columns without nulls are not logged


def test_median_and_unknown(spark):
    df = spark.createDataFrame([(1, "a", True), (None, None, None), (5, "b", False), (9, "c", True)], "n int, s string, b boolean")
    clean, log = S.handle_missing(df, "median")
    assert rows(clean)[1] == (5.0, "Unknown", "Unknown")
    assert log == {"strategy": "median", "affected": [
        {"column": "n", "fill": 5.0}, {"column": "s", "fill": "Unknown"}, {"column": "b", "fill": "Unknown"}]}


def test_all_null_number_stays(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "n double, k int")
    for strategy in ("mean", "median"):
        clean, log = S.handle_missing(df, strategy)
        assert rows(clean) == [(None, 1), (None, 2)] and log["affected"] == [{"column": "n", "fill": None}]


def test_drop_and_fill(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (None, None)], "n int, s string")
    clean, log = S.handle_missing(df, "drop")
    assert rows(clean) == [(1, "a")] and log["removed_rows"] == 3
    clean, log = S.handle_missing(df, "fill", value=0)
    assert rows(clean) == [(1, "a"), (0, "b"), (3, None), (0, None)] and dict(clean.dtypes)["n"] == "bigint"
    clean, _ = S.handle_missing(df, "fill", value=0.5)
    assert rows(clean)[1] == (0.5, "b")
    clean, log = S.handle_missing(df, "fill", value={"n": 7, "s": "?"})
    assert rows(clean)[3] == (7, "?") and [a["fill"] for a in log["affected"]] == [7, "?"]


def test_untouched_without_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    clean, log = S.handle_missing(df)
    assert clean.dtypes == df.dtypes and log["affected"] == []
    clean, log = S.handle_missing(df.limit(0), "median")
    assert clean.count() == 0 and log["affected"] == []


def test_bad_strategies(people):
    for bad in ({"strategy": "mode"}, {"strategy": "fill"}):
        with pytest.raises(ValueError):
            S.handle_missing(people, **bad)
    with pytest.raises(ValueError):
        S.remove_outliers(people, method="zscore")
    with pytest.raises(ValueError):
        S.encode_categorical(people, method="hash")


def test_remove_outliers_keeps_missing(spark):
    values = [float(i) for i in range(10)] + [500.0, None, NAN]
    df = spark.createDataFrame([(v, 1.0) for v in values], "v double, k double")
    clean, log = S.remove_outliers(df)
    kept = [r[0] for r in rows(clean)]
    assert len(kept) == 12 and 500.0 not in kept and None in kept
    assert [a["removed_rows"] for a in log["affected"]] == [1, 0]
    assert S.remove_outliers(df, threshold=1000.0)[0].count() == 13
    assert S.remove_outliers(df.select(F.lit("x").alias("s")))[1]["affected"] == []


def test_fences_are_inclusive(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 2, 2, 4, 4)], "v double")  # q1 2, q3 4, fences -1 and 7
    assert S.remove_outliers(df.union(spark.createDataFrame([(7.0,)], "v double")), columns=["v"])[0].count() >= 5
    at_edge = S.remove_outliers(df, threshold=1.0)[0]
    assert at_edge.count() == 5  # 0 lies exactly on the lower fence


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b", 2), (2, "a", 3), (3, None, 4)], "id int, c string, z int")
    clean, log = S.encode_categorical(df, columns=["c"])
    assert clean.columns == ["id", "c_a", "c_b", "c_null", "z"]
    assert rows(clean) == [(1, 0, 1, 0, 2), (2, 1, 0, 0, 3), (3, 0, 0, 1, 4)]
    assert log["affected"] == [{"column": "c", "columns": ["c_a", "c_b", "c_null"]}]


def test_one_hot_limit_and_default_choice(spark):
    df = spark.createDataFrame([(str(i), str(i % 50), i % 2 == 0) for i in range(102)], "many string, few string, flag boolean")
    with pytest.raises(ValueError, match="more than 50"):
        S.encode_categorical(df, columns=["many"])
    fifty_one = df.select(F.expr("cast(cast(many as int) % 51 as string)").alias("c"))
    with pytest.raises(ValueError, match="more than 50"):
        S.encode_categorical(fifty_one, columns=["c"])
    clean, _ = S.encode_categorical(df)
    assert "many" in clean.columns and "flag_false" in clean.columns and len(clean.columns) == 1 + 50 + 2
    with pytest.raises(ValueError, match="collide"):
        S.encode_categorical(spark.createDataFrame([("a", 1)], "c string, c_a int"), columns=["c"])


@pytest.mark.parametrize("small", [True, False])
def test_label_codes(spark, monkeypatch, small):
    if not small:  # the way for large code tables, with a hot value and hot nulls
        monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(S, "HOT_SHARE", 4)
    values = [f"v{i:03}" for i in range(200)] + ["v050"] * 150 + [None] * 150
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value string").repartition(5)
    clean, log = S.encode_categorical(df, "label", ["value"])
    assert clean.columns == ["id", "value"] and log["affected"] == [{"column": "value", "categories": 200}]
    expected = {i: None if v is None else int(v[1:]) for i, v in enumerate(values)}
    assert {r["id"]: r["value"] for r in clean.collect()} == expected


def test_label_codes_over_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([((i * 37) % 500,) for i in range(500)], "v int")
        codes = S.value_codes(df, "v")
        assert codes.where("value <> code").count() == 0 and codes.count() == 500
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert S.encode_categorical(spark.createDataFrame([(None,)], "v string"), "label", ["v"])[0].first()[0] is None


def test_normalize(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 5.0, "b"), (3, None, "c")], "n int, k double, s string")
    clean, log = S.normalize(df)
    assert rows(clean) == [(-1.0, 0.0, "a"), (0.0, 0.0, "b"), (1.0, None, "c")]
    assert log["affected"][0] == {"column": "n", "mean": 2.0, "std": 1.0}


def test_chain_as_planned(spark):
    data = [(float(i), "ab"[i % 2]) for i in range(20)] + [(None, "a"), (10_000.0, None)]
    df = spark.createDataFrame(data, "v double, c string")
    clean, logs = Cleaning(
        [
            {"step": "handle_missing", "params": {"strategy": "median"}},
            StepCall("remove_outliers"),
            step_from_spec('{"step": "encode_categorical", "params": {"method": "onehot"}}'),
        ]
    ).run(df)
    assert clean.columns == ["v", "c_a", "c_b"]  # the row with the unknown category was the outlier
    assert clean.count() == 21
    assert clean.where(" OR ".join(f"{c} IS NULL" for c in clean.columns)).count() == 0
    assert [x["step"] for x in logs] == ["handle_missing", "remove_outliers", "encode_categorical"]
    saved = log_frame(spark, logs).orderBy("step_order").collect()
    assert [r["step_order"] for r in saved] == [0, 1, 2]
    assert json.loads(saved[0]["applied_changes"])["affected"][0] == {"column": "v", "fill": 10.0}


def test_steps_stay_one_narrow_stage(people):
    clean, _ = Cleaning([{"step": "handle_missing"}, {"step": "normalize"}]).run(people)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_register_step(people):
    @S.register_step("shout")
    def shout(df, column):
        return C.replace_column(df, column, F.upper(column)), {"affected": [{"column": column}]}

    clean, logs = Cleaning([{"step": "shout", "params": {"column": "city"}}]).run(people)
    assert clean.first()["city"] == "HANOI" and logs == [{"step": "shout", "affected": [{"column": "city"}]}]
    with pytest.raises(ValueError, match="unknown step"):
        Cleaning([{"step": "whisper"}])


def test_column_operators(people):
    assert C.select_column(people, "age").columns == ["age"]
    assert C.drop_nulls(people, "age").count() == 3
    changed = C.replace_column(people, "name", F.lower("name"))
    assert changed.columns == people.columns and changed.first()["name"] == "alice"
    with pytest.raises(ValueError):
        C.select_column(people, "nope")
