import json

import pytest

from larkspur.plans import datasets as D
from larkspur.sources import catalog as K


@pytest.fixture
def store(spark, tmp_path):
    return K.Catalog(spark, str(tmp_path / "catalog"))


def test_add_and_open(store, people):
    key = D.add_dataset(store, people, "w", "people")
    again = D.open_dataset(store, key, "w")
    assert again.dtypes == people.dtypes and again.exceptAll(people).count() == 0 and again.count() == 4
    entry = store.list_datasets("w").first()
    assert (entry["id"], entry["original_name"], entry["status"], entry["row_count"], entry["column_count"], entry["parent_id"]) == (
        key, "people", "ready", 4, 3, None,
    )
    columns = store.dataset_detail(key, "w").first()["columns"]
    assert [(c["name"], c["null_count"]) for c in columns] == [("name", 0), ("age", 1), ("city", 0)]


def test_other_workspaces_and_bad_ids(spark, store, people):
    key = D.add_dataset(store, people, "w", "people")
    for dataset, workspace in ((key, "x"), ("none", "w")):
        with pytest.raises(LookupError):
            D.open_dataset(store, dataset, workspace)
        with pytest.raises(LookupError):
            D.query_by_id(store, dataset, workspace, "SELECT * FROM dataset")
        with pytest.raises(LookupError):
            D.clean_dataset(store, dataset, workspace, [{"step": "handle_missing"}])
    store.append("datasets", spark.createDataFrame([("bad", "w", "failed", "broken")], "id string, workspace_id string, status string, error string"))
    with pytest.raises(ValueError, match="broken"):
        D.open_dataset(store, "bad", "w")
    assert {r["id"] for r in store.list_datasets("w").collect()} == {key, "bad"}


def test_lookup_reads_one_workspace(store, people):
    D.add_dataset(store, people, "w", "people")
    D.add_dataset(store, people, "x", "people")
    plan = store.get_by_id("k", "w")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(workspace_id" in plan


def test_empty_and_named_like_the_catalogue(spark, store):
    df = spark.createDataFrame([], "dataset_id string, row_count bigint, position int")
    key = D.add_dataset(store, df, "w", "none")
    assert D.open_dataset(store, key, "w").columns == df.columns
    assert len(store.dataset_detail(key, "w").first()["columns"]) == 3


def test_clean(store, people):
    key = D.add_dataset(store, people, "w", "people")
    made = D.clean_dataset(store, key, "w", [{"step": "handle_missing"}, {"step": "normalize"}], name="clean")
    entry = store.get_by_id(made, "w").first()
    assert (entry["parent_id"], entry["original_name"], entry["row_count"]) == (key, "clean", 4)
    assert D.open_dataset(store, made, "w").where("age IS NULL").count() == 0
    log = store.pipeline_logs(key).collect()
    assert [r["step_name"] for r in log] == ["handle_missing", "normalize"]
    assert json.loads(log[0]["applied_changes"])["affected"][0]["column"] == "age"
    bars = D.chart_by_id(store, made, "w", "bar", column="city").spec()
    assert [r["count"] for r in bars["series"][0]["data"]] == [2, 2]
    assert D.query_by_id(store, key, "w", "SELECT name FROM dataset WHERE age > 28 ORDER BY name").count() == 2


def test_train(spark, store):
    rows = spark.range(400).selectExpr("id", "id % 7 AS a", "IF(id % 2 = 0, 'x', 'y') AS b", "IF(id % 2 = 0, 'even', 'odd') AS kind")
    key = D.add_dataset(store, rows, "w", "numbers")
    first = D.train_dataset(store, key, "w", "kind", key=["id"], features=["a", "b"])
    assert first.best.metrics["accuracy"] == 1.0
    found = store.leaderboard_for(key).collect()
    assert len(found) == 3 and [r["artifact_path"] is not None for r in found] == [r["model_type"] == first.best.name for r in found]
    assert all(json.loads(r["hyperparams"]) for r in found)
