import datetime as dt
import json
import shutil

import pytest
from conftest import PEOPLE
from pyspark.sql import functions as F

from larkspur.plans.cleaning import Cleaning
from larkspur.sources import catalog as K
from larkspur.sources import ingest as I
from larkspur.sources import readers
from larkspur.sources.workbook_writer import workbook
from larkspur.streaming.landing import watch_landing


@pytest.fixture
def store(spark, tmp_path):
    return K.Catalog(spark, str(tmp_path / "catalog"))


def write(folder, **files):
    folder.mkdir(exist_ok=True, parents=True)
    for name, content in files.items():
        (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """One ingest of many kinds of file, good and bad."""
    root = tmp_path_factory.mktemp("mixed")
    path = write(
        root / "in",
        **{
            "people.csv": PEOPLE,
            "b c+d%41[1].csv": PEOPLE,
            "UP.CSV": PEOPLE,
            "other_types.csv": "name,age,city\nx,1.5,true\n",
            "t.tsv": "a\tb\n1\t2024-01-01\n",
            "rows.json": '{"a":1,"b":"x"}\n{"a":2,"b":null}\n',
            "list.json": '[{"a":1.5},{"a":2}]',
            "book.xlsx": workbook(["id", "day"], [[1, dt.date(2024, 1, 1)], [2, None]]),
            "head.csv": "a,b\n",
            "empty.csv": "\n",
            "long.csv": "a,b\n1,2\n3,4,5\n",
            "bad.xlsx": b"not a zip",
            "bad.parquet": b"not parquet",
            "data.unknown": "random",
            "big.csv": "a\n" + "1\n" * 600_000,
        },
    )
    spark.range(10).withColumn("v", F.col("id") / 4).coalesce(1).write.parquet(str(root / "p"))
    shutil.copy(next((root / "p").glob("*.parquet")), root / "in" / "p.parquet")
    store = K.Catalog(spark, str(root / "catalog"))
    rows = I.ingest(spark, path, store, "w1", max_mb=1, samples=True)
    return store, {r["original_name"]: r for r in rows.collect()}


def test_statuses(mixed):
    _, rows = mixed
    found = {n: (r["status"], r["row_count"], r["column_count"]) for n, r in rows.items() if r["status"] == "ready"}
    assert found == {
        "people.csv": ("ready", 4, 3),
        "b c+d%41[1].csv": ("ready", 4, 3),
        "UP.CSV": ("ready", 4, 3),
        "other_types.csv": ("ready", 1, 3),
        "t.tsv": ("ready", 1, 2),
        "rows.json": ("ready", 2, 2),
        "list.json": ("ready", 2, 1),
        "book.xlsx": ("ready", 2, 2),
        "head.csv": ("ready", 0, 2),
        "p.parquet": ("ready", 10, 2),
    }
    errors = {n: r["error"] for n, r in rows.items() if r["status"] == "failed"}
    assert errors.keys() == {"empty.csv", "long.csv", "bad.xlsx", "bad.parquet", "data.unknown", "big.csv"}
    assert errors["data.unknown"] == "unsupported_format" and errors["big.csv"] == "file_too_large"
    assert "more fields" in errors["long.csv"] and "BadZipFile" in errors["bad.xlsx"]
    assert rows["people.csv"]["file_format"] == "csv" and rows["people.csv"]["file_size"] == len(PEOPLE)


def test_detail_and_profile(spark, mixed):
    store, rows = mixed
    people = rows["people.csv"]
    detail = store.dataset_detail(people["id"], "w1").first()
    columns = {c["name"]: c for c in detail["columns"]}
    assert list(columns) == ["name", "age", "city"]
    assert (columns["age"]["dtype"], columns["age"]["null_count"], columns["age"]["unique_count"]) == ("Int64", 1, 4)
    assert columns["age"]["sample_values"] == ["25", "30", "40"]
    payload = json.loads(people["profile"])
    assert payload["row_count"] == 4 and payload["columns"][1]["stats"]["max"] == 40.0
    assert "stats" not in payload["columns"][0]
    landed = spark.read.parquet(people["storage_path"])
    assert landed.dtypes == [("name", "string"), ("age", "bigint"), ("city", "string")] and landed.count() == 4
    other = store.dataset_detail(rows["other_types.csv"]["id"]).first()["columns"]
    assert [c["dtype"] for c in other] == ["String", "Float64", "Boolean"]
    book = store.dataset_detail(rows["book.xlsx"]["id"]).first()["columns"]
    assert [c["dtype"] for c in book] == ["Int64", "Date"]


def test_tenants(mixed):
    store, rows = mixed
    key = rows["people.csv"]["id"]
    assert store.get_by_id(key, "w1").count() == 1 and store.get_by_id(key, "w2").count() == 0
    assert store.list_datasets("w2").count() == 0 and store.list_datasets("w1").count() == len(rows)
    assert store.dataset_detail(key, "w2").count() == 0


def test_two_uploads_and_replay(spark, tmp_path, store):
    path = write(tmp_path / "in", **{"a.csv": PEOPLE, "b.csv": PEOPLE})
    files = spark.read.format("binaryFile").load(path).drop("content")
    for _ in range(2):  # the same batch twice
        I.ingest_files(files, store, "w", batch="one")
    names = [r["original_name"] for r in store.list_datasets("w").collect()]
    assert sorted(names) == ["a.csv", "b.csv"] and store.read("dataset_columns").count() == 6


def test_custom_format(spark, tmp_path, store):
    readers.register_reader([".psv"], lambda session, path: readers.read_csv(session, path, sep="|"))
    try:
        rows = I.ingest(spark, write(tmp_path / "in", **{"x.psv": "a|b\n1|2\n", "y.psv": "c\nz\n"}), store, "w")
        assert {(r["original_name"], r["status"], r["row_count"], r["column_count"]) for r in rows.collect()} == {
            ("x.psv", "ready", 1, 2), ("y.psv", "ready", 1, 1),
        }
    finally:
        del readers.READERS[".psv"]


def test_landing_folder(spark, tmp_path, store):
    landing, checkpoint = tmp_path / "land", str(tmp_path / "checkpoint")

    def run():
        watch_landing(spark, str(landing), store, "w", checkpoint).awaitTermination()
        return sorted(r["original_name"] for r in store.list_datasets("w").collect())

    write(landing, **{"a.csv": PEOPLE})
    assert run() == ["a.csv"]
    write(landing, **{"b.csv": PEOPLE})
    assert run() == ["a.csv", "b.csv"]
    assert run() == ["a.csv", "b.csv"]
    assert store.read("dataset_columns").count() == 6


def test_empty_catalog(store):
    for table in K.SCHEMAS:
        assert store.read(table).count() == 0
    assert store.list_datasets("w").count() == 0 and store.pipeline_logs("d").count() == 0


def test_pipeline_log_and_snapshot(spark, people, store):
    clean, logs = Cleaning([{"step": "handle_missing"}, {"step": "normalize"}]).run(people)
    store.write_pipeline_log("d1", logs)
    store.write_pipeline_log("d2", logs[:1])
    found = store.pipeline_logs("d1").collect()
    assert [(r["step_order"], r["step_name"]) for r in found] == [(0, "handle_missing"), (1, "normalize")]
    assert json.loads(found[0]["applied_changes"])["affected"][0]["column"] == "age"
    back = spark.read.parquet(store.write_snapshot(clean, "d1-clean"))
    assert back.dtypes == clean.dtypes and back.exceptAll(clean).count() == 0


def test_primary_workspace_and_messages(spark, store):
    at = [dt.datetime(2024, 1, day) for day in (3, 1, 1, 2)]
    rows = [("w1", "o1", "late", at[0]), ("w3", "o1", "tie", at[1]), ("w2", "o1", "first", at[2]), ("w4", "o2", "only", at[3])]
    store.append("workspaces", spark.createDataFrame(rows, K.SCHEMAS["workspaces"]))
    assert {(r["owner_id"], r["id"], r["name"]) for r in store.primary_workspaces().collect()} == {
        ("o1", "w2", "first"), ("o2", "w4", "only"),
    }
    messages = [("m2", "s", "assistant", "hello", at[3]), ("m1", "s", "user", "hi", at[1]), ("m3", "t", "user", "other", at[1])]
    frame = spark.createDataFrame(messages, "id string, session_id string, role string, content string, created_at timestamp")
    store.append("chat_messages", frame)
    assert [r["id"] for r in store.session_messages("s").collect()] == ["m1", "m2"]


def test_newest_first(spark, store):
    rows = [("a", "w", dt.datetime(2024, 1, 1)), ("b", "w", dt.datetime(2024, 1, 2)), ("c", "x", dt.datetime(2024, 1, 3))]
    store.append("datasets", spark.createDataFrame(rows, "id string, workspace_id string, created_at timestamp"))
    assert [r["id"] for r in store.list_datasets("w").collect()] == ["b", "a"]
