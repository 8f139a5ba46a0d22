import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from larkspur.functions import scalars as X
from larkspur.functions.types import dtype_name
from larkspur.operators.similar import similar
from larkspur.plans.tools import query_dataset


def test_query(people):
    rows = query_dataset(people, "SELECT city, count(*) AS n FROM dataset GROUP BY city -- a remark").collect()
    assert {tuple(r) for r in rows} == {("Hanoi", 2), ("Saigon", 2)}
    text = "WITH old AS (SELECT * FROM dataset WHERE age >= :least) SELECT name FROM old ORDER BY name;"
    assert [r["name"] for r in query_dataset(people, text, args={"least": 30}).collect()] == ["Alice", "Dave"]
    assert query_dataset(people, "SELECT * FROM dataset", limit=2).count() == 2


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE x", "INSERT INTO dataset VALUES (1)", "SELECT 1; SELECT 2", "CREATE TABLE t AS SELECT 1",
        "SELECT 1) x; DROP TABLE y --", "SET spark.x = 1", "",
    ],
)
def test_only_queries(people, text):
    with pytest.raises(ParseException):
        query_dataset(people, text)


def test_only_the_dataset(spark, people, sf001):
    lines = spark.read.parquet(f"{sf001}/lineitem.parquet")
    with pytest.raises(ValueError, match="other than the dataset"):
        query_dataset(lines, f"SELECT * FROM parquet.`{sf001}/orders.parquet`")
    with pytest.raises(ValueError, match="forbidden"):
        query_dataset(people, "SELECT reflect('java.lang.System', 'nanoTime')")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("larkspur")]


def test_all_rows_unless_limited(spark):
    assert query_dataset(spark.range(3000), "SELECT * FROM dataset").count() == 3000


@pytest.mark.parametrize(
    "text", ["SELECT `reflect`('java.lang.System', 'nanoTime')", "SELECT reflect/**/('java.lang.System', 'nanoTime')",
             "SELECT * FROM other", "SELECT * FROM dataset WHERE id IN (SELECT id FROM other)", "SELECT (SELECT max(id) FROM other) AS m"],
)
def test_plan_guard(spark, people, text):
    spark.range(5).createOrReplaceTempView("other")
    try:
        with pytest.raises(ValueError):
            query_dataset(people.withColumn("id", F.lit(1)), text)
    finally:
        spark.catalog.dropTempView("other")


def test_similar(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.1]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    found = similar(df, [1.0, 0.0], 3, tie="id").collect()
    assert [r["id"] for r in found] == [0, 2, 1] and found[0]["similarity"] == pytest.approx(1)


def test_scalars(spark):
    df = spark.createDataFrame([("/a.b/X.CSV", 1.0), ("/a.b/plain", float("nan")), ("/x/.hidden", float("-inf"))], "p string, v double")
    assert [r[0] for r in df.select(X.file_format(F.col("p"))).collect()] == ["csv", "", ""]
    assert [r[0] for r in df.select(X.file_name(F.col("p"))).collect()] == ["X.CSV", "plain", ".hidden"]
    assert [r[0] for r in df.select(X.finite_only(F.col("v"))).collect()] == [1.0, None, None]
    ids = df.select(X.stable_id(F.col("p")).alias("a"), X.new_id().alias("b")).collect()
    assert len({r["a"] for r in ids} | {r["b"] for r in ids}) == 6 and all(len(r["a"]) == 36 for r in ids)
    assert X.histogram_title("x") == "Distribution of x" and X.bar_title("x", 20) == "Top 20 categories of x"


def test_dtype_names(spark):
    df = spark.sql("SELECT 1S a, 1 b, 1L c, 1F d, 1D e, 'x' f, true g, DATE'2024-01-01' h, 1.5BD i, array(1) j, named_struct('k', 1) k")
    assert [dtype_name(f.dataType) for f in df.schema] == [
        "Int16", "Int32", "Int64", "Float32", "Float64", "String", "Boolean", "Date",
        "Decimal(precision=2, scale=1)", "List(Int32)", "Struct({'k': Int32})",
    ]
