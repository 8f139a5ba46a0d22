import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators.ranking import rank_within


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_hot_group(spark, coalesce):
    """One group has most rows and is spread over ranges; one key is null."""
    rng = random.Random(2)
    rows = [("hot", i, rng.random()) for i in range(2000)] + [(f"g{i % 40}", i, rng.random()) for i in range(400)]
    rows += [(None, i, rng.random()) for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "`g.k` string, id int, score double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        ranked = rank_within(df, ["g.k"], [F.col("score").desc(), F.col("id")])
        found = {(r[0], r["id"]): r["rank"] for r in ranked.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = {}
    for group in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))
        expected.update({(group, r[1]): n for n, r in enumerate(ordered, 1)})
    assert found == expected


def test_whole_table_and_empty(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("v"))
    assert rank_within(df, [], [F.col("v")], "n").where("n <> v + 1").count() == 0
    assert rank_within(df.limit(0), [], [F.col("v")]).count() == 0
