"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch


def _starred(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with the smallest neighbour m of u, u itself included. A hub is joined, not gathered."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _starred(both).where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _starred(down)
    out = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (vertex, label) of all vertices of `edges` (u, v); the label is the smallest vertex reached.

    Both operations keep what is connected; when neither changes the edges, every component is a star around its smallest
    vertex. Each round is written to the shared folder, and the one before is deleted.
    """
    now = scratch.keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        large = scratch.keep(large_star(now))
        after = scratch.keep(small_star(large))
        scratch.drop(now)
        scratch.drop(large)
        now = after
    labels = now.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
    return labels.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct())
