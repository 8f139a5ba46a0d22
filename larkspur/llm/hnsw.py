"""Nearest neighbours by largest inner product: one small-world graph per shard, results merged.

Vectors that are equal in every component are one point, with its smallest ids, so that a vector with thousands of copies
is one node and not a clique. Points are dealt to shards by a hash. Inner products become distances by one more component
that gives all points the shard's largest norm (and queries none), which keeps their order. Each shard's graph is a row of flat
arrays: vectors, levels, and for every level a table of neighbours, -1 where there is none. Points enter in batches that are
searched together; distances are numpy products over a batch.

Queries are packed in blocks and each block is searched in each shard. The best points of all shards are merged, their ids
filled in, and the score is the inner product of the original vectors in double precision.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do rows without an id or with
another number of components than `dimension`. A tie goes to the smaller id. With fewer candidates than `k` all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, field, table

NEAREST = 20
#: Points of a shard: its arrays must fit a task many times over.
SHARD_POINTS = 4096
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 128
BATCH = 256
QUERY_BLOCK = 256
EXPANDED = 4


# --- one shard --------------------------------------------------------------------------------------------


class Graph:
    """A small-world graph in flat arrays."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.levels, self.links, self.entry = vectors, levels, links, entry

    def search(self, queries: np.ndarray, width: int, last: int = 0, top: int | None = None, entry: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and points, nearest first, for all queries: greedy on the upper levels, `width` wide on level `last`."""
        start = np.full(len(queries), self.entry if entry is None else entry)
        for level in range((len(self.links) - 1) if top is None else top, last, -1):
            start = self._beam(queries, start[:, None], 1, level)[1][:, 0]
        return self._beam(queries, start[:, None], width, last)

    def _distance(self, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
        return self.norms[points] - 2 * np.einsum("qd,qnd->qn", queries, self.vectors[points], optimize=False)

    @property
    def norms(self) -> np.ndarray:
        if not hasattr(self, "_norms"):
            self._norms = np.einsum("nd,nd->n", self.vectors, self.vectors)
        return self._norms

    def _beam(self, queries: np.ndarray, start: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step, several points of each expanded at a time."""
        links, rows, count = self.links[level], np.arange(len(queries))[:, None], len(self.vectors)
        seen = np.zeros((len(queries), count + 1), dtype=bool)  # the last column stands for "no point"
        seen[:, count] = True
        seen[rows, start] = True
        points = np.full((len(queries), width), count)
        distances = np.full((len(queries), width), np.inf)
        opened = np.ones((len(queries), width), dtype=bool)
        points[:, : start.shape[1]] = start
        distances[:, : start.shape[1]] = self._distance(queries, start)
        opened[:, : start.shape[1]] = False
        active = np.arange(len(queries))
        at_once = min(EXPANDED, width)
        while len(active):
            # the nearest points that are not expanded yet
            waiting = np.where(opened[active], np.inf, distances[active])
            if at_once < width:
                nearest = np.argpartition(waiting, at_once - 1, axis=1)[:, :at_once]
            else:
                nearest = np.broadcast_to(np.arange(width), waiting.shape)
            live = np.isfinite(np.take_along_axis(waiting, nearest, axis=1))
            keep = live.any(axis=1)
            active, nearest, live = active[keep], nearest[keep], live[keep]
            if not len(active):
                break
            chosen = np.where(live, points[active[:, None], nearest], count)
            opened[active[:, None], nearest] = True
            found = links[chosen].reshape(len(active), -1)
            found = np.where(seen[active[:, None], found], count, found)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = count
            # few of them are new: move those to the front and drop the rest of the columns
            found.sort(axis=1)
            found = found[:, : max(1, int((found < count).sum(axis=1).max()))]
            seen[active[:, None], found] = True
            away = np.where(found < count, self._distance(queries[active], np.minimum(found, count - 1)), np.inf)
            both = np.concatenate([distances[active], away], axis=1)
            which = np.concatenate([points[active], found], axis=1)
            done = np.concatenate([opened[active], found == count], axis=1)
            best = np.argpartition(both, width - 1, axis=1)[:, :width] if both.shape[1] > width else np.broadcast_to(np.arange(width), both.shape)
            distances[active] = np.take_along_axis(both, best, axis=1)
            points[active] = np.take_along_axis(which, best, axis=1)
            opened[active] = np.take_along_axis(done, best, axis=1)
        order = np.lexsort((points, distances), axis=1)
        return np.take_along_axis(distances, order, axis=1), np.take_along_axis(points, order, axis=1)


def diverse(vectors: np.ndarray, norms: np.ndarray, points: np.ndarray, distances: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates (nearest first, -1 for none) at most `most`: one is passed over if a nearer chosen one is nearer
    to it than the point itself, and passed-over ones fill what is left."""
    count, width = points.shape
    got = vectors[np.maximum(points, 0)]
    square = norms[np.maximum(points, 0)]
    between = square[:, :, None] + square[:, None, :] - 2 * (got @ got.transpose(0, 2, 1))
    real = points >= 0
    chosen = np.zeros((count, width), dtype=bool)
    for i in range(width):
        blocked = (chosen & (between[:, i, :] < distances[:, i : i + 1])).any(axis=1)
        chosen[:, i] = real[:, i] & ~blocked & (chosen.sum(axis=1) < most)
    order = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(points, order, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    """Points enter level by level in batches; each batch is searched in the graph so far, and among itself."""
    count = len(vectors)
    random = np.random.default_rng(seed)
    levels = np.minimum((-np.log(1 - random.random(count)) / math.log(LINKS)).astype(np.int64), 8)
    order = np.argsort(-levels, kind="stable")  # upper levels first, so an entry point never changes
    top = int(levels[order[0]])
    widths = [2 * LINKS, *[LINKS] * top]
    links = [np.full((count + 1, w), count, dtype=np.int32) for w in widths]  # the last row has no neighbours
    graph = Graph(vectors, levels, links, int(order[0]))
    norms = graph.norms
    placed, size = 1, 1
    while placed < count:
        size = min(max(placed // 2, 1), BATCH)
        batch = order[placed : placed + size]
        for level in range(int(levels[batch[0]]), -1, -1):
            here = batch[levels[batch] >= level]
            if not len(here):
                continue
            query = vectors[here]
            distances, points = graph.search(query - 0, min(BUILD_WIDTH, max(2 * LINKS, 1)) if level else BUILD_WIDTH, last=level)
            distances = distances + norms[here][:, None]
            # neighbours among the batch itself
            own = norms[here][:, None] + norms[here][None, :] - 2 * (query @ query.T)
            np.fill_diagonal(own, np.inf)
            near = np.argsort(own, axis=1)[:, : 2 * LINKS]
            distances = np.concatenate([distances, np.take_along_axis(own, near, axis=1)], axis=1)
            points = np.concatenate([points, here[near]], axis=1)
            points = np.where(np.isfinite(distances), points, count)
            rank = np.argsort(distances, axis=1, kind="stable")[:, : BUILD_WIDTH]
            distances, points = np.take_along_axis(distances, rank, axis=1), np.take_along_axis(points, rank, axis=1)
            chosen = diverse(vectors, norms, np.where(points < count, points, -1), distances, LINKS)
            width = widths[level]
            links[level][here, :LINKS] = np.where(chosen >= 0, chosen, count)
            _link_back(vectors, norms, links[level], here, chosen, width)
        placed += size
    for table_ in links:
        table_[table_ == count] = -1
    graph.links = [t[:count] for t in links]
    return graph


def _link_back(vectors: np.ndarray, norms: np.ndarray, links: np.ndarray, here: np.ndarray, chosen: np.ndarray, width: int) -> None:
    """Give each chosen neighbour a link back; where its row is full, choose anew."""
    count = len(vectors)
    target = chosen.ravel()
    source = np.repeat(here, chosen.shape[1])
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    rows, first, many = np.unique(target, return_index=True, return_counts=True)
    added = np.full((len(rows), int(many.max()) if len(rows) else 0), count)
    place = np.arange(len(target)) - np.repeat(first, many)
    added[np.repeat(np.arange(len(rows)), many), place] = source
    both = np.sort(np.concatenate([links[rows], added], axis=1), axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = count
    both.sort(axis=1)
    full = (both < count).sum(axis=1) > width
    if (~full).any():
        links[rows[~full]] = both[~full][:, :width] if both.shape[1] >= width else np.pad(both[~full], ((0, 0), (0, width - both.shape[1])), constant_values=count)
    if full.any():
        rows, both = rows[full], both[full]
        safe = np.minimum(both, count - 1)
        away = norms[rows][:, None] + norms[safe] - 2 * np.einsum("qd,qnd->qn", vectors[rows], vectors[safe])
        away = np.where(both < count, away, np.inf)
        rank = np.argsort(away, axis=1, kind="stable")
        away, both = np.take_along_axis(away, rank, axis=1), np.take_along_axis(both, rank, axis=1)
        kept = diverse(vectors, norms, np.where(both < count, both, -1), away, width)
        links[rows] = np.where(kept >= 0, kept, count)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more component, so that all points have the largest norm and nearest means largest inner product.

    In double precision and in units of the largest component, so that a very long vector neither overflows nor hides the others.
    """
    vectors = vectors / max(float(np.abs(vectors).max()), np.finfo(np.float64).tiny)
    norms = np.einsum("nd,nd->n", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1)


# --- jobs -------------------------------------------------------------------------------------------------


def usable(vector: Column, dimension: int | None) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    right = (F.size(vector) > 0) if dimension is None else (F.size(vector) == dimension)
    return vector.isNotNull() & right & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def points_of(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their number (the smallest id) and their k + 1 smallest ids.

    Of a vector with any number of copies, only k + 1 rows of each task move.
    """
    cut = vectors.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= k + 1)
    return cut.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("point", F.element_at("ids", 1))


def index(points: DataFrame, shards: int) -> DataFrame:
    """One row per shard: points, their vectors, and the graph in flat arrays."""

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("point")
        vectors = np.stack(group["vector"].to_numpy()).astype(np.float64)
        graph = build(lifted(vectors))
        flat = np.concatenate([t.ravel() for t in graph.links]).astype("<i4")
        return pd.DataFrame(
            {
                "shard": [int(group["shard"].iloc[0])],
                "points": [group["point"].to_numpy(dtype="<i8").tobytes()],
                "vectors": [vectors.astype("<f8").tobytes()],
                "links": [flat.tobytes()],
                "widths": [[t.shape[1] for t in graph.links]],
                "entry": [graph.entry],
            }
        )

    dealt = points.select("point", "vector", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"))
    schema = "shard int, points binary, vectors binary, links binary, widths array<int>, entry int"
    return dealt.groupBy("shard").applyInPandas(make, schema)


def load(row: pd.Series) -> tuple[np.ndarray, np.ndarray, Graph]:
    """Points, original vectors and graph of a row of the index."""
    points = np.frombuffer(row["points"], dtype="<i8")
    vectors = np.frombuffer(row["vectors"], dtype="<f8").reshape(len(points), -1)
    flat, links, at = np.frombuffer(row["links"], dtype="<i4"), [], 0
    for width in row["widths"]:
        part = flat[at : at + len(points) * width].reshape(len(points), width)
        part = np.where(part < 0, len(points), part)
        links.append(np.concatenate([part, np.full((1, width), len(points))]).astype(np.int32))
        at += len(points) * width
    return points, vectors, Graph(lifted(vectors), np.zeros(0), links, int(row["entry"]))


def search(indexed: DataFrame, queries: DataFrame, shards: int, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """The k + 1 best points of each shard for every distinct query vector: query, point, score."""

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), QUERY_BLOCK):
                part = batch.iloc[at : at + QUERY_BLOCK]
                body = np.stack(part["vector"].to_numpy()).astype("<f8").tobytes()
                yield pd.DataFrame({"queries": [part["point"].to_numpy(dtype="<i8").tobytes()], "body": [body]})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, loaded = None, None
        for batch in batches:
            for _, row in batch.iterrows():
                if held != row["shard"]:
                    held, loaded = row["shard"], load(row)
                points, vectors, graph = loaded
                names = np.frombuffer(row["queries"], dtype="<i8")
                wanted = np.frombuffer(row["body"], dtype="<f8").reshape(len(names), -1)
                scaled = wanted / np.abs(wanted).max(axis=1, keepdims=True)  # the order of its products stays
                near = graph.search(np.pad(scaled, ((0, 0), (0, 1))), min(width, max(len(points), 1)))[1]
                real = near < len(points)
                safe = np.minimum(near, len(points) - 1)
                scores = np.where(real, np.einsum("qd,qnd->qn", wanted, vectors[safe]), -np.inf)
                order = np.lexsort((points[safe], -scores), axis=1)[:, : k + 1]
                kept = np.take_along_axis(real, order, axis=1)
                yield pd.DataFrame(
                    {
                        "query": np.repeat(names, order.shape[1])[kept.ravel()],
                        "point": points[np.take_along_axis(safe, order, axis=1)][kept],
                        "score": np.take_along_axis(scores, order, axis=1)[kept],
                    }
                )

    blocks = queries.select("point", "vector").mapInPandas(block, "queries binary, body binary")
    everywhere = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return everywhere.join(indexed, "shard").mapInPandas(find, "query long, point long, score double")


def nearest(
    df: DataFrame, is_query: Column, k: int = NEAREST, key: str = "vec_id", vector: str = "embedding",
    dimension: int | None = None, shard_points: int = SHARD_POINTS,
) -> DataFrame:
    """The k nearest other rows of every row that `is_query` names: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    scratch = Scratch(spark, "hnsw")
    named = df.select(field(key).cast("long").alias("id"), field(vector).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    rows = named.where(F.col("id").isNotNull() & usable(F.col("vector"), dimension))
    if dimension is None:
        common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
        rows = rows.where(F.size("vector") == (common["size"] if common else 0))
    points = scratch.keep(points_of(rows, k))
    count = points.count()
    shards = max(1, -(-count // shard_points))
    indexed = scratch.keep(index(points, shards))
    asked = rows.where("is_query").join(points.select("vector", "point"), "vector").select("id", "point", "vector")
    asked = scratch.keep(asked)
    distinct = asked.groupBy("point").agg(F.first("vector").alias("vector"))
    found = search(indexed, distinct, shards, k)
    # merge: the best points of all shards, then their ids; a query's own id may be one of k + 1
    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    merged = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    ids = merged.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best_ids = ids.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    lists = best_ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    per_query = asked.select(F.col("id").alias("query_id"), F.col("point").alias("query")).join(lists, "query")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    listed = per_query.select("query_id", F.posexplode(others).alias("at", "hit"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id"), F.col("hit.score"))


def op5_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op5_hnsw_search": op5_hnsw_search}
ORACLE: dict[str, str] = {}
