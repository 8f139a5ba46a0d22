"""Centroid clustering in whole numbers; the nearest centroid is found by the threshold algorithm.

Every dimension has the centroids in a list sorted by their value there. From a vector's own value the lists are walked outward,
each step taking the next nearer one of the two sides in every dimension; a centroid that is met for the first time gets its exact distance.
The squared steps of all dimensions add up to a bound below which no unmet centroid can lie, so a vector is done when that
sum strictly exceeds its best distance: one of equal distance and smaller number may still be unmet before that. All vectors of a batch walk together.

All numbers are integers, so sums over tasks are exact and the result does not depend on how rows are dealt. A round moves one sum per
task, cluster and dimension; only the centroids (`k` times `dimension` numbers) reach the driver and go back to the tasks.

Vectors that are null, of another length, or hold null or non-finite entries take no part. Rows without an id are clustered and start
a centroid only when too few others are there; of equal ids the smaller vector comes first. Ties go to the smaller number, equal centroids
included. With fewer vectors than `k` there are as many centroids; an empty table gives no rows. Other columns are not read, so
their names may clash. An entry beyond 2**53, or a distance beyond 64 bits, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, lean, table
from larkspur.llm.vectors import SCALE, SMALL, matrix, sums_of, whole_vectors

CLUSTERS = 40
ROUNDS = 5
DIMENSION = 64
SALT = "2:"
#: Vectors that walk together.
BLOCK = 2048
#: A value beyond both ends of every list.
BEYOND = 2**28


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of every row's nearest centroid, and how many distances were computed."""
    if object in (x.dtype, centroids.dtype):
        x, centroids, beyond = x.astype(object), centroids.astype(object), 2**64
    else:
        beyond = BEYOND
    count, dimension = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable").T
    lists = np.full((dimension, count + 2), beyond, dtype=x.dtype)
    lists[:, 0] = -beyond
    lists[:, 1:-1] = np.take_along_axis(centroids.T, order, axis=1)
    names = np.full((dimension, count + 2), count)
    names[:, 1:-1] = order
    lists, names = lists.ravel(), names.ravel()
    first = np.arange(dimension) * (count + 2)
    low = np.stack([first[j] + np.searchsorted(lists[first[j] + 1 : first[j] + count + 1], x[:, j]) for j in range(dimension)], axis=1)
    high = low + 1
    number, best = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=x.dtype)
    met = np.zeros((len(x), count + 1), dtype=bool)  # one more for the ends of the lists
    active, computed = np.arange(len(x)), 0
    for step in range(count):
        own = x[active]
        down, up = own - lists[low], lists[high] - own
        left = (down <= up).astype(bool)
        away = np.where(left, down, up)
        before = met[active]
        now = before.copy()
        now[np.arange(len(active))[:, None], names[np.where(left, low, high)]] = True
        new = now & ~before
        for c in range(count):
            rows = np.flatnonzero(new[:, c])
            if len(rows):
                computed += len(rows)
                gap = own[rows] - centroids[c]
                distance, at = (gap * gap).sum(axis=1), active[rows]
                met_first = ~before[rows, :count].any(axis=1) & ~new[rows, :c].any(axis=1)
                better = met_first | (distance < best[at]) | ((distance == best[at]) & (c < number[at]))
                better = better.astype(bool)
                number[at[better]], best[at[better]] = c, distance[better]
        met[active] = now
        going = ~((away * away).sum(axis=1) > best[active]).astype(bool)
        active, low, high = active[going], (low - left)[going], (high + ~left)[going]
        if not len(active):
            break
    return number, best, computed


@dataclass
class Clustering:
    """Vectors (id, cluster, distance), the centroids by number, and the distances summed by cluster."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertia: dict[int, int]


def _as_array(centroids: list[list[int]]) -> np.ndarray:
    large = any(abs(v) > SMALL for row in centroids for v in row)
    return np.array(centroids, dtype=object if large else np.int64)


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Every row's id, cluster and squared distance."""
    fixed = _as_array(centroids)

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                number, distance, _ = nearest(matrix(part), fixed)
                arrays = [part.column("id"), pa.array(number, pa.int32()), pa.array(distance.tolist(), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "cluster", "distance"])

    return rows.mapInArrow(place, "id long, cluster int, distance long")


def improved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by the floor of its vectors' mean; those without vectors stay."""
    fixed = _as_array(centroids)

    def count(batch: pa.RecordBatch, totals: dict[int, np.ndarray]) -> None:
        for at in range(0, batch.num_rows, BLOCK):
            x = matrix(batch.slice(at, BLOCK))
            number = nearest(x, fixed)[0]
            for c in np.unique(number).tolist():
                members = x[number == c]
                added = np.append(members.sum(axis=0), len(members)).astype(object)
                totals[c] = totals[c] + added if c in totals else added

    found = sums_of(rows, count)
    return [[s // found[c][-1] for s in found[c][:-1]] if c in found else row for c, row in enumerate(centroids)]


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
    dimension: int = DIMENSION, scale: int = SCALE, salt: str = SALT,
) -> Clustering:
    """The vectors of `dimension` entries in `k` clusters, after `rounds` rounds from the `k` that a hash of the id picks."""
    scratch = Scratch(df.sparkSession, "centroids")
    rows = scratch.keep(whole_vectors(df, key, vector, dimension, scale))
    picked = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    centroids = [list(r["x"]) for r in rows.orderBy(picked.asc_nulls_last(), "x").limit(k).select("x").collect()]
    if not centroids:
        return Clustering(assign(rows, [[0] * dimension]), [], {})
    for _ in range(rounds):
        centroids = improved(rows, centroids)
    assigned = scratch.keep(assign(rows, centroids))
    scratch.drop(rows)
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    return Clustering(assigned, centroids, inertia)


def digest(centroid: list[int]) -> str:
    """SHA-256 of the entries in decimal, joined by commas."""
    return sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op11_threshold_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and the sums of distances for every embedding."""
    found = cluster(table(spark, sf_dir, "embeddings"))
    total = sum(found.inertia.values())
    rows = [(c, s, total, digest(found.centroids[c])) for c, s in sorted(found.inertia.items())]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per cluster, at most k
    joined = found.assigned.join(F.broadcast(named), "cluster")
    return joined.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int, k: int) -> str:
    """Assignment and new centroids of each round, one pair of CTEs a round."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
  SELECT k.row, min(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * {k} + c.c) AS m
  FROM kept k CROSS JOIN c{r} c GROUP BY k.row)""")
        if r < rounds:
            parts.append(f"""s{r} AS (
  SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT a.m % {k} AS c, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS j FROM a{r} a JOIN kept k USING (row)) GROUP BY c, j),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))""")
    return ",\n".join(parts)


QUERIES = {"op11_threshold_centroids": op11_threshold_centroids}
ORACLE = {
    "op11_threshold_centroids": f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {CLUSTERS}),
{_rounds_sql(ROUNDS, CLUSTERS)},
final AS (SELECT k.vec_id, CAST(a.m % {CLUSTERS} AS INTEGER) AS cluster, CAST(a.m // {CLUSTERS} AS BIGINT) AS distance
  FROM a{ROUNDS} a JOIN kept k USING (row))
SELECT f.vec_id, f.cluster, f.distance, CAST(sum(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(f.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM final f JOIN c{ROUNDS} c ON c.c = f.cluster"""
}
