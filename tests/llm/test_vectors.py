"""Threshold clustering and whitening against brute force, with the edges of their tables."""

import math
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import centroids, vectors, whitening

CLASHES = ["id", "x", "v", "cluster", "distance", "part", "entry", "high", "low", "row", "component", "n", "a.b", "a b.c"]
SCHEMA = "vec_id long, embedding array<float>"


def table_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in CLASHES:
        df = df.withColumn(name, F.lit(name))
    return df


def rows_of(seed, count, dimension):
    random = np.random.default_rng(seed)
    return [(i, random.normal(0, 0.4, dimension).astype(np.float32).tolist()) for i in range(count)]


def odd_rows(dimension):
    """Rows that take no part: null vectors and entries, entries that are no numbers, other lengths."""
    bad = [None, [], [0.5] * (dimension - 1), [0.5] * (dimension + 1)]
    bad += [[0.1] * (dimension - 1) + [x] for x in (None, math.nan, math.inf, -math.inf)]
    return [(1000 + i, v) for i, v in enumerate(bad)]


# --- clustering -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("count", "k", "dimension", "reach"),
    [(300, 40, 64, 300), (300, 7, 3, 3), (200, 5, 1, 2), (40, 12, 5, 2**40), (60, 3, 2, 2**27), (20, 1, 2, 9)],
)
def test_nearest_is_brute_force(count, k, dimension, reach):
    random = np.random.default_rng(count)
    x = random.integers(-reach, reach, (count, dimension))
    points = np.concatenate([x[: k - 1], x[:1]]).tolist()  # equal centroids tie
    given = x if reach <= vectors.SMALL else x.astype(object)
    number, best, computed = centroids.nearest(given, centroids._as_array(points))
    full = ((x.astype(object)[:, None] - np.array(points, dtype=object)[None]) ** 2).sum(axis=2)
    assert number.tolist() == full.argmin(axis=1).tolist()
    assert best.tolist() == full.min(axis=1).tolist()
    assert computed <= count * k


def test_walk_stops_early_where_lists_tell():
    x = np.arange(0, 4000, 10).reshape(-1, 1)
    _, _, computed = centroids.nearest(x, np.arange(0, 4000, 100).reshape(-1, 1))
    assert computed <= 3 * len(x)


def plain_clusters(rows, k, rounds, dimension):
    kept = []
    for name, v in rows:
        if v is not None and len(v) == dimension and all(e is not None and math.isfinite(e) for e in v):
            kept.append((name, [math.floor(256 * float(np.float32(e))) for e in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    points = [r[1] for r in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(points)) for _, x in kept]

    for _ in range(rounds):
        found = assigned()
        for i in range(len(points)):
            own = [x for (_, x), (_, c) in zip(kept, found, strict=True) if c == i]
            if own:
                points[i] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted(((n, c, d) for (n, _), (d, c) in zip(kept, assigned(), strict=True)), key=str), points


@pytest.mark.parametrize(("count", "k"), [(60, 6), (4, 9)])
def test_clusters_are_the_plain_ones(spark, count, k):
    rows = rows_of(count, count, 5)
    rows += [(None, rows[1][1]), (None, rows_of(9, 1, 5)[0][1]), rows[2], rows[2], (2, rows[0][1]), *odd_rows(5)]
    found = centroids.cluster(table_of(spark, rows), k=k, dimension=5)
    want, points = plain_clusters(rows, k, 5, 5)
    got = sorted(((r["id"], r["cluster"], r["distance"]) for r in found.assigned.collect()), key=str)
    assert got == want
    assert found.centroids == points
    assert sum(found.inertia.values()) == sum(d for _, _, d in want)


def test_clusters_of_nothing(spark, tmp_path):
    for rows in ([], odd_rows(64)):
        folder = tmp_path / str(len(rows))
        table_of(spark, rows).write.parquet(str(folder / "embeddings.parquet"))
        assert centroids.op11_threshold_centroids(spark, str(folder)).collect() == []


def test_an_entry_without_a_whole_number_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], SCHEMA), dimension=2)


def test_sums_are_exact(spark):
    df = spark.createDataFrame([(i, [2**52, -(2**52) - i]) for i in range(3000)], "id long, x array<long>")

    def count(batch, totals):
        added = vectors.matrix(batch).sum(axis=0)
        totals[7] = totals[7] + added if 7 in totals else added

    assert vectors.sums_of(df, count) == {7: [3000 * 2**52, -3000 * 2**52 - 3000 * 2999 // 2]}


# --- whitening --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "matrix",
    [
        np.diag(1 / np.arange(1.0, 81) ** 2), np.eye(30) * 3, np.diag([5.0] * 5 + [1.0] * 40), np.diag([1.0, 1e-8] + [0.0] * 50),
        np.diag(np.linspace(900, 1000, 64)), np.ones((3, 3)), np.array([[2.0]]),
    ],
)
def test_leading_pairs(matrix):
    turn = np.linalg.qr(np.random.default_rng(2).standard_normal(matrix.shape))[0]
    matrix = turn @ matrix @ turn.T
    found = whitening.leading(lambda block: matrix @ block, len(matrix), 4)
    want = np.linalg.eigvalsh(matrix)[::-1][:4]
    assert np.allclose(found.values, want, rtol=0, atol=1e-12 * want[0])
    assert np.allclose(matrix @ found.vectors, found.vectors * found.values, atol=1e-11 * want[0])
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(len(want)), atol=1e-13)


def test_filter_damps_the_unwanted_interval():
    values = np.linspace(0, 12, 49)
    out = whitening.chebyshev(lambda b: values[:, None] * b, np.ones((49, 1)), 1.0, 9.0, 12.0, 8)[:, 0]
    assert abs(out[-1] - 1) < 1e-12
    assert np.abs(out[(values >= 1) & (values <= 9)]).max() < 1e-3


def test_not_certified_is_an_error():
    matrix = np.diag(np.linspace(0.999, 1.0, 60))
    with pytest.raises(RuntimeError, match="not certified"):
        whitening.leading(lambda block: matrix @ block, 60, 4, most=1)


def test_whitened_rows(spark):
    rows = rows_of(3, 120, 30)
    good = [*rows, (None, rows[5][1]), rows[7], *[(500 + i, rows[3][1]) for i in range(40)]]
    found, model = whitening.whiten(table_of(spark, good + odd_rows(30)))
    x = np.floor(256 * np.array([v for _, v in good], dtype=np.float32).astype(float)).astype(int)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    assert (model.moments.n, model.moments.total) == (n, total.tolist())
    centred = fit - total / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:4], basis[:, ::-1][:, :4]
    signs = np.sign((model.basis.vectors * basis).sum(axis=0))
    assert np.allclose(model.basis.vectors * signs, basis, atol=1e-11)
    assert np.allclose(model.explained, values / (np.square(centred).sum() / n), rtol=1e-12)
    assert model.identity_error < 1e-12
    white = (x - total / n) @ (basis * signs) / np.sqrt(values)
    want = sorted(
        (str(i), c + 1, int(((n * v - total) ** 2).sum()), round(white[r, c], 9))
        for r, ((i, _), v) in enumerate(zip(good, x, strict=True))
        for c in range(4)
    )
    got = sorted((str(r["id"]), r["component"], int(r["deviation"]), round(r["whitened"], 9)) for r in found.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-8)


@pytest.mark.parametrize(
    ("rows", "count"),
    [([], 0), (odd_rows(3)[:1], 0), ([(1, [0.5, 0.25])] * 3, 0), ([(1, [0.5, 0.25]), (2, [0.75, 0.5])], 2), ([(i, [i / 8]) for i in range(5)], 5)],
)
def test_as_many_components_as_have_variance(spark, tmp_path, rows, count):
    table_of(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = whitening.op13_chebyshev_whitening(spark, str(tmp_path)).collect()
    assert len(found) == count
    assert all(r["component"] == 1 and abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-12 for r in found)


def test_deviation_beyond_64_bits(spark):
    model = whitening.Whitening(whitening.Moments(2**40, [2**41, 0], 1), whitening.Basis(np.eye(2)[:, :1], np.ones(1), np.zeros(1)), 0.0)
    row = whitening.apply_whitening(spark.createDataFrame([(1, [2**20, 5])], "id long, x array<long>"), model).first()
    assert int(row["deviation"]) == (2**60 - 2**41) ** 2 + (5 * 2**40) ** 2
