"""Neighbour projection: a low-dimensional layout that keeps each row's nearest neighbours near.

A graph of nearest neighbours is found over at most `sample` rows, picked by hash of id: every task compares its own rows with the
sample's matrix, which is broadcast.  Edges are weighed so that each point has the same effective number of neighbours,
made symmetric, and laid out by forces: edges pull, random other points push.  The layout is fitted on the driver from
sample x neighbours edges, a bound that does not grow with the table.  All other rows are then placed, in tasks, among their
nearest sampled points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.density import Sample, _numbered, neighbour_lists

SAMPLE, NEIGHBOURS, ROUNDS, PUSHES = 5_000, 15, 200, 5
SPREAD, STEEP = 1.577, 0.895  # of 1 / (1 + SPREAD d^(2 STEEP)), which is near 1 up to a distance of about 0.1
BLOCK = 512


def closeness(far: np.ndarray) -> np.ndarray:
    """Weights of each point's neighbours: 1 for the nearest, falling so that they sum to the logarithm of their number."""
    rho, aim = far[:, :1], np.log2(max(far.shape[1], 2))
    low, high = np.full((len(far), 1), 1e-9), np.full((len(far), 1), 1e9)
    for _ in range(80):
        mid = np.sqrt(low * high)
        over = np.exp(-(far - rho) / mid).sum(1, keepdims=True) > aim
        high, low = np.where(over, mid, high), np.where(over, low, mid)
    return np.exp(-(far - rho) / np.sqrt(low * high))


def edges_of(near: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, weight) of the symmetric graph, each edge once: a + b - ab of its two directions."""
    n, k = near.shape
    a, b, w = np.repeat(np.arange(n), k), near.reshape(-1), weight.reshape(-1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    key, at = np.unique(low * n + high, return_inverse=True)
    total, both = np.bincount(at, w), np.ones(len(key))
    np.multiply.at(both, at, w)
    twice = np.bincount(at) == 2
    return key // n, key % n, np.where(twice, total - both, total)


def start(points: np.ndarray, dims: int) -> np.ndarray:
    """Principal components, ten wide."""
    x = points - points.mean(0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    y = np.zeros((len(x), dims))
    y[:, : min(dims, len(axes))] = x @ axes[:dims].T
    return y / max(np.abs(y).max(), 1e-12) * 10


def lay_out(points: np.ndarray, near: np.ndarray, far: np.ndarray, dims: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Coordinates of the points; the same for the same input."""
    rng, y = np.random.default_rng(seed), start(points, dims)
    y += rng.normal(0, 1e-4, y.shape)
    a, b, w = edges_of(near, closeness(far))
    for r in range(rounds):
        rate = 1 - r / rounds
        on = rng.random(len(w)) < w
        i, j = a[on], b[on]
        gap = y[i] - y[j]
        d2 = (gap**2).sum(1)
        pull = -2 * SPREAD * STEEP * np.maximum(d2, 1e-12) ** (STEEP - 1) / (1 + SPREAD * d2**STEEP)
        force = np.clip(pull[:, None] * gap, -4, 4)
        move = np.zeros_like(y)
        for c in range(dims):
            move[:, c] = np.bincount(i, force[:, c], len(y)) - np.bincount(j, force[:, c], len(y))
        i = np.concatenate([i, j])
        for _ in range(PUSHES):
            gap = y[i] - y[rng.integers(0, len(y), len(i))]
            d2 = (gap**2).sum(1)
            push = np.where(d2 > 0, 2 * STEEP / ((0.001 + d2) * (1 + SPREAD * d2**STEEP)), 0)
            force = np.clip(push[:, None] * gap, -4, 4)
            for c in range(dims):
                move[:, c] += np.bincount(i, force[:, c], len(y))
        y += rate * np.clip(move, -4, 4)
    return y


def project_neighbours(df: DataFrame, id_col: str, dims: int = 2, neighbours: int = NEIGHBOURS, sample: int = SAMPLE, seed: int = 0, vector: str = "embedding") -> DataFrame:
    """(id, x0 .. xk-1) of all rows.

    Rows whose vector is null, empty or holds a null or NaN have null coordinates; a table of one row lies at the origin.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    names = [f"x{c}" for c in range(dims)]
    schema = f"{id_col} {kind}, " + ", ".join(f"{c} double" for c in names)
    whole = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))
    rows = df.where(whole).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(sample).select(id_col, F.col(vector).cast("array<double>").alias("x")).collect()
    none = df.where(~F.coalesce(whole, F.lit(False))).select(id_col, *(F.lit(None).cast("double").alias(c) for c in names))
    if len(rows) < 2:
        return spark.createDataFrame([(r[0], *[0.0] * dims) for r in rows], schema).unionByName(none)
    ids, points = [r[0] for r in rows], np.array([r["x"] for r in rows])
    model = Sample(points, neighbours)
    y = lay_out(points, *neighbour_lists(spark, model), dims, seed=seed)
    fitted = spark.createDataFrame([(i, *c) for i, c in zip(ids, y.tolist(), strict=True)], schema)
    if len(rows) < sample:
        return fitted.unionByName(none)
    cast = spark.sparkContext.broadcast((points, (points**2).sum(1), y, min(neighbours, len(points))))

    def run(batches):
        points, squares, y, k = cast.value
        for batch in batches:
            column = batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            for at in range(0, len(x), BLOCK):
                a = x[at : at + BLOCK]
                d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + squares[None] - 2 * a @ points.T, 0))
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                w = closeness(np.sort(np.take_along_axis(d, near, 1), axis=1))
                order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
                near = np.take_along_axis(near, order, 1)
                placed = (y[near] * w[:, :, None]).sum(1) / w.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(a)), *(pa.array(np.ascontiguousarray(placed[:, c])) for c in range(dims))], names=[id_col, *names])

    rest = df.where(whole).join(fitted.select(id_col), id_col, "left_anti").select(id_col, F.col(vector).cast("array<double>").alias("x"))
    return fitted.unionByName(rest.mapInArrow(run, schema)).unionByName(none)


def trustworthiness(points: np.ndarray, y: np.ndarray, k: int, spark: SparkSession) -> float:
    """1 if each point's k nearest in the layout are its k nearest among the points, less the further off they are, by rank."""
    n = len(points)
    cast = spark.sparkContext.broadcast((Sample(points, k), Sample(y, k)))

    def run(rows):
        high, low = cast.value
        d = high.distances(rows)
        d[np.arange(len(rows)), rows] = -1
        rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable")  # the point itself has rank 0
        near, _ = low.nearest(rows)
        return pa.RecordBatch.from_arrays([pa.array([float(np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum())])], names=["penalty"])

    total = _numbered(spark, n, run, "penalty double").agg(F.sum("penalty")).first()[0]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * total
