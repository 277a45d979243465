"""The neighbour projection: neighbourhoods kept, rows outside the sample, hard rows."""

import numpy as np
import pytest

from tessera.operators import layout as lo
from tessera.operators.density import Sample, neighbour_lists


def points(n=300, dims=20, groups=5, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 4, (groups, dims))
    return middles[np.arange(n) % groups] + rng.normal(0, 1, (n, dims))


def test_closeness():
    far = np.array([[0.0, 1.0, 2.0, 3.0], [5.0, 5.0, 5.0, 9.0], [1.0, 1.0, 1.0, 1.0]])
    w = lo.closeness(far)
    assert np.allclose(w[:, 0], 1) and np.isclose(w[0].sum(), 2, atol=1e-6) and (np.diff(w, axis=1) <= 1e-12).all()
    a, b, w = lo.edges_of(np.array([[1], [0], [0]]), np.array([[0.5], [0.4], [0.3]]))
    assert list(zip(a.tolist(), b.tolist(), np.round(w, 9).tolist())) == [(0, 1, 0.7), (0, 2, 0.3)]


def slow_trust(x, y, k):
    n, total = len(x), 0
    for i in range(n):
        rank = {int(j): r for r, j in enumerate(sorted(range(n), key=lambda j: (-1 if j == i else ((x[i] - x[j]) ** 2).sum(), j)))}
        near = sorted((j for j in range(n) if j != i), key=lambda j: (((y[i] - y[j]) ** 2).sum(), j))[:k]
        total += sum(max(rank[j] - k, 0) for j in near)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * total


def test_neighbours_stay(spark):
    x = points()
    y = lo.lay_out(x, *neighbour_lists(spark, Sample(x, 15)), 2)
    trust = lo.trustworthiness(x, y, 10, spark)
    assert trust == pytest.approx(slow_trust(x, y, 10))
    assert trust > lo.trustworthiness(x, lo.start(x, 2), 10, spark) and trust > 0.8  # better than principal components


def test_rows(spark):
    x = points(400)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [float("nan")] * 20)]
    frame = spark.createDataFrame(rows, "n long, embedding array<double>")
    got = {r.n: r for r in lo.project_neighbours(frame, "n", sample=250).collect()}
    assert len(got) == len(rows) and all(got[i].x0 is None for i in (900, 901, 902))
    y = np.array([[got[i].x0, got[i].x1] for i in range(400)])
    middle = np.array([y[np.arange(400) % 5 == g].mean(0) for g in range(5)])
    nearest = ((y[:, None] - middle[None]) ** 2).sum(2).argmin(1)
    assert (nearest == np.arange(400) % 5).mean() > 0.97
    assert lo.project_neighbours(frame.limit(0), "n").count() == 0
    assert [tuple(r) for r in lo.project_neighbours(frame.limit(1), "n", 3).collect()] == [(0, 0.0, 0.0, 0.0)]
