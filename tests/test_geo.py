"""Simplification of rings against its definition."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import geo


def distance(p, a, b):
    chord = b - a
    t = np.clip((p - a) @ chord / (chord @ chord), 0, 1) if chord @ chord else 0.0
    return float(np.hypot(*(p - a - t * chord)))


def test_kept_corners():
    rng = np.random.default_rng(3)
    for n in (4, 5, 30, 200):
        for tolerance in (0.0, 0.05, 0.4):
            angle = np.sort(rng.uniform(0, 2 * np.pi, n - 1))
            x = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(0.8, 1.2, (n - 1, 1))
            x = np.concatenate([x, x[:1]])
            keep = np.flatnonzero(geo._kept(x, tolerance))
            assert keep[0] == 0 and keep[-1] == n - 1
            for a, b in zip(keep[:-1], keep[1:], strict=True):
                assert all(distance(x[i], x[a], x[b]) <= tolerance + 1e-12 for i in range(a + 1, b))


def test_hard_polygons(spark):
    square, tiny = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (1.01, 1.0), (1.01, 1.01), (1.0, 1.0)]
    rows = [(1, [square, tiny]), (2, [tiny]), (3, []), (4, None), (5, [square[:2] + square[:1]]), (6, [square[::-1]])]
    frame = spark.createDataFrame(rows, "id int, rings array<array<struct<lng:double,lat:double>>>")
    got = {r.id: r.rings for r in frame.select("id", geo.simplify(F.col("rings"), 0.5).alias("rings")).collect()}
    assert [[len(ring) for ring in got[i]] for i in (1, 2, 3, 5, 6)] == [[5], [4], [], [3], [5]] and got[4] is None
    measured = {r.id: (round(r.a, 9), r.m and tuple(r.m)) for r in frame.where("size(rings) > 0").select("id", geo.area(F.col("rings")).alias("a"), geo.weighted_centroid(F.col("rings")).alias("m")).collect()}
    assert measured[6] == (16.0, (2.0, 2.0)) and measured[1][0] == 16 - 0.00005 and measured[5][0] == 0.0


def test_rings_take_their_steps_together():
    """Corners that stay, of many rings at once, are those of a recursion over each; it takes a step for each level, not for each chord."""
    rng = np.random.default_rng(4)
    rings = [np.concatenate([r, r[:1]]) for r in (rng.integers(0, 9, (int(n), 2)).astype(float) for n in rng.integers(3, 40, 300))]

    def kept(r, a, b, stays):
        if b - a >= 2:
            chord, inner = r[b] - r[a], r[a + 1 : b] - r[a]
            size = (chord * chord).sum()
            along = np.clip((inner * chord).sum(1) / size, 0, 1) if size else np.zeros(len(inner))
            d = np.hypot(*(inner - along[:, None] * chord).T)
            if d.max() > 1.5:
                m = a + 1 + int(d.argmax())
                stays.add(m)
                kept(r, a, m, stays)
                kept(r, m, b, stays)
        return stays

    sizes = np.array([len(r) for r in rings])
    flat = np.concatenate(rings)
    got = geo._kept_of_all(flat[:, 0], flat[:, 1], np.cumsum(sizes) - sizes, sizes, 1.5)
    want = []
    for r in rings:
        far, last = int(((r - r[0]) ** 2).sum(1).argmax()), len(r) - 1
        stays = kept(r, 0, far, {0, far, last}) | kept(r, far, last, set())
        want += [i in stays for i in range(len(r))]
    assert got.tolist() == want
