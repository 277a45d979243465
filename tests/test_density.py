"""Density clusters against plain forms of each step."""

import numpy as np
import pytest

from tessera.operators import density as dn


def points(seed, n=160, dims=2):
    rng = np.random.default_rng(seed)
    middles = rng.uniform(-20, 20, (4, dims))
    x = np.concatenate([m + rng.normal(0, 0.6, (n // 5, dims)) for m in middles] + [rng.uniform(-25, 25, (n - 4 * (n // 5), dims))])
    x[3] = x[7] = x[11]  # copies
    return x


def prim(x, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d + np.where(np.eye(len(x)), np.inf, 0), axis=1)[:, min_samples - 1] if min_samples else np.zeros(len(x))
    w = np.maximum(np.maximum(d, core[None]), core[:, None])
    inside, total, best = {0}, [], w[0].copy()
    while len(inside) < len(x):
        best[list(inside)] = np.inf
        i = int(best.argmin())
        total.append(best[i])
        inside.add(i)
        best = np.minimum(best, w[i])
    return np.sort(total), w


@pytest.mark.parametrize("dims,min_samples,neighbours", [(2, 0, 3), (2, 5, 5), (7, 4, 12), (1, 3, 2)])
def test_tree(spark, dims, min_samples, neighbours):
    x = points(dims + neighbours, dims=dims)
    sample = dn.Sample(x, max(neighbours, min_samples))
    near, far = dn.neighbour_lists(spark, sample)
    core = far[:, min_samples - 1] if min_samples else np.zeros(len(x))
    tree = dn.spanning_tree(spark, sample, core, near, far)
    want, _ = prim(x, min_samples)
    assert len(tree) == len(x) - 1 and np.allclose(tree[:, 0], want, atol=1e-6)
    assert len(set(dn.cut_at(tree, len(x), np.inf).tolist())) == 1


def slow_condensed(w, least):
    """Clusters by falling thresholds over the full matrix: recursive, with the same rules."""
    heights = sorted(set(w[np.triu_indices(len(w), 1)].tolist()), reverse=True)
    level = lambda h: 1 / h if h > 0 else np.finfo(float).max ** 0.25

    def parts(members, h):  # components of the edges below h
        left, out = set(members), []
        while left:
            todo = [left.pop()]
            part = set(todo)
            while todo:
                i = todo.pop()
                new = {j for j in left if w[i, j] < h}
                left -= new
                part |= new
                todo += new
            out.append(part)
        return out

    def grow(members, born, root):
        stable, alive, lost = 0.0, set(members), []
        for h in [h for h in heights]:
            split = parts(alive, h)
            if len(split) == 1:
                continue
            at = level(h)
            big = [p for p in split if len(p) >= least]
            gone = set().union(*[p for p in split if len(p) < least])
            stable += (at - born) * len(gone)
            lost += gone
            if not big:
                alive = set()
                break
            if len(big) == 1:
                alive = big[0]
                continue
            stable += (at - born) * sum(map(len, big))
            below = [grow(p, at, False) for p in big]
            total = sum(s for s, _ in below)
            if root or total > stable:
                return total, [c for _, cs in below for c in cs]
            return stable, [set(members)]
        return stable, [set(members)]

    return sorted(map(sorted, grow(range(len(w)), 0.0, True)[1]))


@pytest.mark.parametrize("seed", range(4))
def test_condensed(spark, seed):
    x = points(seed, 90)
    _, w = prim(x, 3)
    sample = dn.Sample(x, 6)
    near, far = dn.neighbour_lists(spark, sample)
    tree = dn.spanning_tree(spark, sample, far[:, 2], near, far)
    got = dn.condensed(tree, len(x), 8)
    groups = sorted(np.flatnonzero(got == c).tolist() for c in set(got.tolist()) - {dn.NOISE})
    assert groups == slow_condensed(w, 8)
    assert len(groups) >= 2 and (got == dn.NOISE).any()


def test_levels(spark):
    x = points(9, 400)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [float("nan"), 1.0])]
    frame = spark.createDataFrame(rows, "n long, embedding array<double>")
    whole = {r.n: r for r in dn.density_levels(frame, "n", {"fine": 8, "coarse": 60}).collect()}
    assert len(whole) == len(rows) and all(whole[i].fine == whole[i].coarse == dn.NOISE for i in (900, 901, 902))
    assert len({r.fine for r in whole.values()}) >= 5 and len({r.coarse for r in whole.values()}) >= 3
    part = {r.n: r for r in dn.density_levels(frame, "n", {"fine": 8}, sample=300).collect()}
    assert set(part) == set(whole)
    same = sum((whole[a].fine == whole[b].fine) == (part[a].fine == part[b].fine) for a in range(0, 320, 3) for b in range(1, 320, 7))
    assert same > 0.95 * len(range(0, 320, 3)) * len(range(1, 320, 7))
    assert dn.density_levels(frame.limit(0), "n", {"fine": 8}).count() == 0
    assert [r.fine for r in dn.density_levels(frame.limit(1), "n", {"fine": 8}).collect()] == [dn.NOISE]


def test_linkage_of_numbers_needs_no_sample(spark):
    """Rows beyond the sample, blocks of cells without end, repeats and odd values, against the gaps of the sorted numbers."""
    values = [float(i * i % 9973) * 7 for i in range(1500)] + [-1e7, 5e6, 5e6 + 12.5, 1e300, 1e300]
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate(values)] + [(9000, None), (9001, []), (9002, [float("nan")]), (9003, [None])], "id long, embedding array<double>")
    want, run, last = {9000: -1, 9001: -1, 9002: -1, 9003: -1}, [], None
    for v, i in [*sorted((v, i) for i, v in enumerate(values)), (float("inf"), None)]:
        if last is not None and v - last > 12.5:
            want |= dict.fromkeys(run, min(run))
            run = []
        run.append(i)
        last = v
    assert {r[0]: r[1] for r in dn.linkage(df, "id", 12.5, sample=100).collect()} == want
