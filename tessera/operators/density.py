"""Density clusters with noise: mutual reachability, a minimum spanning tree by Boruvka rounds, a condensed tree.

The tree is fitted on at most `sample` rows, picked by hash of id.  Every task compares its own rows with the sample's matrix, which
is broadcast: sample x dimensions numbers, by default 20,000 x 64 x 8 bytes = 10 MB.  Nearest neighbours are found once;
each round then takes every row's lightest edge out of its component from that list where the list proves it, and
compares with all rows otherwise, and joins each component to another by the lightest of its rows'.  The driver holds one edge a
sampled row.  All other rows go to the nearest centroid.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.cluster import assign, centroids
from tessera.operators.vector import norm

NOISE = -1
SAMPLE = 20_000
BLOCK = 256  # rows that a task compares with the sample at a time


class Sample:
    """Points of the sample by number, in order of a hash of their ids, and where the tree stands."""

    def __init__(self, points: np.ndarray, neighbours: int):
        self.points, self.neighbours = points, min(neighbours, max(len(points) - 1, 0))
        self.squares = (points**2).sum(1)

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Distances of numbered rows to all points; few dimensions by differences, many by inner products."""
        a = self.points[rows]
        if a.shape[1] <= 4:
            return np.sqrt(sum((a[:, i, None] - self.points[None, :, i]) ** 2 for i in range(a.shape[1])))
        return np.sqrt(np.maximum(self.squares[rows, None] + self.squares[None] - 2 * a @ self.points.T, 0))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, distances) of each row's nearest other points, ascending by distance, then number."""
        d = self.distances(rows)
        d[np.arange(len(rows)), rows] = np.inf
        k = self.neighbours
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        d[d > edge] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return order, np.take_along_axis(d, order, 1)


def _numbered(spark: SparkSession, n: int, run, schema: str) -> DataFrame:
    """run over blocks of the numbers 0 .. n-1, dealt over the cluster."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for at in range(0, len(numbers), BLOCK):
                yield run(numbers[at : at + BLOCK])

    return spark.range(0, n, 1, max(1, min(n // BLOCK, spark.sparkContext.defaultParallelism * 2))).mapInArrow(blocks, schema)


def neighbour_lists(spark: SparkSession, sample: Sample) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, distances) of every point's nearest others; neighbours x sample numbers come back."""
    cast = spark.sparkContext.broadcast(sample)

    def run(rows):
        at, d = cast.value.nearest(rows)
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(at.astype(np.int32))), pa.array(list(d))], names=["i", "at", "d"])

    rows = _numbered(spark, len(sample.points), run, "i long, at array<int>, d array<double>").toPandas().sort_values("i")
    cast.destroy()
    return np.stack(rows["at"].to_numpy()), np.stack(rows["d"].to_numpy())


def spanning_tree(spark: SparkSession, sample: Sample, core: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Edges (weight, a, b) of the minimum spanning tree of mutual reachability, ascending: max(core a, core b, distance)."""
    n = len(sample.points)
    label, edges = np.arange(n), []
    weight = np.maximum(np.maximum(far, core[near]), core[:, None])
    by = np.argsort(weight, axis=1, kind="stable")
    fixed = spark.sparkContext.broadcast((sample, core, np.take_along_axis(near, by, 1), np.take_along_axis(weight, by, 1), far[:, -1]))
    while len(edges) < n - 1:
        labels = spark.sparkContext.broadcast(label)

        def run(rows, labels=labels):
            (sample, core, near, weight, last), label = fixed.value, labels.value
            out = label[near[rows]] != label[rows, None]
            first = out.argmax(1)
            other, w = near[rows, first], weight[rows, first]
            # a point that the list leaves out is at least as far as the list's last, so a lighter edge is the lightest
            unsure = np.flatnonzero(~(out.any(1) & (w < last[rows])))
            if len(unsure):
                some = rows[unsure]
                d = np.maximum(np.maximum(sample.distances(some), core[None]), core[some, None])
                d[label[None] == label[some, None]] = np.inf
                other[unsure] = d.argmin(1)
                w[unsure] = d[np.arange(len(some)), other[unsure]]
            low, high = np.minimum(rows, other), np.maximum(rows, other)
            return pa.RecordBatch.from_arrays([pa.array(label[rows]), pa.array(w), pa.array(low), pa.array(high)], names=["c", "w", "a", "b"])

        each = _numbered(spark, n, run, "c long, w double, a long, b long").groupBy("c").agg(F.min(F.struct("w", "a", "b")).alias("e"))
        chosen = sorted((r["e"]["w"], r["e"]["a"], r["e"]["b"]) for r in each.collect())  # one a component
        labels.destroy()
        before = len(edges)
        root = Forest(n, label)
        edges += [e for e in chosen if root.join(e[1], e[2])]
        label = root.labels()
        if len(edges) == before:
            raise RuntimeError("no component could be joined")
    fixed.destroy()
    return np.array(sorted(edges), float).reshape(-1, 3)


class Forest:
    """Union-find over numbers; a component's name is its smallest member."""

    def __init__(self, n: int, label: np.ndarray | None = None):
        self.up = (np.arange(n) if label is None else label).tolist()

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(int(a)), self.find(int(b))
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


def cut_at(tree: np.ndarray, n: int, height: float) -> np.ndarray:
    """Single linkage: components of the edges up to a height, named by their smallest number."""
    forest = Forest(n)
    for w, a, b in tree:
        if w <= height:
            forest.join(a, b)
    return forest.labels()


def condensed(tree: np.ndarray, n: int, least: int) -> np.ndarray:
    """Cluster of each point, numbered from 0 by smallest member; NOISE for points in none.

    The tree is cut from the top, joins of the same height at once.  A split is real if two sides or more have `least` points; the
    points of smaller sides fall out of their cluster at that height.  A cluster's stability is the sum, over its points, of 1/height where they
    leave it less 1/height where it began.  Clusters are kept where they are more stable than those below them together; the
    root is kept only if it never splits.
    """
    if n < least or n < 2:
        return np.full(n, NOISE)
    forest, node, size = Forest(n), list(range(n)), [1] * n
    left, right, height = [], [], []
    for w, a, b in tree:  # the dendrogram: node n + i joins two
        a, b = forest.find(int(a)), forest.find(int(b))
        left.append(node[a])
        right.append(node[b])
        height.append(w)
        forest.join(a, b)
        node[min(a, b)] = n + len(height) - 1
        size.append(size[left[-1]] + size[right[-1]])
    level = lambda h: 1 / h if h > 0 else np.finfo(float).max ** 0.25  # noqa: E731  copies of a point part last
    born, stable, children, of = [0.0], [0.0], [[]], {2 * n - 2: 0}
    fell = np.full(n, -1)  # the cluster that a point falls out of
    for i in range(2 * n - 2, n - 1, -1):
        if i not in of:
            continue
        cluster, at = of[i], level(height[i - n])
        sides, todo = [], [left[i - n], right[i - n]]
        while todo:  # joins of the same height are one split
            x = todo.pop()
            if x >= n and height[x - n] == height[i - n]:
                todo += (left[x - n], right[x - n])
            else:
                sides.append(x)
        big = [s for s in sides if size[s] >= least]
        for s in sides:
            if size[s] < least:
                stable[cluster] += (at - born[cluster]) * size[s]
                under = [s]
                while under:
                    x = under.pop()
                    if x < n:
                        fell[x] = cluster
                    else:
                        under += (left[x - n], right[x - n])
        for s in big:
            of[s] = cluster
            if len(big) > 1:
                stable[cluster] += (at - born[cluster]) * size[s]
                of[s] = len(born)
                children[cluster].append(len(born))
                born.append(at)
                stable.append(0.0)
                children.append([])
    for x, cluster in of.items():
        if x < n:
            fell[x] = cluster
    best, kept = list(stable), [True] * len(born)
    for c in range(len(born) - 1, -1, -1):
        below = sum(best[k] for k in children[c])
        if children[c] and (c == 0 or below > stable[c]):
            best[c], kept[c] = below, False
    chosen = {}
    for c in range(len(born)):  # parents come before children
        chosen.setdefault(c, c if kept[c] else None)
        for k in children[c]:
            if chosen[c] is not None:
                chosen[k] = chosen[c]
    names, out = {}, np.full(n, NOISE)
    for i in range(n):
        if (c := chosen[int(fell[i])]) is not None:
            out[i] = names.setdefault(c, len(names))
    return out


def _fit(df: DataFrame, id_col: str, min_samples: int, neighbours: int, sample: int, vector: str):
    """(ids, sample, tree) of the rows that are fitted on."""
    spark = df.sparkSession
    some = df.where((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = some.select(id_col, F.col(vector).cast("array<double>").alias("x")).collect()  # `sample` rows at most
    ids = [r[0] for r in rows]
    if len(ids) < 2:
        return ids, None, np.zeros((0, 3))
    points = Sample(np.array([r["x"] for r in rows]), max(neighbours, min_samples))
    near, far = neighbour_lists(spark, points)
    core = far[:, min(min_samples, points.neighbours) - 1] if min_samples > 0 else np.zeros(len(ids))
    return ids, points, spanning_tree(spark, points, core, near, far)


def linkage(df: DataFrame, id_col: str, height: float, sample: int = SAMPLE, vector: str = "embedding") -> DataFrame:
    """(id, cluster): single linkage cut at a height; a cluster is named by its smallest id.

    Vectors of one dimension are linked exactly, all of them; of more, rows beyond the sample go to the cluster of the nearest
    centroid.  Rows whose vector is null, empty or holds a null or NaN are NOISE.
    """
    if df.agg(F.max(F.size(vector))).first()[0] == 1:
        return _linked_line(df, id_col, height, vector)
    ids, _, tree = _fit(df, id_col, 0, 8, sample, vector)
    label = cut_at(tree, len(ids), height)
    least: dict = {}
    for i, c in zip(ids, label.tolist(), strict=True):
        least[c] = min(i, least.get(c, i))
    return _spread(df, id_col, {"cluster": [least[c] for c in label.tolist()]}, ids, sample, vector)


def _linked_line(df: DataFrame, id_col: str, height: float, vector: str) -> DataFrame:
    """Single linkage of numbers: cells of half the height hold together, neighbouring ones if the gap between them allows.

    Gaps are summed up within blocks of 1,024 cells, then over one row a block.
    """
    x = F.try_element_at(vector, F.lit(1)).cast("double")
    whole = lambda q: F.when(F.abs(q) < 2.0**52, F.floor(q).cast("double")).otherwise(q)
    good = (F.size(vector) > 0) & x.isNotNull() & ~F.isnan(x)
    rows = df.select(id_col, F.when(good, x).alias("_x")).withColumn("_cell", whole(F.col("_x") * 2 / F.lit(float(height))) if height > 0 else F.col("_x"))
    cells = rows.where("_cell IS NOT NULL").groupBy("_cell").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.min(id_col).alias("_least"))
    cells = cells.withColumn("_block", whole(F.col("_cell") / 1024))
    apart = lambda order: F.coalesce(F.col("_low") - F.lag("_high").over(order) > height, F.lit(False)).cast("long")
    inside = Window.partitionBy("_block").orderBy("_cell")
    cells = cells.withColumn("_apart", apart(inside)).withColumn("_run", F.sum("_apart").over(inside))
    blocks = cells.groupBy("_block").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_run").alias("_runs"))
    line = Window.orderBy("_block")
    blocks = blocks.withColumn("_apart", apart(line)).select("_block", (F.sum(F.col("_apart") + F.col("_runs")).over(line) - F.col("_runs")).alias("_base"))
    cells = cells.join(blocks, "_block").select("_cell", "_least", (F.col("_base") + F.col("_run")).alias("_run"))
    named = cells.join(cells.groupBy("_run").agg(F.min("_least").cast("long").alias("cluster")), "_run").select("_cell", "cluster")
    return rows.join(named, "_cell", "left").select(id_col, F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


def density_levels(df: DataFrame, id_col: str, sizes: Mapping[str, int], min_samples: int = 5, neighbours: int = 16, sample: int = SAMPLE, vector: str = "embedding") -> DataFrame:
    """(id, a column a level): density clusters of at least so many points, NOISE for points in none.

    One tree serves all levels.  Rows beyond the sample go to the nearest centroid of each level; where a level has no
    cluster, and for rows without a whole vector, they are NOISE.
    """
    ids, _, tree = _fit(df, id_col, min_samples, neighbours, sample, vector)
    return _spread(df, id_col, {level: condensed(tree, len(ids), least).tolist() for level, least in sizes.items()}, ids, sample, vector)


def _spread(df: DataFrame, id_col: str, levels: Mapping[str, list], ids: list, sample: int, vector: str) -> DataFrame:
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, " + ", ".join(f"{level} long" for level in levels)
    fitted = spark.createDataFrame(list(zip(ids, *levels.values(), strict=True)), schema)
    if len(ids) < sample:  # all rows with a vector are in it
        return df.select(id_col).join(fitted, id_col, "left").select(id_col, *(F.coalesce(c, F.lit(NOISE)).alias(c) for c in levels))
    known, rest = df.select(id_col, vector).join(fitted, id_col), df.select(id_col, vector).join(fitted, id_col, "left_anti")
    out = rest.select(id_col)
    for level in levels:
        dims = len(df.where(F.size(vector) > 0).select(vector).first()[0])
        placed = assign(rest.where(norm(vector).isNotNull()), centroids(known.where(F.col(level) != NOISE), level, dims, vector), level, id_col, vector)
        out = out.join(placed, id_col, "left").withColumn(level, F.coalesce(level, F.lit(NOISE)))
    return fitted.unionByName(out)


def core_distances(df: DataFrame, id_col: str, min_samples: int, sample: int = SAMPLE, vector: str = "embedding") -> DataFrame:
    """(id, core): the distance to the min_samples-th nearest other row, of the sample."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = df.where(F.size(vector) > 0).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(id_col, F.col(vector).cast("array<double>").alias("x")).collect()
    if len(rows) < 2:
        return spark.createDataFrame([], f"{id_col} {kind}, core double")
    points = Sample(np.array([r["x"] for r in rows]), min_samples)
    _, far = neighbour_lists(spark, points)
    return spark.createDataFrame(list(zip([r[0] for r in rows], far[:, -1].tolist(), strict=True)), f"{id_col} {kind}, core double")
