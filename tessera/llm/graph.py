"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common


def neighbour_minimum(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest v of every u; one row a node, pre-aggregated before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def to_minimum(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (v, m) from every edge (u, v) and m of u.

    `least` comes from storage, not straight from its aggregation: an aggregate would tie the join to its
    partitioning, and Spark could no longer split the edges of a hub.
    """
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


class _Step:
    """Tables of one loop; each forgets those it was made of."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = common.stage(df, f"components-{name}")
        self.paths.append(path)
        return df

    def forget(self, spark, but: int = 1) -> None:
        """Drop all tables but the last `but`."""
        for path in self.paths[:-but]:
            common.drop(spark, path)
        self.paths = self.paths[-but:]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, from edges (a, b) of longs; root is the smallest node reachable.

    Every step is two grouped minima (pre-aggregated before the shuffle) and two joins of edges with one
    row a node.  Minima are stored before the join, so both its sides come straight from a shuffle and
    Spark may split the edges of a hub.  The number of steps grows with the logarithm of the nodes;
    each step's tables are dropped once the next one's are written.  Loops and repeated edges do not
    matter; no edges give no rows.
    """
    spark, step = edges.sparkSession, _Step()
    e = step.keep(_tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    last = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == last or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = mark
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = step.keep(neighbour_minimum(both).select("u", F.least("u", "m").alias("m")), "least")
        large = step.keep(_tidy(to_minimum(both.where("v > u"), least)), "large")
        step.forget(spark)
        least = step.keep(neighbour_minimum(large), "least")
        e = step.keep(_tidy(to_minimum(large, least).unionByName(least.select("u", F.col("m").alias("v")))), "edges")
        step.forget(spark)
