"""A stored vector index of coarse cells, searched by widening probes.

Cells are k-means centroids of directions, fitted on a bounded sample; every row is stored in the cell of its nearest
centroid with the columns that filters need.  A search ranks cells by their centroid's similarity, reads the nearest
ones, and doubles the number read for every query that a filter has left short of k rows.  Each cell knows its
radius, so a search can also go on until no unread cell can hold a better row: then it is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.operators import blocks
from tessera.operators.relational import small, top_m_per_group
from tessera.operators.vector import dot, norm

ASTRAY = -1  # the cell of rows without a direction: null and zero vectors
SLACK = 1e-6  # of angles, for rounding


def _unit(vector: Column) -> Column:
    """The vector at length 1, in doubles; null for null and zero vectors."""
    size = norm(vector)
    # the length stands outside the lambda, which would work it out again for each dimension
    return F.when(size > 0, F.zip_with(vector, F.array_repeat(size, F.size(vector)), lambda x, n: x.cast("double") / n))


@dataclass(frozen=True)
class Cells:
    """An index in a folder that the cluster shares: rows by cell, and one row a cell."""

    spark: SparkSession
    path: str
    schema: StructType | None = None  # of the rows; read from the files unless given, which an empty index has none of

    def rows(self) -> DataFrame:
        return (self.spark.read.schema(self.schema) if self.schema else self.spark.read).parquet(f"{self.path}/rows")

    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    @staticmethod
    def build(df: DataFrame, path: str, id_col: str, cells: int, keep: Sequence[str] = (), sample: int = 50_000, seed: int = 5, vector: str = "embedding") -> Cells:
        """Write the index of all rows under a new path; `keep` names further columns, for filters and results.

        At most `sample` rows, by hash of id, are used to fit the cells.  Centroids (cells x dimensions) are held by the driver
        and broadcast.  Fewer rows than cells make fewer cells; an empty table makes an empty index.
        """
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = df.sparkSession
        unit = df.select(F.col(id_col).alias("id"), *(F.col(c) for c in keep), _unit(F.col(vector)).alias("unit"))
        placed = unit.where("unit IS NOT NULL").withColumn("v", array_to_vector("unit"))
        some = placed.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v")
        rows = unit.withColumn("cell", F.lit(ASTRAY))
        if not some.isEmpty():
            model = KMeans(k=cells, distanceMeasure="cosine", seed=seed, maxIter=15, featuresCol="v", predictionCol="cell").fit(some)
            rows = model.transform(placed).drop("v").unionByName(unit.where("unit IS NULL").withColumn("cell", F.lit(ASTRAY)))
            centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        else:
            centers = []
        rows.hint("rebalance", "cell").write.option("compression", "zstd").partitionBy("cell").parquet(f"{path}/rows")
        stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
        middle = spark.createDataFrame(centers, "cell int, centroid array<double>")
        away = F.acos(F.least(dot("unit", "centroid") / norm("centroid"), F.lit(1.0)))
        ball = stored.where(F.col("cell") != ASTRAY).join(F.broadcast(middle), "cell").groupBy("cell").agg(F.max(away).alias("radius"), F.count(F.lit(1)).alias("members"))
        middle.join(ball, "cell").select("cell", _unit(F.col("centroid")).alias("centroid"), "radius", "members").coalesce(1).write.parquet(f"{path}/cells")
        return Cells(spark, path, rows.schema)

    def search(self, queries: DataFrame, k: int, stage: str, probes: int = 4, where: Column | None = None, exact: bool = False, exclude_self: bool = True, floor: float | None = None) -> DataFrame:
        """(query, id, kept columns, similarity, place): the k most similar rows of each (query, vector) row, ties by id.

        Only rows that pass `where` count.  probes: cells read at first; queries short of k rows read twice as many, and so on,
        until they have k or have read all.  With `exact`, also while an unread cell may hold a better row.  `floor`
        leaves rows below a similarity out, of what is found.  Queries and rows without a direction find and are found by none.
        stage: a fresh folder for what the rounds find (k rows a query).
        """
        unit = queries.select("query", _unit(F.col("vector")).alias("_q")).where("_q IS NOT NULL")
        near = unit.crossJoin(small(self.centroids())).withColumn("angle", F.acos(F.greatest(F.least(dot("_q", "centroid"), F.lit(1.0)), F.lit(-1.0))))
        reach = F.cos(F.greatest(F.col("angle") - F.col("radius") - SLACK, F.lit(0.0)))  # the best similarity that the cell can hold
        order = Window.partitionBy("query").orderBy("angle", "cell")
        plan = near.select("query", "cell", F.row_number().over(order).alias("turn"), F.max(reach).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("beyond"))
        plan.write.parquet(f"{stage}/plan")
        plan = self.spark.read.parquet(f"{stage}/plan")
        total, asked = plan.agg(F.max("turn"), blocks.parts(F.count_if(F.col("turn") == 1), blocks.QUERIES)).first()
        total = total or 0
        rows = self.rows().where(F.col("cell") != ASTRAY)
        rows = rows.where(where) if where is not None else rows
        # rows of a cell meet the queries that read it in blocks of bounded size
        held = small(self.centroids().select("cell", blocks.parts(F.col("members"), blocks.ROWS).alias("_n")))
        rows = rows.join(held, "cell").withColumn("_a", blocks.part_of("id", F.col("_n"))).drop("_n").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
        rows = rows.withColumnRenamed("unit", "_v").withColumn("_vn", F.lit(1.0))
        unit = unit.withColumn("_qn", F.lit(1.0)).withColumn("_b", blocks.part_of("query", F.lit(asked)))
        best, low, high, open_ = None, 0, probes, None
        rank = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
        while True:
            turn = plan.where((F.col("turn") > low) & (F.col("turn") <= high))
            turn = turn if open_ is None else turn.join(small(open_), "query", "left_semi")
            turn = turn.select("query", "cell").join(unit, "query").join(held, "cell").withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
            met = blocks.best_in_blocks(turn, rows, ["cell", "_a", "_b"], k, exclude_self)
            met = top_m_per_group(met, ["query"], [F.desc("similarity"), F.asc("id")], k)
            met = met if best is None else met.unionByName(best.drop("place"))
            met.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k).write.parquet(f"{stage}/{high}")
            best = self.spark.read.parquet(f"{stage}/{high}")
            if high >= total:
                break
            have = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"))
            ahead = plan.where(F.col("turn") == high).select("query", "beyond").join(have, "query", "left")
            short = F.coalesce("n", F.lit(0)) < k
            open_ = ahead.where(short | (F.col("least") <= F.col("beyond")) if exact else short).select("query")
            if open_.isEmpty():
                break
            low, high = high, high * 2
        return best if floor is None else best.where(F.col("similarity") >= floor)


def margin_match(df: DataFrame, references: Cells, id_col: str, threshold: float, margin: float, stage: str, vector: str = "embedding") -> DataFrame:
    """(id, reference, score) as vector.margin_match(), over an index of any number of references: each row reads the cells
    that can hold its two best, never all references.  A row and a reference of one id are two things.
    """
    two = references.search(df.select(F.col(id_col).alias("query"), F.col(vector).alias("vector")), 2, stage, exact=True, exclude_self=False)
    best = two.groupBy("query").agg(F.min_by(F.struct(F.col("id").alias("reference"), F.col("similarity").alias("score")), "place").alias("first"), F.min("similarity").alias("other"), F.count(F.lit(1)).alias("n"))
    good = (F.col("first.score") >= threshold) & ((F.col("n") == 1) | (F.col("first.score") - F.col("other") >= margin))
    return best.where(good).select(F.col("query").alias(id_col), "first.reference", "first.score")
