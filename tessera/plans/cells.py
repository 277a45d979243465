"""Vector search through the stored cell index, which a session builds once for a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import density, layout
from tessera.operators import vector as vec
from tessera.operators.cells import Cells, margin_match
from tessera.registry import query
from tessera.sources.tables import Tables
from tessera.streaming.streams import shared

CELLS, PROBES = 32, 22  # these vectors hardly cluster: recall of 0.9 takes two thirds of the cells
_built: dict[tuple[str, str], Cells] = {}


def stored(spark: SparkSession, d: str) -> Cells:
    """The session's index of a folder's vectors."""
    key = spark.sparkContext.applicationId, d
    if key not in _built:
        _built[key] = Cells.build(Tables(spark, d).embeddings, shared(spark, "cells"), "vec_id", CELLS, ["label"])
    return _built[key]


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


_FILTER = "label IN (1, 4, 7)"


def _exact(where: str = "true", floor: str = "true") -> str:
    return f"""
SELECT query, id, round(s, 6) AS similarity, p::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS p FROM
(SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND e.{where})) WHERE p <= 10 AND {floor}""".replace("e.true", "true")


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "place")


@query("cells_topk", _exact())
def cells_topk(spark, d):
    """Exact: cells are read until none that is left can hold a better row."""
    return _shown(stored(spark, d).search(_queries(spark, d), 10, shared(spark, "search"), exact=True))


@query("cells_filtered", _exact(_FILTER, "s >= 0.3"))
def cells_filtered(spark, d):
    return _shown(stored(spark, d).search(_queries(spark, d), 10, shared(spark, "search"), where=F.expr(_FILTER), exact=True, floor=0.3))


@query("cells_starved", _exact("label = 3 AND e.vec_id % 7 = 0"))
def cells_starved(spark, d):
    """A filter so narrow that probes widen to all cells before the k rows are found, if they are."""
    return _shown(stored(spark, d).search(_queries(spark, d), 10, shared(spark, "search"), probes=1, where=F.expr("label = 3 AND id % 7 = 0"), exact=True))


@query("cells_recall", "SELECT kind, count(*) AS queries, true AS good FROM embeddings, (VALUES ('plain'), ('filtered')) k(kind) WHERE vec_id % 100 = 0 GROUP BY kind")
def cells_recall(spark, d):
    """Whether the mean recall at 10 of approximate searches is 0.9 or more, without and with a filter."""
    e, q, index = Tables(spark, d).embeddings, _queries(spark, d), stored(spark, d)
    out = None
    for kind, where in (("plain", "true"), ("filtered", _FILTER)):
        near = index.search(q, 10, shared(spark, "search"), probes=PROBES, where=F.expr(where)).select("query", "id", F.lit(1).alias("hit"))
        best = vec.nearest(e.where(where), q, "vec_id", 10, stage=shared(spark, "nearest")).select("query", F.col("vec_id").alias("id"))
        each = best.join(near, ["query", "id"], "left").groupBy("query").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
        row = each.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("good"))
        out = row if out is None else out.unionByName(row)
    return out


_LINKED = "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY run) AS cluster FROM (SELECT c_custkey, sum(gap) OVER (ORDER BY c_acctbal, c_custkey) AS run FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal - lag(c_acctbal) OVER (ORDER BY c_acctbal, c_custkey) > {} THEN 1 ELSE 0 END AS gap FROM customer))"


@query("density_linkage", _LINKED.format(12.5))
def density_linkage(spark, d):
    """Single linkage of balances cut at a gap: the spanning tree's answer, which SQL can state in one dimension."""
    rows = Tables(spark, d).customer.select("c_custkey", F.array("c_acctbal").alias("embedding"))
    return density.linkage(rows, "c_custkey", 12.5)


@query("density_cores", """
SELECT vec_id, round(d, 4) AS core FROM (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS d,
row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE r = 5""")
def density_cores(spark, d):
    return density.core_distances(Tables(spark, d).embeddings, "vec_id", 5).select("vec_id", F.round("core", 4).alias("core"))


@query("density_levels")
def density_levels(spark, d):
    """Density clusters at five granularities of one tree; -1 is noise."""
    return density.density_levels(Tables(spark, d).embeddings, "vec_id", {"finest": 3, "fine": 5, "middle": 10, "coarse": 20, "coarsest": 40})


@query("neighbour_projection")
def neighbour_projection(spark, d):
    """(vec_id, x0, x1) of all vectors."""
    return layout.project_neighbours(Tables(spark, d).embeddings, "vec_id")


@query("margin_match_cells", """
WITH s AS (SELECT e.vec_id, r.vec_id AS reference, list_cosine_similarity(e.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings r WHERE e.vec_id % 10 = 0 AND r.vec_id % 10 > 0),
t AS (SELECT *, row_number() OVER w AS p, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, reference))
SELECT vec_id, reference, round(score, 6) AS score FROM t WHERE p = 1 AND score >= 0.3 AND score - second >= 0.02""")
def margin_match_cells(spark, d):
    """Every tenth vector against all others as references, through an index of these."""
    e = Tables(spark, d).embeddings
    index = Cells.build(e.where("vec_id % 10 > 0"), shared(spark, "cells"), "vec_id", CELLS)
    out = margin_match(e.where("vec_id % 10 = 0"), index, "vec_id", 0.3, 0.02, shared(spark, "search"))
    return out.select("vec_id", "reference", F.round("score", 6).alias("score"))
