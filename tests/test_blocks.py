"""Similarities by blocks against brute force: many blocks, ties, ids on both sides, vectors without a direction."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.operators import vector as vec
from tessera.operators.cells import Cells
from tessera.streaming.streams import shared


def table(spark, n, dims=8):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(5000 + i, [1.0, -2.0] * (dims // 2)) for i in range(150)] + [(9000, [0.0] * dims), (9001, None)]
    return spark.createDataFrame(rows, "n long, embedding array<float>")


def brute(spark, df, queries, k):
    q = queries.select("query", F.col("vector").alias("_q"))
    pairs = df.crossJoin(F.broadcast(q)).where("n <> query").select("query", "n", vec.cosine("embedding", "_q").alias("similarity"))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "n"))
    return sorted(tuple(r) for r in pairs.withColumn("place", place).where(F.col("place") <= k).select("query", "n", "place", "similarity").collect())


@pytest.mark.parametrize("rows,queries", [(16_384, 8_192), (40, 7)])
def test_nearest(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(blocks, "ROWS", rows)
    monkeypatch.setattr(blocks, "QUERIES", queries)
    df = table(spark, 120)
    asked = df.where("n % 10 = 0 AND n < 9000").select(F.col("n").alias("query"), F.col("embedding").alias("vector"))
    got = vec.nearest(df, asked, "n", 12).select("query", "n", "place", "similarity")
    assert sorted(map(tuple, got.collect())) == brute(spark, df, asked, 12)


def test_hyperplanes_as_expressions(spark):
    df = table(spark, 40)
    got = {(r["n"], r["t"]): r["key"] for r in vec.hyperplane_tables(df, "n", 8, 3, 4).collect()}
    rng = random.Random(7)
    for t in range(3):
        planes = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
        for r in df.collect():
            want = sum(1 << b for b, p in enumerate(planes) if np.dot(r["embedding"], p) >= 0) if r["embedding"] else 0
            assert got[r["n"], t] == want


def test_no_pair_of_a_query_and_a_row_is_a_row_of_the_plan(spark):
    """Searches and brute force carry blocks and the k best of each, so no join makes as many rows as there are pairs."""
    df = table(spark, 120)
    asked = df.where("n % 10 = 0").select(F.col("n").alias("query"), F.col("embedding").alias("vector"))
    index = vec.hyperplane_tables(df, "n", 8, 4, 8)
    plans = [vec.nearest(df, asked, "n", 5), vec.approximate_knn(index, df, asked.select(F.col("query").alias("n")), "n", 5)]
    for plan in plans:
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in text and "Join Cross" not in text
    assert Cells.build(df, shared(spark, "cells"), "n", 4).search(asked, 5, shared(spark, "search"), exact=True).count() == 5 * asked.where("query < 9000").count()
