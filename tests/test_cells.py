"""The cell index against brute force: filters, ties, vectors without a direction, uneven cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.cells import ASTRAY, Cells
from tessera.streaming.streams import shared


def brute(rows, queries, k, ok=lambda r: True):
    out = []
    for q, v in queries:
        scored = []
        for r in rows:
            if r[0] != q and ok(r) and r[1] and any(r[1]) and any(v):
                s = sum(a * b for a, b in zip(r[1], v, strict=True)) / math.hypot(*r[1]) / math.hypot(*v)
                scored.append((-round(s, 9), r[0]))
        out += [(q, i, p) for p, (_, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("probes", [1, 3, 100])
def test_exact(spark, probes):
    rng = random.Random(probes)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(6)], i % 9) for i in range(200)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0], 1) for i in range(150)] + [(2000, None, 1), (2001, [0.0] * 6, 1)]
    frame = spark.createDataFrame(rows, "n int, embedding array<float>, label int")
    index = Cells.build(frame, shared(spark, "cells"), "n", 12, ["label"], sample=150)
    assert index.rows().count() == len(rows) and index.rows().where(F.col("cell") == ASTRAY).count() == 2
    asked = [(r[0], r[1]) for r in rows[:200:10]] + [(1003, rows[203][1]), (7777, [0.0, 0.0, 0.0, 0.0, 1.0, -1.0]), (8888, [0.0] * 6)]
    queries = spark.createDataFrame(asked, "query int, vector array<float>")
    single = lambda v: v and np.array(v, np.float32).tolist()  # noqa: E731  as the column holds them
    want = brute([(i, single(v), n) for i, v, n in rows], [(q, single(v)) for q, v in asked], 5)
    got = index.search(queries, 5, shared(spark, "search"), probes, exact=True)
    assert sorted(got.columns) == ["id", "label", "place", "query", "similarity"]
    assert sorted((r["query"], r["id"], r["place"]) for r in got.collect()) == want
    few = index.search(queries, 5, shared(spark, "search"), probes, where=F.col("label") == 8)
    counts = {r["query"]: r["count"] for r in few.groupBy("query").count().collect()}
    assert set(counts.values()) == {5} and len(counts) == len(asked) - 1  # widened until they have k
    none = index.search(queries, 5, shared(spark, "search"), probes, where=F.col("label") == 99)
    assert none.count() == 0


def test_empty(spark):
    frame = spark.createDataFrame([], "n int, embedding array<float>")
    index = Cells.build(frame, shared(spark, "cells"), "n", 4)
    assert index.search(spark.createDataFrame([(1, [1.0])], "query int, vector array<float>"), 3, shared(spark, "search")).count() == 0
