"""SimHash against a bit-by-bit fingerprint and all-pairs linking on small tables."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm import common, graph
from tessera.llm import simhash as sh
from tessera.llm.graph import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(nodes, 2):
        if near(a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for t in ["", "  \n", "one", "One Two", "a b c", "É È é Ö x y\x0bz\x1cq", "the cat " * 50, "w1 w2 w3 w4 w5 W6"]:
        assert sh.fingerprint(t.encode()) == slow_fingerprint(t), t
    long = " ".join(str(i % 977) for i in range(sh.BLOCK + 500))
    assert sh.fingerprint(long.encode()) == slow_fingerprint(long)


def test_masks_cover():
    for r in (0, 1, 2, 3):
        masks = sh.covering_masks(r)
        assert len(masks) == 2 ** (r + 1) - 1
        for bits in combinations(range(0, 64, 3 if r > 2 else 1), r):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("radius", [1, 2])
def test_links(spark, radius):
    rng = random.Random(3)
    fps = {0}
    for _ in range(12):
        seed = rng.getrandbits(64)
        fps.add(seed)
        for _ in range(12):
            x = seed if rng.random() < 0.5 else rng.choice(sorted(fps))
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    u = lambda x: x & (1 << 64) - 1
    want = slow_components(fps, lambda a, b: (u(a) ^ u(b)).bit_count() <= radius)
    got = {r.node: r.root for r in components(sh.near_edges(spark.createDataFrame([(x,) for x in fps], "fp long"), radius)).collect()}
    assert {n: got.get(n, n) for n in fps} == want
    assert len(set(want.values())) < len(fps)


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7), (3, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    rng = random.Random(5)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 50)) for _ in range(400)]
    texts = {10: " ".join(base), 4: " ".join(base), 7: " ".join([*base[:-1], "other"]), 5: None, 6: "", 9: " \n ", 3: "Lone", 2: "lone", 8: "quite different text here", 11: "x " * 20000}
    rows = [*texts.items(), (None, "lone"), (None, "nobody shares this text"), (3, "Lone")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sh.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fp = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = slow_components(sorted(texts), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp & (1 << 64) - 1, r.component_id) == (fp[r.doc_id], want[r.doc_id])
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["2", "None"]
    kept = sh.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.count() == len(set(want.values())) + 2  # rows without an id stay
    assert sh.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_columns_and_repeated_ids(spark):
    rows = [(1, "b", {"k": 1}, "p"), (1, "a", {"k": 2}, "q"), (1, "b", {"k": 1}, "p"), (2, "a", {}, "r"), (3, None, None, None), (4, " ", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, `a.b` string")
    got = sh.keep_one(df)
    assert got.schema == df.schema
    assert sorted((r.doc_id, r.text or "", r["a.b"]) for r in got.collect()) == [(1, "a", "q"), (1, "b", "p"), (3, "", None)]


@pytest.fixture
def skewed(spark):
    """Thresholds at which a small hub counts as skewed, and no broadcasts."""
    new = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def is_split(df):
    df.write.format("noop").mode("overwrite").save()  # its own plan is another object
    rows = df.collect()
    return rows and "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark, skewed):
    hub = spark.range(200000, numPartitions=8).select((F.col("id") + 1).alias("v"), F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(0).alias("u")).where("v > u")
    least = common.stage(graph.neighbour_minimum(hub), "least")[0]
    assert is_split(graph.to_minimum(hub, least))
    keys = spark.range(200000, numPartitions=8).select(F.lit(0).cast("byte").alias("t"), F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(0).alias("key"), F.col("id").alias("fp"))
    shared = common.cut(keys.groupBy("t", "key").count().where("count > 1").select("t", "key"))
    assert is_split(keys.join(shared, ["t", "key"])) and "SortMergeJoin" in sh.loose_bits(keys, shared)._jdf.queryExecution().toString()
    assert is_split(sh.loose_bits(keys, shared))
    labelled = keys.select("fp", F.col("key").alias("root"))
    assert is_split(sh.to_group(labelled, common.cut(labelled.groupBy("root").agg(F.min("fp").alias("component_id")))))
    fps = keys.select(F.col("fp").alias("doc_id"), F.col("key").alias("fp"))
    assert is_split(sh.to_documents(fps, common.cut(fps.select("fp", F.col("fp").alias("root")).distinct())))
