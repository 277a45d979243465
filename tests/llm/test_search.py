"""Ranked search against scores of all documents."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import search
from tessera.llm.common import shared_path
from tessera.llm.decontamination import words_of
from tessera.llm.registry import ORACLES, QUERIES


def brute(docs, items, k):
    bags = [(i, Counter(words_of((t or "").encode()))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_all, l_all = len(bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(words_of((text or "").encode()))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, b in bags:
            m = 50 + 50 * b.total() * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,terms,k", [(60, 7, 5), (10**6, 10**6, 3), (1, 10**6, 50), (400, 40, 1)])
def test_brute(spark, shard, terms, k):
    rng = random.Random(shard)
    some = ["alpha", "Beta", "GAMMA", "delta", "étude", "x1", "don", "of", "the", "ß"]
    docs = [(i, " ".join(rng.choices(some, weights=range(1, 11), k=rng.randint(0, 40)))) for i in range(120)]
    docs += [(200 + i, "alpha beta of the the") for i in range(90)] + [(None, "Alpha beta-of,the the"), (None, "x1"), (7, None), (8, ""), (9, "... !!"), (5, "étude " * 3000), (5, "étude " * 3000)]
    items = [(1, "ALPHA of the"), (2, "étude, x1; x1"), (3, None), (4, "zzz unknown"), (5, "..."), (None, "alpha"), (6, "Don don ß gamma"), (2, "delta"), (7, "alpha beta of the the")]
    frame = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, terms int, `a.b` string").repartition(3)
    path = shared_path(spark, "index")
    search.write_index(frame, path, shard)
    index = search.read_index(spark, path)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, search.search(index, asked, k, terms).collect()))
    assert [g[:2] + g[3:] for g in got] == [g[:2] + g[3:] for g in brute(docs, items, k)] and got == brute(docs, items, k)
    assert search.search(index, asked.limit(0)).count() == 0


def test_empty_index(spark):
    path = shared_path(spark, "index")
    docs = spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string")
    for rows in (docs, docs.limit(0)):
        at = shared_path(spark, path.rsplit("/", 1)[1])
        search.write_index(rows, at)
        assert search.search(search.read_index(spark, at), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_shard_beyond_the_beam():
    rng = random.Random(5)
    build, texts = search.Builder(3000, 60_000), []
    for _ in range(3000):
        texts.append(" ".join(rng.choices("abcdefghij", k=rng.randint(1, 30))) + rng.choice(["", " rare"] + [""] * 60))
    build.add(pa.array(range(3000)), pa.array(texts))
    row = build.row()
    _, ids, names, df, impacts, bits = (c[0] for c in row.columns)
    shard = search.Shard(ids.values, names.values, df.values.to_numpy(), impacts.as_py(), bits.as_py())
    places = shard.places(pa.array(["a", "c", "rare", "j", "none"]))
    assert places[-1] == -1
    weights = np.array([3.0, 500.0, 7000.0, 40.0])
    score = {}
    for place, w in zip(places[:4], weights, strict=True):
        want = {}
        term = names.values[int(place)].as_py()
        for i, t in enumerate(texts):
            words = t.split()
            if term in words:
                want[i] = int(search.impact(np.array([words.count(term)]), np.array([len(words)]), 3000, 60_000)[0])
        for i, v in want.items():
            score[i] = score.get(i, 0) + int(w) * v
    order = sorted(score, key=lambda i: (-score[i], i))
    for k in (1, 10, 700):
        docs, scores = shard.best(places[:4], weights, k)
        assert docs.tolist() == order[:k] and scores.tolist() == [score[i] for i in order[:k]]
        floor = score[order[4]]
        docs, _ = shard.best(places[:4], weights, k, floor)
        assert docs.tolist() == [i for i in order if score[i] >= floor][:k]


def test_query(spark):
    got = QUERIES["op13_ranked_search"](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(ORACLES["op13_ranked_search"])
    names = [d[0] for d in want.description]
    want = sorted(want.fetchall())
    assert sorted(map(tuple, got.select(*names).collect())) == want and want
