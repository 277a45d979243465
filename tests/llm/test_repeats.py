"""Substring dedup against counting every window."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm import repeats as rp
from tessera.llm.registry import ORACLES, QUERIES
from tests.llm.test_simhash import is_split, skewed  # noqa: F401


def brute(texts, width):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in docs for i in range(len(w) - width + 1))
    out = []
    for w in docs:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def got(spark, texts, width, gram):
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in enumerate(texts)], "doc_id int, text string, tid binary, n int")
    rows = rp.remove_repeats(df, width, gram).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    return [(r.n_words, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in rows]


@pytest.mark.parametrize(("width", "gram", "letters"), [(5, 2, "ab"), (6, 3, "abcdefgh"), (4, 8, "abc")])
def test_random(spark, width, gram, letters):
    rng = random.Random(width)
    word = lambda: rng.choice(letters) * rng.choice((1, 1, 2))
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(40)]
    texts += [None, "", "  \t", texts[3], texts[3], "a " * 50, "x " + texts[5] + " y", "A\x0ba\x1ca"]
    assert got(spark, texts, width, gram) == brute(texts, width)


def test_long_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("etaoin", k=3))
    passage = [word() for _ in range(120)]
    texts = []
    for i in range(30):
        own = [word() for _ in range(rng.randint(0, 80))]
        cut = rng.randint(0, 80)
        texts.append(" ".join(own[:20] + passage[cut : cut + rng.randint(30, 40)] + own[20:]) if i % 3 else " ".join(own))
    near = passage.copy()
    near[60] = "edit"
    texts += [" ".join(near), " ".join(passage), " ".join(passage), " ".join(f"w{i}" for i in range(40000))]
    want = brute(texts, 35)
    assert got(spark, texts, 35, 8) == want
    assert any(0 < r < n for n, r, _ in want)


def test_digests_decide_nothing(spark, monkeypatch):
    """Digests that clash nearly always change no result: words are compared where they stand."""
    monkeypatch.setattr(rp, "digest64", lambda words: len(words) % 2)
    rng = random.Random(11)
    passage = [f"w{rng.randint(0, 40)}" for _ in range(60)]
    texts = []
    for _ in range(30):
        at = rng.randint(0, 50)
        own = [f"w{rng.randint(0, 40)}" for _ in range(30)]
        texts.append(" ".join(own[:10] + passage[at : at + rng.randint(0, 20)] + own[10:]))
    texts += [texts[2], texts[2], "a b " * 20]
    assert got(spark, texts, 6, 3) == brute(texts, 6)


def test_paths_are_compacted(spark):
    """A passage that always occurs whole is one path a text; one that is also cut short branches there."""
    a, b = [(1, i, 1, i, 0) for i in range(5)], [(2, i + 7, 1, i, 0) for i in range(5)]
    frame = lambda rows: spark.createDataFrame([(bytes([t]), lo, n, x, y, 1) for t, lo, n, x, y in rows], "tid binary, lo int, n int, key_a long, key_b long, w int")
    pieces = frame(a + b)
    assert sorted(r.key_a for r in rp.nonbranching(pieces).collect()) == [1, 2, 3, 4]
    assert sorted((r.tid[0], r.lo, r.n, r.head_a) for r in rp.compacted(pieces, rp.nonbranching(pieces)).collect()) == [(1, 0, 5, 0), (2, 7, 5, 0)]
    pieces = frame(a + b + [(3, 4, 1, 1, 0), (3, 5, 1, 2, 0), (4, 0, 1, 9, 0), (4, 1, 1, 4, 0)])
    assert sorted(r.key_a for r in rp.nonbranching(pieces).collect()) == [2]
    assert sorted((r.tid[0], r.lo, r.n, r.head_a) for r in rp.compacted(pieces, rp.nonbranching(pieces)).collect()) == [(1, 0, 1, 0), (1, 1, 2, 1), (1, 3, 1, 3), (1, 4, 1, 4), (2, 7, 1, 0), (2, 8, 2, 1), (2, 10, 1, 3), (2, 11, 1, 4), (3, 4, 2, 1), (4, 0, 1, 9), (4, 1, 1, 4)]


def test_hot_minimisers_are_split(spark, skewed):
    rows = spark.range(200000, numPartitions=8).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(0).alias("anchor"), F.col("id").alias("digest"))
    paths = common.stage(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("met")), "anchors")[0]
    assert is_split(rp.on_anchor(rows, paths))
    pieces = rows.select(F.col("digest").cast("string").cast("binary").alias("tid"), F.lit(0).alias("lo"), F.lit(1).alias("n"), F.col("anchor").alias("key_a"), F.lit(0).cast("long").alias("key_b"), F.lit(1).alias("w"))
    inner = common.stage(pieces.select("key_a", "key_b").distinct(), "inner")[0]
    assert is_split(rp.compacted(pieces, inner))


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (2, "b c d e")], "doc_id long, text string")
    assert sorted(bytes(r.kept) for r in rp.remove_repeats(df, 3, 2).collect()) == [b"", b"", b"e"]
    assert rp.remove_repeats(df.limit(0), 3, 2).count() == 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(ORACLES["op9_substring_dedup"]).fetchall()
    rows = QUERIES["op9_substring_dedup"](spark, sf).select(*(d[0] for d in db.description)).collect()
    assert sorted(map(tuple, rows)) == sorted(want)
    assert any(r.n_removed for r in rows)
