"""Decontamination against a brute-force scan."""

import random

import duckdb
import pytest

from tessera.llm import decontamination as dc
from tessera.llm.registry import QUERIES

BENCH = [(1, "The quick brown fox jumps over the lazy dog while nine cats sleep on warm stones"), (2, "Zwei kurze Wörter"), (3, None), (4, ""), (5, "The quick brown fox jumps over the lazy dog while nine cats sleep on cold roofs"), (None, "nameless item here"), (6, "!!! ..."), (2, "Zwei kurze Wörter")]
DOCS = [
    (1, "Before: the QUICK brown, fox jumps over the lazy dog while nine cats sleep; after."),
    (2, "und zwei kurze wörter, zwei kurze Wörter! " + "fill " * 200),
    (3, None), (4, ""), (5, "...!!"), (6, "clean text about nothing"), (7, "a nameless-item here"), (None, "zwei kurze wörter"), (6, "clean text about nothing"),
    (8, "fox " * 30000 + "the quick brown fox jumps over the lazy dog while nine cats sleep on"),
]


def brute(text, bench):
    words = [w.decode() for w in dc.words_of((text or "").encode())]
    hit, items = set(), set()
    for item, t in bench:
        b = [w.decode() for w in dc.words_of((t or "").encode())]
        n = min(13, len(b))
        for i in range(len(b) - n + 1) if n else ():
            for j in range(len(words) - n + 1):
                if words[j] == b[i] and words[j : j + n] == b[i : i + n]:
                    hit.update(range(j, j + n))
                    items.add(item)
    return len(words), len(hit), sorted(i for i in items if i is not None)


@pytest.mark.parametrize("slice_size", [1_000_000, 3])
def test_brute(spark, slice_size):
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in DOCS], "doc_id long, text string, n_words string, items array<int>")
    bench = spark.createDataFrame([(i, t, 1) for i, t in BENCH], "item_id long, text string, doc_id int")
    rows = dc.find_contamination(docs, bench, max_ngrams=slice_size).collect()
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), sorted(r["items"])) for r in rows]
    assert got == [(i, *brute(t, BENCH)) for i, t in DOCS]
    kept = dc.remove_documents(docs, bench, max_ngrams=slice_size)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [i for i, t in DOCS if not (b := brute(t, BENCH))[1] or 20 * b[1] < b[0]]
    assert dc.find_contamination(docs, bench.limit(0)).selectExpr("sum(size(spans))").collect()[0][0] == 0
    assert dc.find_contamination(docs.limit(0), bench).count() == 0


def test_random_words():
    rng = random.Random(1)
    bench = [(i, " ".join(rng.choices("abc", k=rng.randint(1, 20)))) for i in range(6)]
    grams = dc.Grams([(i, t.encode()) for i, t in bench], 13)
    for _ in range(60):
        text = " ".join(rng.choices("abcd", weights=[5, 5, 5, 1], k=rng.randint(0, 80)))
        hit, items = grams.scan(dc.words_of(text.encode()))
        n, k, names = brute(text, bench)
        assert (0 if hit is None else int(hit.sum()), sorted(items)) == (k, names)


def test_remove_spans():
    text = b"One, two; THREE four! five."
    assert dc.remove_spans(text, [(1, 3)]) == b"One, four! five."
    assert dc.remove_spans(text, []) == text


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    from tessera.llm.registry import ORACLES

    want = db.execute(ORACLES["op10_decontamination"]).fetchall()
    names = [d[0] for d in db.description]
    got = QUERIES["op10_decontamination"](spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(r.contaminated for r in got)


def test_remove_passages(spark):
    passage = " ".join(f"word{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"Before it. {passage}, after é.", {"k": 1}), (2, None, None), (3, "", {}), (4, "Nothing here.", {})], "doc_id long, text string, tags map<string,int>")
    bench = spark.createDataFrame([("a", passage)], "item_id string, text string").selectExpr("1L AS item_id", "text")
    out = dc.remove_passages(docs, bench)
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["Before it. after é.", None, "", "Nothing here."]
    assert dc.remove_passages(docs, bench.limit(0)).orderBy("doc_id").first().text.startswith("Before it. word0")
