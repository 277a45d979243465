"""The quality field: marginals against enumeration, gradient against differences, held-out accuracy."""

import itertools
import math
import zlib

import numpy as np

from tessera.llm import quality as ql


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    f = ql.Field(rng.normal(size=3 * len(ql.FEATURES)), rng.normal(size=(2, 2)))
    for n in (1, 2, 5):
        x = rng.normal(size=(n, len(ql.FEATURES)))
        e = ql.with_neighbours(x) @ f.weights
        total, good = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(e[t] for t in range(n) if path[t]) + sum(f.transitions[a, b] for a, b in itertools.pairwise(path)))
            total += p
            good += p * np.array(path)
        assert np.allclose(f.marginals(x), good / total)


def test_gradient():
    rng = np.random.default_rng(1)
    lens, wide = [1, 3, 4], 6
    x, on = np.zeros((3, 4, wide)), np.zeros((3, 4), bool)
    for i, n in enumerate(lens):
        x[i, :n], on[i, :n] = rng.normal(size=(n, wide)), True
    y = np.array([[1, 0, 0, 0], [0, 1, 1, 0], [1, 1, 0, 1]])
    w, tr = rng.normal(size=wide), rng.normal(size=(2, 2))

    def loss(w, tr):
        total = 0.0
        for i, n in enumerate(lens):
            e = x[i, :n] @ w
            score = lambda path: sum(e[t] for t in range(n) if path[t]) + sum(tr[a, b] for a, b in itertools.pairwise(path))
            z = math.log(sum(math.exp(score(p)) for p in itertools.product((0, 1), repeat=n)))
            total += (score(y[i, :n].tolist()) - z) / n
        return total

    gw, gt = ql._gradient(x, on, y, w, tr)
    for k in range(wide):
        d = np.zeros(wide)
        d[k] = 1e-6
        assert math.isclose(gw[k], (loss(w + d, tr) - loss(w - d, tr)) / 2e-6, rel_tol=1e-4, abs_tol=1e-6)
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = 1e-6
        assert math.isclose(gt[i, j], (loss(w, tr + d) - loss(w, tr - d)) / 2e-6, rel_tol=1e-4, abs_tol=1e-6)


def test_groups_are_bounded():
    rng = np.random.default_rng(3)
    chains = [(rng.normal(size=(n, len(ql.FEATURES))), np.ones(n, int)) for n in [1] * 300 + [5] * 40 + [200] * 3 + [2000]]
    groups = list(ql.padded(chains, 1000))
    assert sum(len(x) for x, *_ in groups) == len(chains) and sum(int(on.sum()) for _, on, _ in groups) == sum(len(c[0]) for c in chains)
    assert all(x.shape[0] * x.shape[1] <= 1000 or len(x) == 1 for x, *_ in groups)


def test_blank_lines_end_no_sentence():
    x, _ = ql.line_features(b"One.\n\nTwo!\nthree")
    assert x[:, ql.FEATURES.index("sentence_end")].tolist() == [1, 0, 1, 0]


def test_transitions_are_learnt():
    docs = [(np.tile(np.eye(len(ql.FEATURES))[1 + i % 2], (6, 1)), np.ones(6), i % 2) for i in range(40)]
    assert len(ql.joined(docs)) == 79
    (bb, bg), (gb, gg) = ql.fit(docs).transitions
    assert bb + gg > bg + gb


def test_long_labelled_text(spark):
    """A labelled text of a million lines gives as many lines to the driver as any other."""
    rows = [(i, f"Sentence {i} is here.\nAnother one follows.") for i in range(40)] + [(100 + i, "###|$$ 123 |||\n@@ ##") for i in range(40)]
    rows += [(200, "A plain line of words.\n" * 1_000_000), (200, "A plain line of words.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not 100 <= i < 200)) for i, _ in rows] + [(1, 1), (1, 0), (2, None)], "doc_id long, quality int")
    field = ql.train(docs, labels)
    assert field.score(b"More words are here.\nThat is all.") > 0.7 > 0.3 > field.score(b"##$$ 12 ||\n@@ ## %%")


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = ql.op7_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in test) / len(test) > 0.95
    assert sum(a for a, b in test if b) >= 0.98 * sum(b for _, b in test)


def test_edges(spark):
    field = ql.Field(np.linspace(-1, 1, 3 * len(ql.FEATURES)), np.eye(2), 0.7, 0.1)
    texts = [None, "", "\n\n\n", "word " * 60000, "a\nb\nc", "a\nb\nc", "É\x00ß|"]
    df = spark.createDataFrame([(i or None, t, 1.0, "x") for i, t in enumerate(texts)], "doc_id long, text string, score double, quality string")
    rows = ql.score_documents(df, field).collect()
    assert rows[0].score == rows[1].score and rows[4].score == rows[5].score and rows[0].doc_id is None
    assert all(0 <= r.score <= 1 for r in rows)
    kept = ql.keep_good(df, field, 0.0)
    assert kept.columns == df.columns and kept.count() == len(texts)
    assert ql.score_documents(df.limit(0), field).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = ql.train(df.select("doc_id", "text"), none)
    assert flat.score(b"anything") == flat.score(b"") == 0.5
