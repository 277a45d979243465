"""Operators that keep columns keep those of any name and type, with their values."""

import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontamination, fim, pii, quality, secrets, simhash

SF = "/root/testdata/sf0.001"
NAMES = ["a.b", "_tz_id", "_tz_spans", "_tz_score", "_tz_digest", "found", "spans", "row", "doc_id_of_text", "DIGEST_OF_TEXT", "hits", "we`ird"]
SECRET = "password = hunter2hunter2"


@pytest.fixture(scope="module")
def docs(spark):
    text = "The committee met on Tuesday and heard from several witnesses. They spoke about rivers, roads and schools."
    rows = [(1, text + " Mail a.b@example.org now."), (2, text + " " + SECRET), (3, None), (4, text + " Mail a.b@example.org now."), (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = common.with_columns(frame, **{n: F.lit(77 + i) for i, n in enumerate(NAMES)})
    return frame.withColumns({"m": F.create_map(F.lit("k"), F.col("doc_id")), "v": F.parse_json(F.lit('{"x": 1}')), "gap": F.expr("make_interval(1, 2)")})


def values(frame, texts=False):
    shown = [common.quoted(c) for c in ("doc_id", *(["text"] if texts else []), *NAMES)] + [F.col("m")["k"].alias("m"), F.col("v").cast("string"), F.col("gap").cast("string")]
    return sorted(map(tuple, frame.select(*shown).collect()), key=repr)


def bench(spark):
    return spark.createDataFrame([(1, "One two three four five six seven eight nine ten eleven twelve thirteen"), (2, "committee met on")], "item_id long, text string")


def kept(frame, docs, ids):
    assert frame.columns == docs.columns and frame.schema.simpleString() == docs.schema.simpleString()
    assert values(frame) == [v for v in values(docs) if v[0] in ids]


def test_operators(spark, docs):
    every = {1, 2, 3, 4, 5}
    field = quality.train(common.read(spark, SF, "documents"), common.read(spark, SF, "labels"))
    good = {r.doc_id for r in quality.score_documents(docs, field).where("score >= 0.3").collect()}
    kept(quality.keep_good(docs, field), docs, good)
    kept(simhash.keep_one(docs), docs, every - {4})
    kept(simhash.keep_one(docs.unionByName(docs)), docs, every - {4})
    for size in (1_000_000, 3):
        kept(decontamination.remove_documents(docs, bench(spark), max_ngrams=size), docs, {3})
        cut = decontamination.remove_passages(docs, bench(spark), max_ngrams=size)
        kept(cut, docs, every)
        assert {r.doc_id: r.text for r in cut.select("doc_id", "text").collect()}[5] == "fourteen"
    for redact in (secrets.redact, pii.redact):
        kept(redact(docs), docs, every)
    assert SECRET not in " ".join(r.text or "" for r in secrets.redact(docs).select("text").collect())
    assert "a.b@example.org" not in " ".join(r.text or "" for r in pii.redact(docs).select("text").collect())
    assert values(bpe.encode(docs, "ids")) == values(docs) == values(fim.transform(docs))


def test_pipeline_stages(spark, docs):
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
        out = common.cut(out)
    assert {v[0] for v in values(out)} <= {1, 2, 3, 5} and set(values(out)) <= set(values(docs))
    assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() > 0


def test_private_names(spark):
    frame = spark.createDataFrame([(1, 2)], "A int, a_1 int")
    assert common.fresh(frame, "a") == "a_2" and common.fresh(frame, "b") == "b"


def test_templated_items():
    """The hash set takes time in proportion to items that share windows."""
    template = " ".join(f"word{i}" for i in range(25))

    def build(n):
        began = time.process_time()
        grams = decontamination.Grams([(i, f"{template} question {i}".encode()) for i in range(n)], 13)
        return time.process_time() - began, grams

    build(100)
    small, _ = build(5_000)
    large, grams = build(20_000)
    assert large < 12 * max(small, 0.05)
    assert len(grams.scan(decontamination.words_of(template.encode()))[1]) == 20_000
