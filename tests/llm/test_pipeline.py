"""The pipeline against a plain run of its rules over the smallest tables."""

import glob
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import common, pii, quality
from tessera.llm.tokens import default_vocabulary
from tests.llm.test_decontamination import brute as contaminated_by
from tests.llm.test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.read(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    field = quality.train(docs, common.read(spark, SF, "labels"))
    good = {i for i, r in rows.items() if field.score((r.text or "").encode()) >= 0.3}
    fps = {i: slow_fingerprint(rows[i].text) for i in good}
    root = slow_components(sorted(good), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    kept = {i for i in good if root[i] == i}
    bench = [(r.item_id, r.text) for r in common.read(spark, SF, "benchmark").collect()]
    hits = {i: contaminated_by(rows[i].text, bench) for i in kept}
    clean = {i for i, (n, k, _) in hits.items() if not k or 20 * k < n}
    assert len(clean) < len(kept) < len(good) < len(rows)
    want = [good, kept, clean, clean]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want, strict=False):
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs, _ = common.stage(out, name)
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(ids), name
    spans = {r.doc_id: r.spans for r in pii.find_pii(common.read(spark, SF, "documents")).collect()}
    texts = {}
    for r in docs.collect():
        t, out, at = rows[r.doc_id].text, [], 0
        for s in spans[r.doc_id]:
            if s.start >= at:
                out += [t[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        texts[r.doc_id] = "".join([*out, t[at:]])
        assert r.text == texts[r.doc_id] and (not out or r.n_chars == len(r.text))
    assert any(texts[i] != rows[i].text for i in texts)
    library = Tokenizer.from_file(default_vocabulary())
    got = {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start):
        assert zlib.crc32(r.ids) == r.ids_crc32
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}


def test_hard_rows(spark):
    """What each stage keeps of rows without ids, null, empty and long texts, repeated rows and unlike texts under one id."""
    text = "plain words that say nothing of note at all. " * 3
    other = "The committee met on Tuesday and heard from several witnesses. They spoke about rivers, roads and schools."
    rows = [(None, text, "en"), (1, None, None), (2, "", "en"), (3, text, "en"), (3, text, "en"), (4, "w " * 30000, "en"), (5, other + " Mail a.b@example.org now.", "en"), (5, text + " " + other, "en")]
    docs = spark.createDataFrame([(*r, "s", 1, {"k": 1}) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tags map<string,int>")
    stages = dict(corpus_pipeline.STAGES)
    seen = lambda df: sorted((r.doc_id or 0, (r.text or "")[:12]) for r in df.collect())
    kept = stages["quality_classifier"](spark, docs, SF)
    field = quality.train(docs, common.read(spark, SF, "labels"))
    assert seen(kept) == sorted((i or 0, (t or "")[:12]) for i, t, _ in rows if field.score((t or "").encode()) >= 0.3)
    one = stages["near_duplicates"](spark, docs, SF)
    assert one.schema == docs.schema and seen(one) == sorted([(0, text[:12]), (1, ""), (3, text[:12]), (4, "w " * 6), (5, other[:12]), (5, text[:12])])
    assert seen(stages["benchmark_decontamination"](spark, docs, SF)) == seen(docs)
    clean = stages["pii"](spark, docs, SF)
    assert [r.text for r in clean.where("text LIKE '%EMAIL%'").collect()] == [other + " Mail [EMAIL] now."] and clean.where("text IS NULL").count() == 1
    packed = stages["packing"](spark, docs, SF).groupBy("doc_id").agg(F.count_distinct("doc_tokens").alias("n"), F.sum("length").alias("ids")).collect()
    ids = {r.doc_id: r.ids for r in packed}
    assert ids[1] == ids[2] == 1 and set(ids) == {None, 1, 2, 3, 4, 5} and ids[4] > 30000
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_are_dropped(spark):
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/pipeline-*"))
    corpus_pipeline.run(spark, SF).count()
    assert [p.split("/pipeline-")[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{folder}/pipeline-*")) - before] == ["pii"]
