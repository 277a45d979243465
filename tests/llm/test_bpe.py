"""BPE by pair index against the library, whole texts both ways."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe
from tessera.llm.registry import QUERIES
from tessera.llm.tokens import default_vocabulary

PATHS = [default_vocabulary(), public_tokenizers.path("byte_bpe_50k.json")]
LIBS = {p: Tokenizer.from_file(p) for p in PATHS}
ENCODERS = {p: bpe.BpeEncoder(p, parts=50, slice_bytes=200) for p in PATHS}
TEXTS = ["Hello, it's 2024!\n\nÉté à la plage...", "", None, "a <|endoftext|> b<|endoftext|>c <|STARTOFTEXT|>", "x" * 5000, "of%%% the&&& thion,### été ́x", "don't we'll THEY'VE '", "日本語 テスト　全角  nb sp", "word " * 9000, "aaaa aaa aa baaab abababab", "-" * 3001, "ΣΑΣ ſ İ ﬁ"]


def library(path, text):
    ids = LIBS[path].encode(text or "", add_special_tokens=False).ids
    return ids, LIBS[path].decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", PATHS)
@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab C'.,|<>́éÉİſ\n\x1c\x85\xa0 9stheinr")), max_size=80), max_size=5))
def test_as_the_library(path, texts):
    texts = [*texts, "<|endoftext|>A a.a", "aaaaaaa ininining"]
    parts = list(ENCODERS[path].slices(pa.array(texts, pa.string())))
    flat, sizes = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    want = [library(path, t) for t in texts]
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [ids for ids, _ in want]
    decoder = bpe.Decoder(path)
    assert [decoder.text(np.array(ids)) for ids, _ in want] == [text for _, text in want]


def test_words_of_the_vocabulary():
    encoder = ENCODERS[PATHS[0]]
    words = [t.removesuffix("</w>") for t in LIBS[PATHS[0]].get_vocab() if t.isascii()]
    rng = np.random.default_rng(1)
    text = " ".join("".join(words[j] for j in rng.integers(0, len(words), 3)) for _ in range(4000))
    (_, _, ids, _), = encoder.slices(pa.array([text]))
    assert ids.tolist() == library(PATHS[0], text)[0]


def test_merge_tables_must_ascend():
    with pytest.raises(ValueError):
        bpe.Merges(np.array([2, 0]), np.array([0, 1]), np.array([3, 2]), 4)


@pytest.mark.parametrize("path", PATHS)
def test_hard_rows(spark, path):
    rows = [(i, t, "junk", 7, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1, 2), (3, TEXTS[3], "x", 1, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, `IDS` int, `_tz_x` int")
    with pytest.raises(ValueError):
        bpe.encode(docs)
    wide = bpe.encode(docs.withColumn("gap", F.expr("make_interval(1, 2)")), "tokens", path)
    assert wide.columns == [*docs.columns, "gap", "tokens"]
    got = bpe.decode(wide, "back", path, "tokens").drop("gap").collect()
    assert [(r.doc_id, r["a.b"], r["_tz_x"]) for r in got] == [(r[0], r[2], r[4]) for r in rows]
    for r in got:
        ids, text = library(path, r.text)
        assert np.frombuffer(r.tokens, "<u4").tolist() == ids and r.back == text
    assert bpe.encode(docs.limit(0), "tokens").count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids binary")).collect()[0].text is None


def test_query(spark):
    import hashlib

    got = {r.doc_id: r for r in QUERIES["op11_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, text = library(PATHS[0], d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
