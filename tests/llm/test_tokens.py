"""Packing and token files against whole-text encoding by the library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import token_files as tf
from tessera.llm.packing import cut_points, pack_documents, read_buckets, write_buckets
from tessera.llm.tokens import Encoder, default_vocabulary

LIB = Tokenizer.from_file(default_vocabulary())
TEXTS = ["Hello, it's 2024!\n\nÉté à la plage...", "", None, "a <|endoftext|> b<|endoftext|>c <|STARTOFTEXT|>", "x" * 5000, "of%%% the&&& thion,### été ́x", "don't we'll THEY'VE '", "日本語 テスト　全角  nb sp", "word " * 9000]


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def frame(spark):
    rows = [(i, t, "junk", 7) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1), (3, TEXTS[3], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab C'.,|<>\u0301éÉİſ\n\x1c\x85\xa0 9st")), max_size=60), max_size=5))
def test_words_equal_whole_text(texts):
    parts = list(SMALL.slices(pa.array([*texts, None, "<|endoftext|>A a.a"], pa.string()), 7))
    assert [a for a, *_ in parts[1:]] == [b for _, b, *_ in parts[:-1]]
    flat, sizes = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    want = [ids(t) + [7] for t in [*texts, "", "<|endoftext|>A a.a"]]
    assert flat.tolist() == [x for w in want for x in w] and sizes.tolist() == [len(w) for w in want]


SMALL = Encoder(default_vocabulary(), parts=40, slice_bytes=100)


def test_pack(spark):
    rows = pack_documents(frame(spark)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and r.length == 1 << r.bucket
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    for i, t in enumerate(TEXTS):
        want = ids(t) + [2]
        assert (sorted(got[i]) == sorted(want * 2)) if i == 3 else got[i] == want
    assert got[None] == ids("null id") + [2]
    assert pack_documents(frame(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack_documents(frame(spark), max_len=100)


def test_buckets(spark, tmp_path):
    pieces = pack_documents(frame(spark), max_len=1 << 40)
    write_buckets(pieces, f"file://{tmp_path}/packed")
    back = read_buckets(spark, f"file://{tmp_path}/packed")
    key = lambda r: tuple(str(r[c]) for c in pieces.columns)
    assert sorted(map(key, back.collect())) == sorted(map(key, pieces.collect()))
    assert {r.length for r in back.collect()} >= {1, 1 << 13}
    one = read_buckets(spark, f"file://{tmp_path}/packed", 1 << 13)
    assert {r.length for r in one.collect()} == {1 << 13} and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    write_buckets(pieces.limit(0), f"file://{tmp_path}/none")
    assert read_buckets(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        pack_documents(frame(spark), max_len=1 << 62)


def test_cut_points():
    assert cut_points(10000, 4096) == [4096, 4096, 1024, 512, 256, 16]
    assert cut_points(1, 4096) == [1] and cut_points(4096, 4096) == [4096]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=40), min_size=1, max_size=8), st.integers(9, 18))
def test_segment_round_trip(docs, limit):
    flat = np.array([x for d in docs for x in d], np.int64)
    counts = np.bincount(flat, minlength=301) if len(flat) else np.zeros(301, np.int64)
    lengths = tf.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(float)
    assert not len(used) or (used.max() <= limit and (2**-used).sum() <= 1)
    codes, _ = tf.canonical(lengths, limit)
    s = tf.encode_segment(list(range(len(docs))), flat, np.array([len(d) for d in docs]), lengths, codes, 4, limit)
    names, sizes, starts, out = tf.read_segment(s, {})
    assert names == list(range(len(docs))) and sizes.tolist() == [len(d) for d in docs] and out.tolist() == flat.tolist() and starts.tolist() == (np.cumsum(sizes) - sizes).tolist()
    names, sizes, starts, out = tf.read_segment(s, {}, lambda d: d % 2 == 1)
    assert names == list(range(1, len(docs), 2)) and out.tolist() == [x for d in docs[1::2] for x in d]
    for bad in (s[:-3] + b"\0\0\0", s[:-1], b"x" + s[1:]):
        with pytest.raises(ValueError):
            tf.read_segment(bad, {})


def test_lengths_are_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert tf.code_lengths(counts, 16).tolist() == [9, 9, 8, 7, 6, 5, 4, 3, 2, 1]  # Huffman's own
    assert max(tf.code_lengths(counts, 4)) == 4


def test_segments_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SEGMENT_IDS", 50)
    docs = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tf.write_token_files(docs, f"file://{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = spark.read.parquet(f"file://{tmp_path}/out").select("part", "before", "n_ids", "n_docs").collect()
    assert max(r.n_ids for r in index) < 50 + 40 and len(index) > 100 and sum(r.n_docs for r in index) == 2000
    assert len({r.part for r in index}) > 2
    at = 0
    for r in tf.read_token_files(spark, f"file://{tmp_path}/out").orderBy("start").collect():
        assert r.start == at
        at += r.n_tokens
    assert at == sum(r.n_ids for r in index)


def test_files(spark, tmp_path):
    tf.write_token_files(frame(spark), f"file://{tmp_path}/out")
    rows = tf.read_token_files(spark, f"file://{tmp_path}/out").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    at = 0
    for r in rows:
        want = np.array(ids("null id" if r.doc_id is None else TEXTS[r.doc_id]) + [1], "<u4").tobytes()
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (at, len(want) // 4, zlib.crc32(want))
        at += r.n_tokens
    some = tf.read_token_files(spark, f"file://{tmp_path}/out", 3, 5).orderBy("start").collect()
    assert some == [r for r in rows if r.doc_id in (3, 4, 5)]
    assert tf.read_token_files(spark, f"file://{tmp_path}/out", first=7).count() == len(TEXTS) - 7
    tf.write_token_files(frame(spark).limit(0), f"file://{tmp_path}/none")
    assert tf.read_token_files(spark, f"file://{tmp_path}/none").count() == 0
