"""The stored index on small texts: search, generations, headlines."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import fulltext as ft

TEXTS = [
    (1, "The committees met. Running the committee, she RAN; water and taxes!", "en"),
    (2, "Clean water, clean rivers: the water act.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "Les majorités parlaient de la majorité du Québec. Maîtres, maître!", "fr"),
    (6, "committee water " + "filler " * 60 + "clean waters", "en"),
    (7, "the and of", "en"),
    (8, "Committee committee", "xx"),
    (None, "water", "en"),
    (9, "water " * 20000, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, 1) for i, t, lang in TEXTS], "doc_id long, text string, lang string, `a.b` int")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    out = ft.FullText(spark, f"file://{tmp_path_factory.mktemp('index')}/x", 4)
    out.add(docs, language=F.col("lang"))
    return out


def found(index, query, config="english"):
    return {r.doc_id: r.hits for r in index.hits(query, config).collect()}


def test_search(index):
    assert found(index, "committees") == {1: 2, 6: 1}
    assert found(index, "COMMITTEE water") == {1: 3, 6: 3}
    assert found(index, '"clean water"') == {2: 4, 6: 3}
    assert found(index, '"clean river" OR ran') == {1: 1, 2: 3}
    assert found(index, '"water the taxes"') == {1: 2}  # a stop word counts as any word
    assert found(index, "water -clean") == {1: 1, 9: 20000}
    assert found(index, 'water -"clean water" -committee') == {9: 20000}
    assert found(index, "majorité maître", "french") == {5: 4}
    assert found(index, "committee", "simple") == {8: 2}
    for nothing in ("", "the", "-water", "OR", "zebra", '"" -the', "majorité"):
        assert found(index, nothing) == {}
    assert [tuple(r)[:2] for r in index.ranked("water", "english", 3).collect()] == [(9, 20000), (2, 2), (6, 2)]


def test_generations(spark, docs, tmp_path):
    at = f"file://{tmp_path}/x"
    index = ft.FullText(spark, at, 4)
    assert index.generations() == 0 and found(index, "water") == {}
    assert index.add(docs.where("doc_id <= 2"), language=F.col("lang")) == 1
    before = found(index, "committee water clean OR committee OR clean")
    # a writer that got as far as the postings
    extra = docs.where("doc_id > 2").select("doc_id", ft.config_of(F.col("lang")).alias("config"), F.coalesce("text", F.lit("")).alias("text"))
    ft.postings_of(extra).withColumn("bucket", index.bucket(F.col("config"), F.col("word"))).write.partitionBy("bucket").parquet(f"{at}/postings/gen=2")
    assert found(index, "committee water clean OR committee OR clean") == before
    assert index.add(docs, language=F.col("lang")) == 2
    assert found(index, "water") == {1: 1, 2: 2, 6: 2, 9: 20000}
    assert index.add(docs, language=F.col("lang")) == 2  # nothing new
    words = index.table("lexicon", ft.LEXICON)
    assert words.count() == words.select("config", "word").distinct().count()


def test_headlines(index, docs):
    got = {r.doc_id: r.headline for r in ft.headlines(index.hits("committee clean", "english").unionByName(index.hits('"water act"', "english")), docs, 4, 6).collect()}
    assert got == {6: "<b>committee</b> water filler … filler <b>clean</b> waters", 2: "<b>water</b>, clean rivers: the <b>water</b> <b>act</b>."}
    long = {r.doc_id: r.headline for r in ft.headlines(index.hits("water", "english"), docs).collect()}
    assert long[9].count("<b>water</b>") == 70 and long[9].count(" … ") == 1
    assert set(long) == {1, 2, 6, 9}
    assert ft.headlines(index.hits("zebra", "english"), docs).count() == 0


def test_fragments(spark):
    hits = spark.createDataFrame([(1, [[1, 50, 52], [51, 90]]), (2, [[5], []])], "doc_id long, found array<array<int>>")
    got = sorted(map(tuple, ft.fragments(hits, 10).collect()))
    assert got == [(1, 0, 50, 52), (1, 1, 1, 1), (2, 0, 5, 5)]


def test_only_shown_texts_are_cut(index, docs):
    plan = ft.headlines(index.hits("water", "english"), docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("regexp_extract_all") < plan.index("Join")


def test_postings_group_a_slice(spark, docs):
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", ft.config_of(F.col("lang")).alias("config"), F.coalesce("text", F.lit("")).alias("text"))
    got = ft.postings_of(rows.coalesce(1)).collect()
    assert len({(r.config, r.word) for r in got}) == len(got)  # one row a word, not one a document
    water = next(r for r in got if r.word == "water")
    assert sorted(zip(water.docs, water.positions, strict=True))[:4] == [(1, 9), (2, 2), (2, 6), (6, 2)] and len(water.docs) == 20004


def test_analyzed(spark, docs, monkeypatch):
    def found(config, lang):
        out = ft.analyzed(docs.where(F.col("lang") == lang).coalesce(2), config)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        return {r.doc_id: list(zip(r.positions, r.stems, strict=True)) for r in out.collect()}

    english = found("english", "en")
    assert sorted(english) == [1, 2, 6, 9]  # neither without words nor without an id
    assert english[2] == [(1, "clean"), (2, "water"), (3, "clean"), (4, "river"), (6, "water"), (7, "act")]
    assert len(english[6]) == 64 and english[9] == [(i, "water") for i in range(1, 20001)]
    assert found("french", "fr")[5] == [(1, "le"), (2, "major"), (3, "parl"), (6, "major"), (8, "québec"), (9, "maîtr"), (10, "maîtr")]
    monkeypatch.setattr(ft, "_SLICE", 1)  # each text a slice of its own
    assert found("english", "en") == english
    monkeypatch.setattr(ft, "_KNOWN", 3)
    assert found("english", "en") == english


def test_analysis_of_a_repeated_id(spark, tmp_path):
    rows = [(1, "water taxes", "en"), (1, "the committees", "en"), (2, "rivers", "en"), (2, "eau", "fr"), (3, "the", "en"), (None, "water", "en")]
    spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    out = catalog.QUERIES["analyze_english"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, 3, digest("water committe tax")), (2, 1, digest("river"))]
