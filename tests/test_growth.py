"""Joins that must not multiply: rows that the joins of a query make, on tables where many rows share a key."""

import re

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import relational as rel
from tessera.operators import resolve as rs

def joined(df):
    """(rows, rows made by the join of them that made the most)."""
    rows, most = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            if "Join" in name or "Cartesian" in name:
                most = max(most, p.metrics().apply("numOutputRows").value())
            kids = p.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return rows, most


@pytest.fixture(scope="module")
def crowd(spark):
    """2,000 facts of one name and day; 300 members of that name, in office then."""
    day = F.lit("2020-01-01").cast("timestamp")
    facts = spark.range(2000).select("id", F.lit("lee").alias("key"), day.alias("at"))
    members = spark.range(300).select(F.col("id").alias("member"), F.lit("lee").alias("key"), F.lit("lee").alias("name"), day.alias("start"), F.lit(None).cast("timestamp").alias("end"))
    return facts, members


def test_roster(crowd):
    facts, members = crowd
    rows, most = joined(rs.roster_by_keys(facts, members, "id", "key", "at", "name", "start", "end", "member"))
    assert rows == [] and most <= 2000
    rows, most = joined(rs.roster_by_keys(facts, members.where("member = 7"), "id", "key", "at", "name", "start", "end", "member"))
    assert len(rows) == 2000 and {r.member for r in rows} == {7}


def test_dated(crowd):
    facts, members = crowd
    rows, most = joined(rs.dated(facts, members, ["key"], "at", "start", "end", "member", "id", 0.9))
    assert rows == [] and most <= 2000


def test_speakers(crowd):
    facts, members = crowd
    said = facts.select("id", F.lit(None).cast("string").alias("first"), F.col("key").alias("last"), "at")
    people = members.select(F.col("member").alias("person"), F.concat(F.lit("a"), F.col("member").cast("string")).alias("first"), F.col("key").alias("last"))
    terms = members.select(F.col("member").alias("person"), "start", "end")
    one = people.where("person = 5").withColumns({"person": F.lit(1000).cast("long"), "last": F.lit("roy")})  # by day, one who is alone
    two = one.withColumns({"person": F.lit(1001).cast("long"), "first": F.lit("b")})
    said = said.unionByName(said.where("id = 5").withColumns({"id": F.lit(5000).cast("long"), "last": F.lit("roy")}))
    terms = terms.unionByName(terms.where("person = 5").withColumn("person", F.lit(1000).cast("long")))
    rows, most = joined(rs.resolve_named(said, people.unionByName(one).unionByName(two), terms, "id", "first", "last", "at"))
    assert len(rows) == 2001 and {(r.id, r.person) for r in rows if r.person is not None} == {(5000, 1000)} and most <= 2001


def test_legislatures(crowd):
    facts, members = crowd
    said = facts.select("id", F.lit(1).alias("legl"), F.col("key").alias("surname"))
    terms = members.select("member", F.lit(1).alias("legl"))
    rows, most = joined(rs.by_legislature(said, members, terms, "id", "legl", "surname", "member", "name"))
    assert rows == [] and most <= 2000


def test_continued(crowd):
    """One document names 300 members of a surname; its other rows do not meet each of them."""
    facts, members = crowd
    said = facts.select("id", F.lit(1).alias("doc"), F.lit(1).alias("legl"), F.col("key").alias("surname"))
    known, terms = members.select("member", F.lit(1).alias("doc")), members.select("member", F.lit(1).alias("legl"))
    rows, most = joined(rs.continued(known, said, members, terms, "id", "doc", "legl", "surname", "member", "name"))
    assert rows == [] and most <= 2000


def test_labels(crowd):
    facts, members = crowd
    said = facts.select("id", F.lit("MR. A. LEE (Yale)").alias("label"), "at")
    terms = members.select("member", F.lit("ann").alias("first"), F.col("key").alias("last"), F.lit("Yale").alias("riding"), "start", "end")
    rows, most = joined(rs.by_label(said, terms, "id", "label", "at"))
    assert rows == [] and most <= 2000


def test_middle_initials(crowd):
    facts, members = crowd
    said = facts.select("id", F.lit("Mr. Ann B. Lee").alias("full"), F.col("key").alias("last"), "at")
    terms = members.select("member", F.lit("Ann B. Lee").alias("name"), F.lit("Ann").alias("first"), F.lit("Lee").alias("last"), "start", "end")
    rows, most = joined(rs.by_middle_initial(said, terms, "id", "full", "last", "at"))
    assert rows == [] and most <= 2000


def test_stubs(crowd):
    facts, members = crowd
    rows, most = joined(rs.merge_stubs(facts.select("id", "key"), facts.select("id", "at"), members, "id", "key", "at", "start", "end", "member"))
    assert rows == [] and most <= 2000


def test_meetings(spark, tmp_path):
    """400 parts of one day and few names: rows that the join makes stay near the rows."""
    words = F.concat(F.lit("oak "), (F.col("id") % 5).cast("string"))
    spark.range(400).select(F.col("id").alias("p_partkey"), words.alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    rows, most = joined(catalog.QUERIES["meeting_match"](spark, str(tmp_path)))
    assert len(rows) == 200 and {(r.vid, r.rank) for r in rows} == {(1, 1), (3, 1), (5, 1), (7, 1), (9, 1)} and most <= 400


def test_same_or_begun_odd_rows(spark):
    """Nothing agrees with no name; an empty beginning agrees with every name."""
    left = spark.createDataFrame([(0, 1, "oakelm"), (2, 1, None), (4, 2, "fir"), (6, 3, "")], "id long, day int, body string")
    right = spark.createDataFrame([(1, 1, "oak", "oak"), (3, 1, "oakelm", "x"), (5, 2, "y", ""), (7, 3, None, None), (9, 4, "fir", "fir")], "vid long, day int, same string, begin string")
    got = rel.match_same_or_begun(left, right, "day", "id", "body", "vid", F.col("same"), F.col("begin"))
    assert sorted(map(tuple, got.collect())) == [(0, 3, 1), (4, 5, 2)]


def test_duplicate_people(spark, tmp_path):
    """1,000 people of one segment, 30 apart: each has two within reach, one of them behind it."""
    spark.range(1000).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), (F.col("id") * 30.0 - 9000).alias("c_acctbal"), F.lit("s").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    rows, _ = joined(catalog.QUERIES["duplicate_people"](spark, str(tmp_path)))
    assert sorted(map(tuple, rows)) == [(i, i + 1) for i in range(999)]
    assert "_band" in catalog.QUERIES["duplicate_people"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_odd_values(spark):
    x = [0.0, 49.99, -49.99, 50.0, None, float("nan"), float("inf"), float("inf"), 1e300, 1e300]
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x)], "id long, k int, v double")
    assert sorted(map(tuple, rel.near_pairs(df, ["k"], "id", "v", 50).collect())) == [(0, 1), (0, 2), (1, 3), (8, 9)]


def test_composite_keys_are_joined_not_their_rows(spark, tmp_path):
    n = spark.range(3).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("n"), F.col("id")).alias("n_name"), F.lit(0).alias("n_regionkey"))
    c = spark.range(900).selectExpr("id c_custkey", "'c' c_name", "cast(id % 2 as int) c_nationkey", "if(id = 7, null, 10.5D) c_acctbal", "'m' c_mktsegment")
    s = spark.range(400).selectExpr("id s_suppkey", "'s' s_name", "cast(1 + id % 2 as int) s_nationkey", "if(id = 9, 5000D, 900D) s_acctbal")
    for name, df in (("nation", n), ("customer", c), ("supplier", s)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rows, most = joined(catalog.QUERIES["composite_key_join"](spark, str(tmp_path)))
    assert [tuple(r) for r in rows] == [("n1", 449, 200)] and most <= 900


def test_or_join_gathers_no_pairs(spark):
    left = spark.createDataFrame([(1, 5, 1), (2, None, 1), (3, 5, None), (3, 5, None)], "a int, x int, y int")
    right = spark.createDataFrame([(1, 5, 1), (3, None, 1), (9, 5, 2)], "b int, u int, v int")
    out = rel.or_equi_join(left, right, [left.a == right.b, left.x == right.u, left.y == right.v])
    want = left.join(right, F.coalesce(left.a == right.b, F.lit(False)) | F.coalesce(left.x == right.u, F.lit(False)) | F.coalesce(left.y == right.v, F.lit(False)))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["cluster_labels", "tfidf_top_terms"])
def test_terms_are_counted_in_few_passes(spark, name):
    """cluster_labels sends no term of a document but those of the vocabularies, by number; tfidf_top_terms does not join its counts to themselves."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(lang#\d+, doc_id#\d+L?, term#" if name == "cluster_labels" else r"Join \[doc_id#", plan)


def test_pairs(crowd):
    """400 rows of one key make 79,800 pairs; the join makes a row for each row and block."""
    rows, most = joined(rel.crowded_pairs(crowd[0].where("id < 400").select("id", "key"), "key", "id"))
    assert len({(r.a, r.b) for r in rows}) == len(rows) == 79_800 and all(r.a < r.b for r in rows) and most <= 400


def test_pairs_of_several_blocks(spark, monkeypatch):
    """Blocks of three rows: borders, repeated ids, nulls and a condition that tells a from b."""
    monkeypatch.setattr(rel, "PAIR_BLOCK", 3)
    given = [(k, i, (i * 7 + k) % 5) for k in (1, 2) for i in [*range(10), 4, 4, 4, 4, 9]] + [(None, 1, 1), (None, 2, 2), (1, None, 3), (3, 1, 1), (4, 1, None), (4, 2, 2)]
    got = rel.crowded_pairs(spark.createDataFrame(given, "key int, id int, v int"), "key", "id", F.col("a.v") > F.col("b.v")).collect()
    full = [x for x in given if None not in x]
    assert sorted(map(tuple, got)) == sorted((x[1], y[1], x[0]) for x in full for y in full if x[0] == y[0] and x[1] < y[1] and x[2] > y[2])


def test_pairs_overlap_without_a_nation(spark, tmp_path):
    """Customers without a nation share none."""
    spark.createDataFrame([(1, None, "m"), (2, None, "m"), (3, 5, "m"), (4, 5, "m"), (5, 5, None), (6, 5, None)], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    day = F.expr("timestamp '2020-01-01' + make_dt_interval(cast(id div 6 as int))")
    spark.range(12).select("id", (F.col("id") % 6 + 1).alias("o_custkey"), day.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in catalog.QUERIES["duplicate_pairs_overlap"](spark, str(tmp_path)).collect()] == [(3, 4)]


def exchanged(df):
    """(MB that the exchanges of df were given, the plan that ran)."""
    df.collect()
    total, todo, plan = 0, [df._jdf.queryExecution().executedPlan()], df._jdf.queryExecution().executedPlan().toString()
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            total += p.metrics().apply("dataSize").value() / 1e6 if name == "Exchange" else 0
            kids = p.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return total, plan


def test_pairs_travel_as_rows_grow(spark, monkeypatch):
    """Four times the rows of a key are four times the data shuffled, though sixteen times the pairs; the pairs of two arrays are not made in one go."""
    monkeypatch.setattr(rel, "PAIR_BLOCK", 16)
    rows = spark.range(2000).select("id", (F.col("id") % 1).alias("key"))
    none = F.col("a.id") + F.col("b.id") < 0
    (few, _), (many, plan) = exchanged(rel.crowded_pairs(rows.where("id < 500"), "key", "id", none)), exchanged(rel.crowded_pairs(rows, "key", "id", none))
    assert many < 5 * few
    assert not re.search(r"\*\(\d+\) Generate explode\(filter", plan)


def test_pairs_of_several_arrays(spark, monkeypatch):
    """Blocks of several arrays, arrays of several runs, and equal ids across their borders."""
    given = [(k, i, (i * 7 + k) % 5) for k in (1, 2) for i in [*range(23), 4, 4, 4, 4, 9]]
    for sizes in ((3, 2, 2), (4, 1, 3), (2, 5, 1), (100, 3, 8)):
        for name, n in zip(("PAIR_BLOCK", "PAIR_RUN", "PAIR_BLOCKS"), sizes):
            monkeypatch.setattr(rel, name, n)
        got = rel.crowded_pairs(spark.createDataFrame(given, "key int, id int, v int"), "key", "id", F.col("a.v") > F.col("b.v")).collect()
        assert sorted(map(tuple, got)) == sorted((x[1], y[1], x[0]) for x in given for y in given if x[0] == y[0] and x[1] < y[1] and x[2] > y[2])


def test_pairs_are_small_files(spark, tmp_path):
    """4,498,500 pairs of 3,000 scattered ids."""
    ids = spark.range(3000).select(F.xxhash64("id").alias("id"), F.lit(1).alias("key"))
    rel.crowded_pairs(ids, "key", "id").select("a", "b").write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 4_498_500
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 4_498_500 * 0.2
