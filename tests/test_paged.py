"""The page source: forms, links, missing fields, empty folders."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import paged


def put(path, n, body):
    at = path / f"page={n}"
    at.mkdir(parents=True)
    (at / "body.txt").write_text(body)
    (at / "_SUCCESS").write_text("")


def test_forms():
    assert paged.items_of("a,b\n1,\"x, y\"\n", "csv") == [{"a": "1", "b": "x, y"}]
    assert paged.items_of("<rss><channel><title>t</title><item><title>A &amp; B</title><link/></item></channel></rss>", "rss") == [{"title": "A & B", "link": None}]
    assert paged.items_of('{"meta": {"view": {"columns": [{"fieldName": "a"}, {"fieldName": "b"}]}}, "data": [[1, null]]}', "catalogue") == [{"a": 1, "b": None}]
    assert paged.items_of('{"x": {"y": [{"a": 1}]}}', "json", "x.y") == [{"a": 1}] and paged.items_of('{"x": null}', "json", "x.y") == []


def test_links(spark, tmp_path):
    for n, (following, value) in {0: (2, "a"), 1: ("null", "never"), 2: (5, "b"), 5: (0, "c")}.items():
        put(tmp_path / "x", n, f'{{"items": [{{"v": "{value}", "n": {n}, "more": {{"k": [1]}}}}, {{"other": 1}}], "next": {following}}}')
    path, kinds = f"file://{tmp_path}/x", "v string, n int, more string, at timestamp"
    walked = paged.read_pages(spark, path, kinds, items="items", next="next").collect()
    assert [r.v for r in walked] == ["a", None, "b", None, "c", None] and walked[0].more == '{"k": [1]}' and walked[0].at is None
    dealt = paged.read_pages(spark, path, kinds, items="items", pages_per_partition="1")
    assert sorted(r.v for r in dealt.where("v IS NOT NULL").collect()) == ["a", "b", "c", "never"] and dealt.rdd.getNumPartitions() == 4
    put(tmp_path / "y", 0, '{"items": [], "next": 9}')
    with pytest.raises(Exception, match="page 9"):
        paged.read_pages(spark, f"file://{tmp_path}/y", kinds, items="items", next="next").collect()
    (tmp_path / "z").mkdir()
    assert paged.read_pages(spark, f"file://{tmp_path}/z", kinds).count() == 0


def test_stream_resumes(spark, tmp_path):
    kinds, log, out = "v string", f"file://{tmp_path}/log", f"file://{tmp_path}/out"

    def run():
        stream = paged.stream_pages(spark, f"file://{tmp_path}/in", kinds, items="")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.v for r in spark.read.schema(kinds).parquet(out).collect())

    put(tmp_path / "in", 0, '[{"v": "a"}]')
    put(tmp_path / "in", 1, '[{"v": "b"}]')
    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    put(tmp_path / "in", 2, '[{"v": "c"}, {"v": "d"}]')
    assert run() == ["a", "b", "c", "d"]


def test_roster(spark):
    rows = [("Ann", "X", "MLA", " ", '[{"tel": "1-604", "postal": ""}]'), ("Bo", None, "", "Yale", None), ("", "Y", "MP", "K", "no list")]
    got = paged.roster(spark.createDataFrame(rows, "name string, party_name string, elected_office string, district_name string, offices string")).collect()
    assert [tuple(r) for r in got] == [("Ann", "X", "MLA", None, 1, "1604", None), ("Bo", None, None, "Yale", None, None, None), (None, "Y", "MP", "K", None, None, None)]
