"""Paged sources: tables landed as response pages and read back through the data source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources import paged
from tessera.sources.tables import Tables
from tessera.streaming.streams import shared

_ORDERS = "SELECT o_orderkey, o_totalprice, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"
_KINDS = "o_orderkey long, o_totalprice double, o_orderpriority string, day date"


def _orders(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("day"))


@query("paged_json", _ORDERS)
def paged_json(spark, d):
    path = shared(spark, "pages")
    paged.land(_orders(spark, d), path, F.col("o_orderkey") % 97, "json", "o_orderkey")
    return paged.read_pages(spark, path, _KINDS, items="response.objects").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("paged_walk", _ORDERS + " WHERE o_orderkey % 97 <= 60")
def paged_walk(spark, d):
    """A walk along the pages' links: it ends at the page without one, though later pages were landed."""
    path = shared(spark, "pages")
    paged.land(_orders(spark, d), path, F.col("o_orderkey") % 97, "json", "o_orderkey", last=60)
    return paged.read_pages(spark, path, _KINDS, items="response.objects", next="meta.next").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("paged_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def paged_csv(spark, d):
    path = shared(spark, "pages")
    paged.land(Tables(spark, d).customer.select("c_custkey", "c_name", "c_acctbal"), path, F.col("c_custkey") % 13, "csv", "c_custkey")
    return paged.read_pages(spark, path, "c_custkey long, c_name string, c_acctbal double", form="csv", pages_per_partition="3")


@query("paged_rss", "SELECT page_id, url AS link, md5(html) AS guid FROM pages")
def paged_rss(spark, d):
    path = shared(spark, "pages")
    paged.land(Tables(spark, d).pages.select("page_id", F.col("url").alias("link"), F.md5("html").alias("guid")), path, F.col("page_id") % 7, "rss", "page_id")
    return paged.read_pages(spark, path, "page_id long, link string, guid string", form="rss")


@query("paged_catalogue", "SELECT p_partkey, p_name, p_retailprice FROM part")
def paged_catalogue(spark, d):
    path = shared(spark, "pages")
    paged.land(Tables(spark, d).part.select("p_partkey", "p_name", "p_retailprice"), path, F.col("p_partkey") % 11, "catalogue", "p_partkey")
    return paged.read_pages(spark, path, "p_partkey long, p_name string, p_retailprice double", form="catalogue")


@query("paged_resumed", "SELECT event_id, event_type, value FROM events")
def paged_resumed(spark, d):
    """A stream over pages that arrive in three lots, stopped and started again between them: every row once."""
    path, out, log = shared(spark, "pages"), shared(spark, "resumed"), shared(spark, "resumed-log")
    events, kinds = Tables(spark, d).events.select("event_id", "event_type", "value"), "event_id long, event_type string, value double"
    for lot in range(3):
        part = events.where(F.col("event_id") % 3 == lot)
        paged.land(part, path, F.lit(lot * 10) + F.floor(F.col("event_id") / 3) % 10, "json", "event_id")
        stream = paged.stream_pages(spark, path, kinds, items="response.objects")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kinds).parquet(out)


@query("roster_offices", """
WITH o AS (SELECT s.*, n_name, p.place FROM supplier s JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT unnest([1, 2]) AS place) p ON p.place <= s_suppkey % 3)
SELECT s_name AS name, CASE WHEN s_suppkey % 5 > 0 THEN 'Party ' || s_suppkey % 5 END AS party, 'MLA' AS office, n_name AS riding, place::INTEGER AS place, CASE WHEN place IS NOT NULL THEN '555' || lpad((s_suppkey * 10 + place)::VARCHAR, 7, '0') END AS phone,
CASE WHEN place = 1 THEN s_suppkey || ' Main St' END AS address FROM o""")
def roster_offices(spark, d):
    t, path = Tables(spark, d), shared(spark, "pages")
    key = F.col("s_suppkey")
    office = lambda i: F.struct(F.lit("constituency").alias("type"), F.concat(F.lit("(555) "), F.lpad((key * 10 + i).cast("string"), 7, "0")).alias("tel"), (F.concat_ws(" ", key, F.lit("Main St")) if i == 1 else F.lit(" ")).alias("postal"))
    offices = F.when(key % 3 == 0, F.array()).when(key % 3 == 1, F.array(office(1))).otherwise(F.array(office(1), office(2)))
    people = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.when(key % 5 > 0, F.concat_ws(" ", F.lit("Party"), key % 5)).otherwise("").alias("party_name"), F.lit("MLA").alias("elected_office"), F.col("n_name").alias("district_name"), offices.alias("offices"), key.alias("k"))
    paged.land(people, path, F.col("k") % 5, "json", "k")
    return paged.roster(paged.read_pages(spark, path, "name string, party_name string, elected_office string, district_name string, offices string", items="response.objects"))
