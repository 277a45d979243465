"""Join, ranking, paging and set queries over the star tables.

Stand-ins: customer for people (segment for party, nation for province), orders for their dated
statements, lineitem for votes, events for scans and telemetry.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relational as rel
from tessera.registry import query
from tessera.sources.tables import Tables


def day(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


@query("scan_pushed", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_discount > 0.05")
def scan_pushed(spark, d):
    t = Tables(spark, d)
    return t.lineitem.where((F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")) & (F.col("l_discount") > 0.05)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("equi_join_three", "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def equi_join_three(spark, d):
    t = Tables(spark, d)
    dims = rel.small(t.nation.join(rel.small(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    people = t.customer.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    return t.orders.join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("left_hydration", "SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_hydration(spark, d):
    t = Tables(spark, d)
    return t.documents.select("doc_id").join(t.labels.withColumn("hit", F.lit(True)), "doc_id", "left").select("doc_id", "quality", "toxic", F.coalesce("hit", F.lit(False)).alias("labelled"))


@query("composite_key_join", "SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 1000) = floor(s_acctbal / 1000) JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def composite_key_join(spark, d):
    t = Tables(spark, d)
    on = ["n_nationkey", "band"]
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.floor(F.col("c_acctbal") / 1000).alias("band"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), F.floor(F.col("s_acctbal") / 1000).alias("band"))
    met = rel.small(rel.keys_in_both(c, s, on).join(rel.small(t.nation), "n_nationkey"))
    n = lambda side, key, name: side.join(met, on).groupBy("n_name").agg(F.count_distinct(key).alias(name))
    return n(c, "c_custkey", "customers").join(n(s, "s_suppkey", "suppliers"), "n_name")


@query("latest_per_key", "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, d):
    t = Tables(spark, d)
    return rel.latest_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", day("o_orderdate").alias("order_day"), "o_totalprice")


@query("latest_event_join", "SELECT c_custkey, e.event_type, e.value FROM customer LEFT JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e ON user_id = c_custkey")
def latest_event_join(spark, d):
    t = Tables(spark, d)
    last = rel.latest_struct(t.events, ["user_id"], ["ts", "event_id"], ["event_type", "value"])
    return t.customer.join(last, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", "event_type", "value")


@query("distinct_on_latest_then_count", "SELECT event_type, count(*) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY event_type")
def distinct_on_latest_then_count(spark, d):
    t = Tables(spark, d)
    return rel.latest_struct(t.events, ["user_id"], ["ts", "event_id"], ["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("top_m_per_group", "SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS r FROM orders QUALIFY r <= 5")
def top_m_per_group(spark, d):
    t = Tables(spark, d)
    return rel.top_m_per_group(t.orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5, "r").select("o_orderpriority", "o_orderkey", "o_totalprice", "r")


@query("lateral_counts_zero_filled", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")
def lateral_counts_zero_filled(spark, d):
    t = Tables(spark, d)
    return rel.counts_zero_filled(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'F'"), "c_custkey", "o_custkey")


@query("correlated_scalar", "SELECT c_custkey, (SELECT max_by(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS last_large FROM customer")
def correlated_scalar(spark, d):
    t = Tables(spark, d)
    last = t.orders.where("o_totalprice > 100000").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_large"))
    return t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_large")


@query("ordered_agg_string", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def ordered_agg_string(spark, d):
    t = Tables(spark, d)
    keys = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.array_join(keys, ",").alias("keys"))


@query("exists_semi", "SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1)")
def exists_semi(spark, d):
    t = Tables(spark, d)
    return t.documents.select("doc_id", "lang").join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query("not_exists_anti", "SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def not_exists_anti(spark, d):
    t = Tables(spark, d)
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_anti")


@query("interval_join_half_open", """
WITH terms AS (SELECT o_custkey, o_orderkey, o_orderdate AS started, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ended FROM orders)
SELECT c.c_custkey, p.day::VARCHAR AS at, t.o_orderkey FROM customer c CROSS JOIN (SELECT unnest([DATE '1996-01-01', DATE '1998-07-01', DATE '2001-01-01']) AS day) p
JOIN terms t ON t.o_custkey = c.c_custkey AND t.started <= p.day AND (t.ended IS NULL OR p.day < t.ended)""")
def interval_join_half_open(spark, d):
    t = Tables(spark, d)
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    terms = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderdate").alias("started"), F.lead("o_orderdate").over(w).alias("ended"))
    facts = t.customer.select("c_custkey", F.explode(F.array(*(F.lit(x).cast("timestamp") for x in ("1996-01-01", "1998-07-01", "2001-01-01")))).alias("at_ts"))
    return rel.interval_join(facts, terms, ["c_custkey"], "at_ts", "started", "ended", how="inner").select("c_custkey", day("at_ts").alias("at"), "o_orderkey")


@query("interval_join_closed", """
WITH terms AS (SELECT o_custkey, o_orderkey, o_orderdate AS started, o_orderdate + INTERVAL 90 DAY AS ended FROM orders)
SELECT o.o_orderkey, count(t.o_orderkey) AS n FROM orders o LEFT JOIN terms t ON t.o_custkey = o.o_custkey AND t.started <= o.o_orderdate AND o.o_orderdate <= t.ended GROUP BY o.o_orderkey""")
def interval_join_closed(spark, d):
    t = Tables(spark, d)
    terms = t.orders.select("o_custkey", F.col("o_orderkey").alias("term"), F.col("o_orderdate").alias("started"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("ended"))
    return rel.interval_join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), terms, ["o_custkey"], "o_orderdate", "started", "ended", closed="both").groupBy("o_orderkey").agg(F.count("term").alias("n"))


@query("date_in_range_join", """
WITH s AS (SELECT y AS session, make_timestamp(y, 1, 1, 0, 0, 0) AS a, make_timestamp(y + 1, 1, 1, 0, 0, 0) AS b FROM range(1995, 2002) r(y))
SELECT session, count(*) AS n FROM orders JOIN s ON o_orderdate >= a AND o_orderdate < b GROUP BY session""")
def date_in_range_join(spark, d):
    t = Tables(spark, d)
    y = spark.range(1995, 2002).select(F.col("id").alias("session"), F.make_timestamp(F.col("id").cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("a"), F.make_timestamp((F.col("id") + 1).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("b"))
    return rel.range_bucket_join(t.orders.select("o_orderdate"), y, "o_orderdate", "a", "b", 86400 * 30).groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@query("or_join_as_union", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey OR (s_nationkey = c_nationkey AND floor(c_acctbal) % 97 = floor(s_acctbal) % 97)")
def or_join_as_union(spark, d):
    t = Tables(spark, d)
    c, s = t.customer.withColumn("m", F.floor("c_acctbal") % 97), t.supplier.withColumn("m2", F.floor("s_acctbal") % 97)
    return rel.or_equi_join(c, s, [c.c_custkey == s.s_suppkey, (c.c_nationkey == s.s_nationkey) & (c.m == s.m2)]).select("c_custkey", "s_suppkey")


@query("matrix_missing", "SELECT c_custkey, p.o_orderpriority FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderpriority = p.o_orderpriority)")
def matrix_missing(spark, d):
    t = Tables(spark, d)
    have = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return rel.missing_pairs(t.customer.select("c_custkey"), have.select("o_orderpriority").distinct(), have, ["c_custkey", "o_orderpriority"])


@query("duplicate_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, a.k AS key FROM (SELECT vec_id, vec_id // 3 AS k FROM embeddings) a JOIN (SELECT vec_id, vec_id // 3 AS k FROM embeddings) b ON a.k = b.k AND a.vec_id < b.vec_id")
def duplicate_pairs(spark, d):
    t = Tables(spark, d)
    return rel.duplicate_pairs(t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 3).alias("key")), "key", "vec_id")


@query("duplicate_pairs_overlap", """
WITH w AS (SELECT c_nationkey, c_custkey, c_mktsegment, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT x.c_custkey AS a, y.c_custkey AS b FROM w x JOIN w y ON x.c_nationkey = y.c_nationkey AND x.c_mktsegment = y.c_mktsegment AND x.c_custkey < y.c_custkey AND x.a < y.b AND y.a < x.b""")
def duplicate_pairs_overlap(spark, d):
    t = Tables(spark, d)
    w = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    w = w.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("key", F.concat("c_nationkey", F.lit("/"), "c_mktsegment")).select("key", "c_custkey", "first", "last")
    return rel.crowded_pairs(w, "key", "c_custkey", (F.col("a.first") < F.col("b.last")) & (F.col("b.first") < F.col("a.last"))).select("a", "b")


@query("join_on_json_key", "SELECT k, count(*) AS n, count(p_partkey) AS parts FROM (SELECT (props->>'$.k')::BIGINT AS k FROM events) e LEFT JOIN part ON p_partkey = k GROUP BY k")
def join_on_json_key(spark, d):
    t = Tables(spark, d)
    e = t.events.select(F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.join(t.part.select("p_partkey"), F.col("k") == F.col("p_partkey"), "left").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("p_partkey").alias("parts"))


@query("as_of_join", "SELECT e.event_id, o.o_orderkey AS asof_o_orderkey FROM (SELECT *, ts - INTERVAL 25 YEAR AS at FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.at >= o.o_orderdate")
def as_of_join(spark, d):
    t = Tables(spark, d)
    left = t.events.select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 25 YEARS")).alias("at"))
    right = t.orders.groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return rel.as_of(left, right, ["user_id"], "at", "o_orderdate", ["o_orderkey"]).select("event_id", "asof_o_orderkey")


@query("self_exclusion", "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderkey <> (SELECT min(o_orderkey) FROM orders)")
def self_exclusion(spark, d):
    t = Tables(spark, d)
    m = t.orders.agg(F.min("o_custkey").alias("c"), F.min("o_orderkey").alias("k"))
    return t.orders.join(F.broadcast(m), (F.col("o_custkey") == F.col("c")) & (F.col("o_orderkey") != F.col("k"))).select("o_orderkey")


@query("unique_candidate_gate", "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer WHERE c_acctbal > 9000 GROUP BY ALL HAVING count(DISTINCT c_custkey) = 1")
def unique_candidate_gate(spark, d):
    t = Tables(spark, d)
    return rel.unique_candidate(t.customer.where("c_acctbal > 9000"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("window_count_gate", "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000 QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) = 1")
def window_count_gate(spark, d):
    t = Tables(spark, d)
    return rel.window_count_gate(t.customer.where("c_acctbal > 9000"), ["c_nationkey", "c_mktsegment"]).select("c_custkey", "c_nationkey")


@query("page_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def page_offset(spark, d):
    t = Tables(spark, d)
    return rel.page(t.orders, [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 3, 20).select("o_orderkey", "o_totalprice")


@query("page_totals", "SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM orders WHERE o_orderstatus = 'P'")
def page_totals(spark, d):
    return rel.page_totals(Tables(spark, d).orders.where("o_orderstatus = 'P'"))


@query("null_order_sort", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.quality DESC NULLS FIRST, d.doc_id LIMIT 50")
def null_order_sort(spark, d):
    t = Tables(spark, d)
    return rel.page(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), [F.desc_nulls_first("quality"), F.asc("doc_id")], 1, 50).select("doc_id", "quality")


@query("sort_by_parent", "SELECT n_name, r_name, row_number() OVER (ORDER BY r_name <> 'EUROPE', r_name, n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def sort_by_parent(spark, d):
    t = Tables(spark, d)
    # Ranks by counting, so no global window: the side is a list of nations.
    rows = t.nation.join(rel.small(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", F.concat_ws("\x01", (F.col("r_name") != "EUROPE").cast("int").cast("string"), "r_name", "n_name").alias("k"))
    other = rows.select(F.col("k").alias("k2"))
    return rows.join(rel.small(other), F.col("k2") <= F.col("k")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("place"))


@query("sort_by_role_rank", "SELECT role, n, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS place FROM (SELECT role, count(*) AS n FROM conversations GROUP BY role) ORDER BY place")
def sort_by_role_rank(spark, d):
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return Tables(spark, d).conversations.groupBy("role").agg(F.count(F.lit(1)).alias("n")).withColumn("place", rank).orderBy("place")


def _metric_sort(name, order_sql):
    @query(f"sort_key_{name}", f"SELECT o_custkey, count(*) AS mentions, round(avg(o_totalprice), 2) AS average, max(o_totalprice) AS best FROM orders GROUP BY o_custkey ORDER BY {order_sql}, o_custkey LIMIT 15")
    def run(spark, d):
        g = Tables(spark, d).orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("mentions"), F.round(F.avg("o_totalprice"), 2).alias("average"), F.max("o_totalprice").alias("best"))
        return g.orderBy(F.desc(name), F.asc("o_custkey")).limit(15)

    return run


for _name in ("mentions", "average", "best"):
    _metric_sort(_name, f"{_name} DESC")


@query("two_stage_limit", "SELECT * FROM (SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) ORDER BY order_day DESC, o_orderkey LIMIT 50")
def two_stage_limit(spark, d):
    t = Tables(spark, d)
    pool = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_totalprice", day("o_orderdate").alias("order_day"))
    return pool.orderBy(F.desc("order_day"), "o_orderkey").limit(50)


@query("union_all_ranked", """
SELECT key, name, preference FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY preference, name) AS r FROM (
SELECT s_suppkey AS key, s_name AS name, 0 AS preference FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT c_custkey, c_name, 1 FROM customer UNION ALL SELECT p_partkey, p_name, 2 FROM part)) WHERE r = 1""")
def union_all_ranked(spark, d):
    t = Tables(spark, d)
    parts = [t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))]
    return rel.ranked_union(parts, ["key"], [F.asc("name")])


@query("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    t = Tables(spark, d)
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("intersect_except", "(SELECT 'both' AS kind, k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT user_id FROM events)) UNION ALL (SELECT 'only', k FROM (SELECT s_suppkey AS k FROM supplier EXCEPT SELECT user_id FROM events))")
def intersect_except(spark, d):
    t = Tables(spark, d)
    users = t.events.select(F.col("user_id").alias("k"))
    both = t.customer.select(F.col("c_custkey").alias("k")).intersect(users)
    only = t.supplier.select(F.col("s_suppkey").alias("k")).subtract(users)
    return both.select(F.lit("both").alias("kind"), "k").unionByName(only.select(F.lit("only").alias("kind"), "k"))


@query("array_set_diff", """
WITH p AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS old, list(DISTINCT o_orderpriority) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS new FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_sort(list_filter(coalesce(new, []), lambda x: NOT list_contains(coalesce(old, []), x))), ',') AS added,
       array_to_string(list_sort(list_filter(coalesce(old, []), lambda x: NOT list_contains(coalesce(new, []), x))), ',') AS removed FROM p""")
def array_set_diff(spark, d):
    t = Tables(spark, d)
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    g = t.orders.groupBy("o_custkey").agg(F.collect_set(F.when(old, F.col("o_orderpriority"))).alias("old"), F.collect_set(F.when(~old, F.col("o_orderpriority"))).alias("new"))
    show = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return g.select("o_custkey", show("new", "old").alias("added"), show("old", "new").alias("removed"))


@query("context_window", """
SELECT conv_id, turn, coalesce(array_to_string(list(turn) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS before, coalesce(array_to_string(list(turn) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS after
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_window(spark, d):
    t = Tables(spark, d)
    out = rel.neighbours(t.conversations.select("conv_id", "turn"), ["conv_id"], "turn", 2, 2, "turn")
    return out.select("conv_id", "turn", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("before", "after")))


# -- merges ------------------------------------------------------------------------------------


@query("upsert_ignore", """
WITH old AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT o_custkey AS k, min(o_orderpriority) AS v FROM orders GROUP BY 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)""")
def upsert_ignore(spark, d):
    t = Tables(spark, d)
    old = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return rel.upsert(old, t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("v")), ["k"])


@query("upsert_highest_confidence", """
WITH old AS (SELECT c_custkey AS k, c_acctbal AS conf, 'old' AS v FROM customer), new AS (SELECT s_suppkey AS k, s_acctbal AS conf, 'new' AS v FROM supplier)
SELECT k, conf, v FROM (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new) QUALIFY row_number() OVER (PARTITION BY k ORDER BY conf DESC NULLS LAST, n) = 1""")
def upsert_highest_confidence(spark, d):
    t = Tables(spark, d)
    old = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("conf"), F.lit("old").alias("v"))
    return rel.upsert(old, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("conf"), F.lit("new").alias("v")), ["k"], "highest", "conf")


@query("update_from_values", "SELECT p_partkey, coalesce(n.price, p_retailprice) AS p_retailprice FROM part LEFT JOIN (SELECT l_partkey, round(avg(l_extendedprice / l_quantity), 2) AS price FROM lineitem GROUP BY 1) n ON l_partkey = p_partkey")
def update_from_values(spark, d):
    t = Tables(spark, d)
    new = t.lineitem.groupBy("l_partkey").agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 2).alias("price"))
    return t.part.join(new, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("price", "p_retailprice").alias("p_retailprice"))


@query("sync_denormalised", "SELECT doc_id, l.quality, coalesce(l.quality, -1) <> 1 OR l.quality IS NULL AS changed FROM documents LEFT JOIN labels l USING (doc_id)")
def sync_denormalised(spark, d):
    t = Tables(spark, d)
    child = t.documents.select("doc_id", F.lit(1).alias("quality"))
    return rel.sync_columns(child, t.labels, "doc_id", ["quality"])


@query("claim_next_job", "SELECT event_type, event_id FROM events WHERE value < 50 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts, event_id) = 1")
def claim_next_job(spark, d):
    return rel.claim_next(Tables(spark, d).events.where("value < 50"), ["event_type"], [F.desc("value"), F.asc("ts"), F.asc("event_id")]).select("event_type", "event_id")


@query("stale_jobs_released", """
SELECT event_id, CASE WHEN s THEN 'queued' ELSE event_type END AS event_type, CASE WHEN NOT s THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS claimed
FROM (SELECT *, event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 600 MINUTE AS s FROM events)""")
def stale_jobs_released(spark, d):
    e = Tables(spark, d).events
    now = F.lit(e.agg(F.max("ts")).first()[0])  # one value
    out = rel.release_stale(e.select("event_id", "event_type", F.col("ts").alias("claimed")), "event_type", "claimed", now, 600, "click")
    return out.select("event_id", "event_type", F.date_format("claimed", "yyyy-MM-dd HH:mm:ss").alias("claimed"))


@query("one_per_handle", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, lower(trim(CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) || ' ' ELSE lower(c_mktsegment) END)) ORDER BY c_acctbal DESC, c_custkey) = 1")
def one_per_handle(spark, d):
    """Handles that differ in case or in blanks around them are one."""
    c = Tables(spark, d).customer
    handle = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper("c_mktsegment"), F.lit(" "))).otherwise(F.lower("c_mktsegment"))
    return rel.one_per_handle(c.withColumn("handle", handle), ["c_nationkey"], "handle", [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_nationkey", "c_custkey")


@query("merge_duplicates", "SELECT c_custkey AS id, max_by(c_custkey, (c_acctbal, c_custkey)) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 2500)) AS canonical_id FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 2500)) > 1")
def merge_duplicates(spark, d):
    c = Tables(spark, d).customer.withColumn("key", F.concat_ws("/", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 2500)))
    return rel.merge_duplicates(c, "key", "c_custkey", ["c_acctbal", "c_custkey"])


@query("retag_by_date", """
WITH s AS (SELECT date_trunc('year', o_orderdate) AS y, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT l_orderkey, l_linenumber, year(y)::INTEGER AS session FROM lineitem JOIN s ON l_shipdate BETWEEN a AND b""")
def retag_by_date(spark, d):
    t = Tables(spark, d)
    s = t.orders.groupBy(F.year("o_orderdate").alias("session")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", F.year("l_shipdate").alias("session"))
    # sessions lie inside their years, so the year is an equality key
    return rel.interval_join(items, s, ["session"], "l_shipdate", "a", "b", closed="both", how="inner").select("l_orderkey", "l_linenumber", "session")


@query("retention_gc", "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS kept, count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS removed FROM events")
def retention_gc(spark, d):
    return rel.retention(Tables(spark, d).events, "ts", F.lit("2024-01-20").cast("timestamp"))


@query("promote_run", "SELECT label AS run_id, count(*) AS members, label = 3 AS is_current FROM embeddings GROUP BY label")
def promote_run(spark, d):
    runs = Tables(spark, d).embeddings.groupBy(F.col("label").alias("run_id")).agg(F.count(F.lit(1)).alias("members"))
    return rel.promote(runs, "run_id", 3)
