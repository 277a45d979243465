"""Aggregation and time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import aggregates as ag
from tessera.operators import relational as rel
from tessera.registry import query
from tessera.sources.tables import Tables

AS_OF = "2024-01-31 00:00:00"


@query("top_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 7")
def top_counts(spark, d):
    return ag.top_counts(Tables(spark, d).part, "p_brand", 7)


@query("conditional_counts", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) AS n FROM lineitem GROUP BY 1")
def conditional_counts(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count(F.lit(1)).alias("n"))


@query("multi_distinct_filter", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_custkey) FILTER (o_totalprice > 250000) AS large, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def multi_distinct_filter(spark, d):
    return Tables(spark, d).orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.when(F.col("o_totalprice") > 250000, F.col("o_custkey"))).alias("large"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("basic_aggregates", "SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 3) AS mean, round(sum(value), 2) AS total FROM events GROUP BY 1")
def basic_aggregates(spark, d):
    return Tables(spark, d).events.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.sum("value"), 2).alias("total"))


@query("pct_guarded", "SELECT n_name, round(coalesce(100.0 * count(c_custkey) FILTER (c_acctbal < 0) / nullif(count(c_custkey), 0), 0), 6) AS pct FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def pct_guarded(spark, d):
    t = Tables(spark, d)
    n = F.nullif(F.count("c_custkey"), F.lit(0))
    return t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.round(F.coalesce(100.0 * F.count_if(F.col("c_acctbal") < 0) / n, F.lit(0.0)), 6).alias("pct"))


@query("percentile_filter", "SELECT event_type, round(quantile_cont(value, 0.5) FILTER (value > 10), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (value > 10), 6) AS p95 FROM events GROUP BY 1")
def percentile_filter(spark, d):
    v = F.when(F.col("value") > 10, F.col("value"))
    return Tables(spark, d).events.groupBy("event_type").agg(F.round(F.percentile(v, 0.5), 6).alias("p50"), F.round(F.percentile(v, 0.95), 6).alias("p95"))


def _bucket(name, sql, column):
    @query(f"time_bucket_{name}", f"SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS bucket, {sql} AS {name} FROM events GROUP BY 1")
    def run(spark, d):
        out = ag.time_buckets(Tables(spark, d).events, "ts", {name: column()}, 1440)
        return out.select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), name)

    return run


_bucket("mean_value", "round(avg(value), 8)", lambda: F.round(F.avg("value"), 8))
_bucket("p95_value", "round(quantile_cont(value, 0.95), 6)", lambda: F.round(F.percentile("value", 0.95), 6))
_bucket("events", "count(*)", lambda: F.count(F.lit(1)))
_bucket("error_share", "round(coalesce(count(*) FILTER (event_type = 'error') * 1.0 / nullif(count(*), 0), 0), 6)", lambda: F.round(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)), 6))
_bucket("users", "count(DISTINCT user_id)", lambda: F.count_distinct("user_id"))
_bucket("ratio", "round(avg(value) / nullif(avg(user_id), 0), 10)", lambda: F.round(F.try_divide(F.avg("value"), F.avg("user_id")), 10))
_bucket("peak", "max(value)", lambda: F.max("value"))


@query("minute_buckets_recent", f"SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS n FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 120 MINUTE GROUP BY 1")
def minute_buckets_recent(spark, d):
    out = ag.time_buckets(Tables(spark, d).events, "ts", {"n": F.count(F.lit(1))}, 120, F.lit(AS_OF).cast("timestamp"))
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "n")


@query("trailing_windows", f"SELECT count(*) FILTER (ts > TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE) AS m5, count(*) FILTER (ts > TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE) AS h1, count(*) FILTER (ts > TIMESTAMP '{AS_OF}' - INTERVAL 1440 MINUTE) AS d1 FROM events WHERE ts <= TIMESTAMP '{AS_OF}'")
def trailing_windows(spark, d):
    return ag.trailing(Tables(spark, d).events, "ts", F.lit(AS_OF).cast("timestamp"), {"m5": 5, "h1": 60, "d1": 1440}, F.count_if)


@query("year_histogram", "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def year_histogram(spark, d):
    return Tables(spark, d).orders.where("o_orderdate IS NOT NULL").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("group_by_expr", "SELECT CASE WHEN url LIKE '%?%' THEN 'query' WHEN url LIKE '%/' THEN 'folder' ELSE 'page' END AS kind, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1, 2")
def group_by_expr(spark, d):
    from tessera.functions.text import hostname

    kind = F.when(F.contains("url", F.lit("?")), "query").when(F.endswith("url", F.lit("/")), "folder").otherwise("page")
    return Tables(spark, d).pages.groupBy(kind.alias("kind"), hostname(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("count_of_groups", "SELECT count(*) AS n FROM (SELECT 1 FROM pages GROUP BY lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)))")
def count_of_groups(spark, d):
    from tessera.functions.text import hostname

    return Tables(spark, d).pages.select(hostname(F.col("url")).alias("host")).distinct().agg(F.count(F.lit(1)).alias("n"))


@query("having_distinct", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, count(*) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) >= 3 AND count(*) > 5")
def having_distinct(spark, d):
    return Tables(spark, d).customer.groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("segments"), F.count(F.lit(1)).alias("n")).where("segments >= 3 AND n > 5")


@query("open_end_or_last", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'O') THEN NULL ELSE strftime(max(o_orderdate), '%Y-%m-%d') END AS ended FROM orders GROUP BY 1")
def open_end_or_last(spark, d):
    t = Tables(spark, d).orders.withColumn("ended", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")))
    return t.groupBy("o_custkey").agg(ag.open_or_last_end("ended").alias("e")).select("o_custkey", F.date_format("e", "yyyy-MM-dd").alias("ended"))


@query("json_agg_ordered", "SELECT c_nationkey, string_agg('{\"k\":' || c_custkey || ',\"s\":\"' || c_mktsegment || '\"}', ',' ORDER BY c_custkey) AS people FROM customer GROUP BY 1")
def json_agg_ordered(spark, d):
    item = F.struct(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    return Tables(spark, d).customer.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.to_json(x)), ",").alias("people"))


@query("ledger_balance", "SELECT o_custkey AS user_id, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus IN ('F', 'P')), 0), 2) AS balance FROM orders GROUP BY 1")
def ledger_balance(spark, d):
    return ag.balance(Tables(spark, d).orders, "o_custkey", "o_totalprice", "o_orderstatus", ("F", "P")).withColumnRenamed("o_custkey", "user_id")


@query("daily_spend", "SELECT round(coalesce(sum(value), 0), 2) AS spent FROM events WHERE ts >= date_trunc('day', TIMESTAMP '2024-01-15 13:30:00') AND ts <= TIMESTAMP '2024-01-15 13:30:00'")
def daily_spend(spark, d):
    now = F.lit("2024-01-15 13:30:00").cast("timestamp")
    return Tables(spark, d).events.where((F.col("ts") >= F.date_trunc("day", now)) & (F.col("ts") <= now)).agg(F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("spent"))


@query("role_counts_ilike", "SELECT p_brand, count(*) FILTER (p_name ILIKE '%widget%') AS widgets, count(*) FILTER (p_name ILIKE 'small%') AS small FROM part GROUP BY 1")
def role_counts_ilike(spark, d):
    return Tables(spark, d).part.groupBy("p_brand").agg(F.count_if(F.col("p_name").ilike("%widget%")).alias("widgets"), F.count_if(F.col("p_name").ilike("small%")).alias("small"))


@query("coverage_ratio", "SELECT count(l.doc_id) AS labelled, count(*) AS total, round(coalesce(count(l.doc_id) * 1.0 / nullif(count(*), 0), 0), 6) AS ratio FROM documents LEFT JOIN labels l USING (doc_id)")
def coverage_ratio(spark, d):
    t = Tables(spark, d)
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return j.agg(F.count("hit").alias("labelled"), F.count(F.lit(1)).alias("total"), F.round(F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(0.0)), 6).alias("ratio"))


@query("coverage_matrix", """
SELECT coalesce(a.k, b.k, c.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers, coalesce(c.n, 0) AS orders
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k
FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) c ON c.k = coalesce(a.k, b.k)""")
def coverage_matrix(spark, d):
    t = Tables(spark, d)
    people = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"))
    return ag.coverage({"customers": people, "suppliers": t.supplier.select(F.col("s_nationkey").alias("nation")), "orders": t.orders.join(people, F.col("o_custkey") == F.col("c_custkey"))}, "nation")


@query("freshness_lag", """
WITH a AS (SELECT c_nationkey AS nation, max(o_orderdate)::DATE AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), b AS (SELECT s_nationkey AS nation, max(l_shipdate)::DATE AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT nation, date_diff('day', y, x)::INTEGER AS lag_days, y IS NULL OR date_diff('day', y, x) > CASE WHEN nation = 3 THEN -200 ELSE 30 END AS breach FROM a LEFT JOIN b USING (nation)""")
def freshness_lag(spark, d):
    t = Tables(spark, d)
    a = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("x"))
    b = t.lineitem.join(rel.small(t.supplier), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("nation"), F.to_date("l_shipdate").alias("y"))
    special = spark.range(1).select(F.lit(3).alias("nation"), F.lit(-200).alias("days"))
    return ag.freshness(a, b, "nation", "x", "y", 30, special).select("nation", "lag_days", "breach")


@query("plurality_vote", "SELECT o_custkey, o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) = 1")
def plurality_vote(spark, d):
    return ag.plurality(Tables(spark, d).orders, ["o_custkey"], "o_orderpriority").select("o_custkey", "o_orderpriority")


@query("rate_buckets", """
SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) > CASE user_id % 2 WHEN 0 THEN 1 ELSE 2 END AS over FROM events GROUP BY user_id, date_trunc('hour', ts)""")
def rate_buckets(spark, d):
    e = Tables(spark, d).events.withColumn("tier", F.col("user_id") % 2)
    limits = spark.range(2).select(F.col("id").alias("tier"), (F.col("id") + 1).alias("most"))
    return ag.rate_buckets(e, "ts", "user_id", "tier", limits).select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n", "over")


@query("child_min_rollup", "SELECT c_custkey, coalesce(strftime(first, '%Y-%m-%d'), 'none') AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def child_min_rollup(spark, d):
    t = Tables(spark, d)
    first = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    return t.customer.join(first, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce(F.date_format("first", "yyyy-MM-dd"), F.lit("none")).alias("first_order"))


@query("level_counts_union", "SELECT 'label' AS level, label::VARCHAR AS key, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT 'pair', (label // 2)::VARCHAR, count(*) FROM embeddings GROUP BY label // 2 UNION ALL SELECT 'half', (label // 5)::VARCHAR, count(*) FROM embeddings GROUP BY label // 5")
def level_counts_union(spark, d):
    return ag.level_counts(Tables(spark, d).embeddings, {"label": F.col("label"), "pair": F.floor(F.col("label") / 2), "half": F.floor(F.col("label") / 5)})


@query("status_labels", """
SELECT c_nationkey AS nation, CASE WHEN c_nationkey = 7 THEN 'blocked' WHEN count(*) >= 70 THEN 'live' WHEN count(*) >= 55 THEN 'partial' ELSE 'none' END AS status FROM customer GROUP BY 1""")
def status_labels(spark, d):
    from tessera.functions.classify import coverage_status

    g = Tables(spark, d).customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    previous = F.when(F.col("nation") == 7, "blocked").otherwise("none")
    return g.select("nation", coverage_status(F.col("n"), 70, 55, previous).alias("status"))


@query("grade_report", """
SELECT c_mktsegment AS party, round(100.0 * count(*) FILTER (c_acctbal > 2000) / count(*))::BIGINT AS pct,
CASE WHEN round(100.0 * count(*) FILTER (c_acctbal > 2000) / count(*)) >= 85 THEN 'A' WHEN round(100.0 * count(*) FILTER (c_acctbal > 2000) / count(*)) >= 70 THEN 'B' WHEN round(100.0 * count(*) FILTER (c_acctbal > 2000) / count(*)) >= 50 THEN 'C' WHEN round(100.0 * count(*) FILTER (c_acctbal > 2000) / count(*)) >= 30 THEN 'D' ELSE 'F' END AS grade FROM customer GROUP BY 1""")
def grade_report(spark, d):
    from tessera.functions.classify import grade

    g = Tables(spark, d).customer.groupBy(F.col("c_mktsegment").alias("party")).agg(F.round(100.0 * F.count_if(F.col("c_acctbal") > 2000) / F.count(F.lit(1))).cast("long").alias("pct"))
    return g.withColumn("grade", grade(F.col("pct")))


@query("latest_then_group", "SELECT event_type, count(*) AS users, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS pct FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def latest_then_group(spark, d):
    g = rel.latest_struct(Tables(spark, d).events, ["user_id"], ["ts", "event_id"], ["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))
    total = g.agg(F.sum("users").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("event_type", "users", F.round(100.0 * F.col("users") / F.col("total"), 3).alias("pct"))


@query("histogram_percentile", """
WITH h AS (SELECT event_type, le, (SELECT count(*) FROM events e WHERE e.event_type = x.event_type AND e.value <= le) AS cum FROM (SELECT DISTINCT event_type FROM events) x, (SELECT unnest([1, 5, 10, 25, 50, 100, 100000]) AS le))
SELECT event_type, min(le)::INTEGER AS bound FROM h WHERE cum >= 0.95 * (SELECT max(cum) FROM h g WHERE g.event_type = h.event_type) GROUP BY 1""")
def histogram_percentile(spark, d):
    e = Tables(spark, d).events
    le = F.explode(F.array(*(F.lit(x) for x in (1, 5, 10, 25, 50, 100, 100000)))).alias("le")
    h = e.select("event_type", "value", le).groupBy("event_type", "le").agg(F.count_if(F.col("value") <= F.col("le")).alias("cum"))
    return ag.histogram_percentile(h, ["event_type"], "le", "cum", 0.95)


@query("slow_requests", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 25")
def slow_requests(spark, d):
    return Tables(spark, d).events.where("event_type = 'error'").orderBy(F.desc("value"), "event_id").limit(25).select("event_id", "user_id", "value")


@query("rolling_window", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def rolling_window(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return Tables(spark, d).events.select("event_id", F.round(F.avg("value").over(w), 6).alias("rolling"))


@query("session_windows", """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_windows(spark, d):
    g = Tables(spark, d).events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t"))
    return g.select("user_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")
