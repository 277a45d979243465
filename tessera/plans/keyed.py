"""Keyed streaming state, drained over the events in lots with late and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import SCHEMAS, Tables
from tessera.streaming import keyed
from tessera.streaming import streams as st

LOTS = 4
FILES = 16  # of a lot


def _in_lots(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """(stream of the events, how late they may be): in lots by time, of which every fifth row comes one lot late and every
    seventh comes again; a last row a user, far behind all others, moves the watermark past them.
    """
    events, path = Tables(spark, d).events, st.shared(spark, "lots")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    width = int((last - first).total_seconds() // LOTS) + 1
    lot = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit(first))) / width)
    dealt = events.withColumn("lot", F.array(F.when(F.col("event_id") % 5 == 0, lot + 1).otherwise(lot), F.when(F.col("event_id") % 7 == 0, lot + 1)))
    dealt = dealt.withColumn("lot", F.explode("lot")).where("lot IS NOT NULL")
    for i in range(LOTS + 1):
        dealt.where(F.col("lot") == i).drop("lot").repartition(FILES).write.mode("append").parquet(path)
    flush = events.select("user_id").distinct().select(F.lit(-1).cast("long").alias("event_id"), (F.lit(last) + F.make_dt_interval(secs=F.lit(width * 20))).alias("ts"), "user_id", F.lit("flush").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    flush.repartition(FILES).write.mode("append").parquet(path)
    return st.file_stream(spark, path, SCHEMAS["events"], FILES), f"{width * 2} seconds"


@query("failure_counter_stream", """
WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER w AS g, event_type = 'error' AS bad, lag(event_type = 'error') OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, count(*) FILTER (bad) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS failures,
strftime(last_value(CASE WHEN was IS NULL OR bad <> was THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), '%Y-%m-%d %H:%M:%S') AS changed_at FROM i""")
def failure_counter_stream(spark, d):
    with keyed.rocksdb(spark):
        stream, late = _in_lots(spark, d)
        out = st.drain(keyed.failure_counters(stream, "user_id", "ts", "event_id", F.col("event_type") == "error", late), "failures")
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "failures", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss").alias("changed_at"))


@query("alert_stream_marks", """
WITH s AS (SELECT * FROM (VALUES (1, 'error', TIMESTAMP '2024-01-10', 86400), (2, 'signup', NULL, 604800), (3, 'view', TIMESTAMP '2024-01-20 12:00:00', 86400)) t(sid, kind, mark, step))
SELECT sid::BIGINT AS search, event_id AS id, strftime(make_timestamp((ceil(epoch_us(ts) / (step * 1000000.0))::BIGINT * step * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS sent_at FROM events JOIN s ON event_type = kind WHERE mark IS NULL OR ts > mark""")
def alert_stream_marks(spark, d):
    """Every new item of a saved search once, at its cadence's next tick, however late or often it arrives."""
    saved = [(1, "error", "2024-01-10", "daily"), (2, "signup", None, "weekly"), (3, "view", "2024-01-20 12:00:00", "daily"), (4, "click", None, "never")]
    searches = spark.createDataFrame(saved, "sid long, kind string, mark string, cadence string").select("sid", "kind", F.col("mark").cast("timestamp").alias("last_checked_at"), "cadence")
    with keyed.rocksdb(spark):
        stream, late = _in_lots(spark, d)
        out = st.drain(keyed.saved_search_alerts(stream, searches, F.col("event_type") == F.col("kind"), "ts", "event_id", late, {"daily": 86_400, "weekly": 604_800}), "alerts")
    return out.select("search", "id", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at"))
