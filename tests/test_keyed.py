"""Keyed state over rows that come late, twice, or not in order."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from tessera.plans import keyed as plans
from tessera.streaming import keyed
from tessera.streaming import streams as st

KINDS = "id long, ts timestamp, key long, bad boolean, kind string"


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def stream(spark, path, lots):
    for i, rows in enumerate(lots):
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path.removeprefix("file://")):  # files are taken in order of their times
            full = os.path.join(path.removeprefix("file://"), name)
            if name.startswith("part-") and os.path.getmtime(full) > 10**9 + 10_000:
                os.utime(full, (10**9 + i, 10**9 + i))
    return st.file_stream(spark, path, KINDS, 1)


FLUSH = [(0, datetime(2030, 1, 1), k, False, "flush") for k in (7, 8)]


def test_failures(spark, tmp_path):
    lots = [
        [(1, at(1), 7, True, "x"), (3, at(3), 7, True, "x"), (10, at(1), 8, False, "x")],
        [(2, at(2), 7, False, "x"), (3, at(3), 7, True, "x"), (4, at(3), 7, True, "x")],  # one late, one again, one at the same time
        [(9, at(20), 7, True, "x"), (11, at(20), 8, True, "x")],
        [(12, at(21), 8, True, "x")],
        [(5, at(2, 5), 7, True, "x"), (3, at(3), 7, True, "x")],  # behind the watermark: dropped
        FLUSH,
    ]
    with keyed.rocksdb(spark):
        out = st.drain(keyed.failure_counters(stream(spark, f"file://{tmp_path}/in", lots), "key", "ts", "id", F.col("bad"), "5 days"), "failures")
    got = sorted((r.key, r.id, r.failures, r.changed_at.day) for r in out.collect())
    assert got == [(7, 1, 1, 1), (7, 2, 0, 2), (7, 3, 1, 3), (7, 4, 2, 3), (7, 9, 3, 3), (8, 10, 0, 1), (8, 11, 1, 20), (8, 12, 2, 20)]


def test_alerts(spark, tmp_path):
    lots = [
        [(1, at(1, 1), 7, True, "x"), (2, at(2), 7, True, "x"), (3, at(2, 9), 7, True, "y")],
        [(4, at(1, 20), 7, True, "x"), (1, at(1, 1), 7, True, "x"), (5, at(9), 7, True, "x")],
        [(6, at(25), 7, True, "x")],
        FLUSH,
    ]
    saved = spark.createDataFrame([(1, "x", at(1, 12), "daily"), (2, "y", None, "weekly"), (3, "x", None, "never"), (4, "z", None, "daily")], "sid long, wanted string, last_checked_at timestamp, cadence string")
    source = stream(spark, f"file://{tmp_path}/in", lots)
    with keyed.rocksdb(spark):
        out = st.drain(keyed.saved_search_alerts(source, saved, F.col("kind") == F.col("wanted"), "ts", "id", "5 days", {"daily": 86_400, "weekly": 604_800}, 3), "alerts")
    got = sorted((r.search, r.id, r.sent_at.day) for r in out.collect())
    assert got == [(1, 2, 2), (1, 4, 2), (1, 5, 9), (1, 6, 25), (2, 3, 4)]
    assert spark.conf.get(keyed.STORE, "") != keyed.ROCKSDB


def test_many_keys_share_a_state(spark, tmp_path):
    """200 keys, one of them null, in three shards and one for it."""
    lots = [[(i, at(1 + lot, i % 20), None if i % 200 == 7 else i % 200, (i // 200 + i) % 3 > 0, "x") for i in range(lot * 600, lot * 600 + 600)] for lot in range(3)]
    lots.append([(-1, datetime(2030, 1, 1), k, False, "flush") for k in (*range(200), None)])
    with keyed.rocksdb(spark):
        out = st.drain(keyed.failure_counters(stream(spark, f"file://{tmp_path}/in", lots), "key", "ts", "id", F.col("bad"), "5 days", 3), "failures")
    got = {(r.key, r.id): (r.failures, r.changed_at) for r in out.collect()}
    want, state = {}, {}
    for i, ts, key, bad, _ in sorted((r for lot in lots[:-1] for r in lot), key=lambda r: (r[1], r[0])):
        n, changed = state.get(key, (0, None))
        after = n + 1 if bad else 0
        state[key] = after, ts if changed is None or (after > 0) != (n > 0) else changed
        want[key, i] = state[key]
    assert got == want and len(want) == 1800 and any(k is None for k, _ in got)


def test_lots_are_written_by_several_tasks(spark, tmp_path):
    spark.range(2000).selectExpr("id AS event_id", "timestamp_seconds(id * 100) AS ts", "id % 9 AS user_id", "'error' AS event_type", "0.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    source, _ = plans._in_lots(spark, str(tmp_path))
    rows = st.drain(source.withColumn("file", F.input_file_name()), "seen").groupBy("file").count().collect()
    assert len(rows) > 5 * 10 and max(r["count"] for r in rows) < 200
