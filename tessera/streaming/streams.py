"""Structured Streaming operators: the same definitions as their batch forms, over file sources."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import small


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster shares; a temporary one only where a local session names none."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(stream: DataFrame, ts: str, width: str, late: str, measures: Mapping[str, Column], keys: tuple = ()) -> DataFrame:
    """Windowed aggregates with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(*(c.alias(k) for k, c in measures.items())).select(F.col("w.start").alias("bucket"), *keys, *measures)


def sliding(stream: DataFrame, ts: str, width: str, step: str, late: str, measures: Mapping[str, Column]) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w")).agg(*(c.alias(k) for k, c in measures.items())).select(F.col("w.start").alias("bucket"), *measures)


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("started"), "n")


def idempotent(stream: DataFrame, ts: str, keys: list[str], overlap: str = "14 days") -> DataFrame:
    """Rows once by key although the source repeats the last days: at-least-once in, exactly-once out."""
    return stream.withWatermark(ts, overlap).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what its sink holds, as a table in the shared folder.

    In complete mode each batch replaces the table.
    """
    spark = stream.sparkSession
    out = shared(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", shared(spark, f"{name}-log")).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def due(searches: DataFrame, as_of: Column, daily: str = "daily", weekly: str = "weekly") -> DataFrame:
    """Saved searches whose cadence has passed since they were last checked; never checked ones are due."""
    days = F.when(F.col("cadence") == daily, 1).when(F.col("cadence") == weekly, 7)
    return searches.where(days.isNotNull() & (F.col("last_checked_at").isNull() | (F.col("last_checked_at") < as_of - F.make_dt_interval(days=days))))


def new_matches(items: DataFrame, searches: DataFrame, match: Callable[[], Column], ts: str, as_of: Column, first_days: int = 30) -> DataFrame:
    """Items of each search since its mark (the last month the first time); the mark is event time."""
    since = F.coalesce(F.col("last_checked_at"), as_of - F.make_dt_interval(days=F.lit(first_days)))
    return items.join(small(searches), match()).where((F.col(ts) > since) & (F.col(ts) <= as_of))


def alert_stream(stream: DataFrame, searches: DataFrame, match: Callable[[], Column], ts: str, as_of: Column, sink: Callable[[DataFrame, int], None], log: str):
    """Alerts of each micro-batch of new items to a sink; at least once, so the sink should be keyed."""
    batch = lambda df, n: sink(new_matches(df, due(searches, as_of), match, ts, as_of), n)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", log).trigger(availableNow=True).start()


def pending(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Queue drain: what has no result yet."""
    return source.join(done.select(key), key, "left_anti")
