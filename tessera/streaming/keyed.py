"""Keyed state with timers: failure counters and saved-search alerts that do not depend on the order of arrival.

Rows wait in a key's state until the watermark has passed them, so that late and repeated rows within the delay fall into
place; a timer on the earliest one wakes the state.  What is behind the watermark is dropped by Spark.  Many keys share a state, a
shard of them, whose rows are worked as columns: a batch costs a read and a write a shard, not a key.  State is kept in RocksDB;
its checkpoint lies in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """State with timers needs this store; the session's own choice comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def _packed(frame: pd.DataFrame) -> bytes:
    sink, rows = pa.BufferOutputStream(), pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(rows).read_pandas()


class _Waiting(StatefulProcessor):
    """Holds (key, microseconds, id, flag) rows, each id of a key once, until a time has passed; subclasses say until when and what then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("waiting", "rows binary, timer long")

    def due(self, us: np.ndarray) -> np.ndarray:
        """When rows of these times are looked at, in milliseconds: the watermark must have reached it."""
        return -(-us // 1000)

    def ready(self, key, rows: pd.DataFrame, now: int) -> Iterator[pd.DataFrame]:
        """rows: in order of key, time and id."""
        raise NotImplementedError

    def held(self) -> tuple[list[pd.DataFrame], int | None]:
        if not self.rows.exists():
            return [], None
        rows, timer = self.rows.get()
        return [_unpacked(bytes(rows))], timer

    def wake(self, waiting: pd.DataFrame, before: int | None) -> None:
        """Keep the rows, and one timer: on the first that comes due."""
        first = int(self.due(waiting["us"].to_numpy()).min()) if len(waiting) else None
        if before is not None and before != first:
            self.handle.deleteTimer(before)
        if first is None:
            self.rows.clear()
            return
        self.rows.update((_packed(waiting), first))
        if before != first:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, before = self.held()
        self.wake(pd.concat([*held, *(r[["key", "us", "id", "flag"]] for r in rows)], ignore_index=True).drop_duplicates(["key", "id"]), before)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (held, before) = timerValues.getCurrentWatermarkInMs(), self.held()
        if held:
            past = self.due(held[0]["us"].to_numpy()) <= now
            self.wake(held[0][~past], before)
            if past.any():
                yield from self.ready(key, held[0][past].sort_values(["key", "us", "id"]), now)

    def close(self) -> None:
        pass


class _Failures(_Waiting):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "rows binary")

    def ready(self, key, rows, now):
        k, us, failed, at = rows["key"].to_numpy(), rows["us"].to_numpy(), rows["flag"].to_numpy(bool), np.arange(len(rows))
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        group = np.repeat(np.arange(len(heads)), np.diff([*heads, len(k)]))
        first = heads[group]  # where a row's key begins
        known = _unpacked(bytes(self.count.get()[0])) if self.count.exists() else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("key", "failures", "changed")})
        place = pd.Index(known["key"]).get_indexer(k[heads])
        had = lambda c: np.append(known[c].to_numpy(), 0)[place]  # noqa: E731  # of the keys, 0 of new ones
        ended = np.maximum.accumulate(np.where(failed, -1, at))  # the last row that did not fail
        n = np.where(ended >= first, at - ended, had("failures")[group] + at - first + 1)
        was = np.where(at == first, had("failures")[group], np.append(0, n[:-1]))
        turned = ((n > 0) != (was > 0)) | ((at == first) & (place < 0)[group])
        last = np.maximum.accumulate(np.where(turned, at, -1))
        changed = np.where(last >= first, us[last], had("changed")[group])
        ends = np.append(heads[1:], len(k)) - 1
        now_known = pd.DataFrame({"key": k[ends], "failures": n[ends], "changed": changed[ends]})
        self.count.update((_packed(pd.concat([known, now_known]).drop_duplicates("key", keep="last")),))
        yield pd.DataFrame({"key": pd.array([None] * len(k), "Int64") if key[0] < 0 else k, "id": rows["id"].to_numpy(), "failures": n, "changed_at": pd.to_datetime(changed, unit="us")})


class _Alerts(_Waiting):
    def __init__(self, cadence_ms: dict[str, int]):
        self.cadence = cadence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.mark = handle.getValueState("mark", "ms long")
        self.step = None

    def due(self, us: np.ndarray) -> np.ndarray:
        return -(-us // (self.step * 1000)) * self.step

    def handleInputRows(self, key, rows, timerValues):
        self.step = self.cadence[key[1]]
        yield from super().handleInputRows(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.step = self.cadence[key[1]]
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def ready(self, key, rows, now):
        mark = self.mark.get()[0] if self.mark.exists() else None
        rows = rows if mark is None else rows[rows["us"] > mark * 1000]
        self.mark.update((now // self.step * self.step,))
        if len(rows):
            yield pd.DataFrame({"search": key[0], "id": rows["id"].to_numpy(), "sent_at": pd.to_datetime(self.due(rows["us"].to_numpy()), unit="ms")})


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late)


def failure_counters(stream: DataFrame, key: str, ts: str, id_col: str, failed: Column, late: str, shards: int = 1024) -> DataFrame:
    """(key, id, failures, changed_at): for each row in order of time and id, how many rows in a row have failed, this one
    included, and when the key last went from failing to not or back.  Ids are whole numbers, each
    counted once; rows wait for the watermark, so the last ones come when later rows have moved it on.  Rows without a time or an
    id are left out.  Keys are spread over `shards` states; that of no key is one of its own.
    """
    rows = _timed(stream, ts, late).where(F.col(ts).isNotNull() & F.col(id_col).isNotNull())
    shard = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))).alias("shard")
    rows = rows.select(F.col(key).cast("long").alias("key"), F.unix_micros(ts).alias("us"), F.col(id_col).cast("long").alias("id"), F.coalesce(failed, F.lit(False)).alias("flag"), ts)
    rows = rows.select(shard, F.coalesce("key", F.lit(0)).alias("key"), "us", "id", "flag", ts)
    return rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=_Failures(), outputStructType="key long, id long, failures long, changed_at timestamp", outputMode="Append", timeMode="EventTime")


def saved_search_alerts(stream: DataFrame, searches: DataFrame, match: Column, ts: str, id_col: str, late: str, cadences: dict[str, int], shards: int = 8) -> DataFrame:
    """(search, id, sent_at): each item of a saved search once, sent at the first tick of the search's cadence at or behind it.

    searches: sid, cadence and last_checked_at; items up to that mark are not sent, and the mark then moves from
    tick to tick.  cadences: name to seconds; searches of another cadence are off.  A search's items are spread
    over `shards` states, so that one which matches much is no single task's.
    """
    on = searches.where(F.col("cadence").isin(*cadences))
    rows = _timed(stream, ts, late).join(F.broadcast(on.limit(10_000)), match).where(F.col("last_checked_at").isNull() | (F.col(ts) > F.col("last_checked_at")))
    rows = rows.select(F.col("sid").cast("long").alias("sid"), "cadence", F.pmod(F.xxhash64(id_col), F.lit(shards)).alias("shard"), F.col("sid").cast("long").alias("key"), F.unix_micros(ts).alias("us"), F.col(id_col).cast("long").alias("id"), F.lit(True).alias("flag"), ts)
    found = rows.groupBy("sid", "cadence", "shard").transformWithStateInPandas(statefulProcessor=_Alerts({k: v * 1000 for k, v in cadences.items()}), outputStructType="search long, id long, sent_at timestamp", outputMode="Append", timeMode="EventTime")
    return found
