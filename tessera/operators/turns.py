"""Turn and interval operators: islands, runs, and order-dependent state machines by group."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column, name: str = "island") -> DataFrame:
    """df with a number that grows at each row where `opens` holds; rows before the first have 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(opens, 1).otherwise(0)).over(w))


def collapse_turns(df: DataFrame, keys: Sequence[str], order: str, opens: Column, text: str, start: str, end: str) -> DataFrame:
    """(keys, island, text, start, end, lines): each island's lines as one turn."""
    marked = islands(df, keys, [order], opens)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return marked.groupBy(*keys, "island").agg(F.array_join(parts, " ").alias("text"), F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("lines"))


def runs_to_intervals(df: DataFrame, keys: Sequence[str], order: Sequence[str], identity: str, at: str) -> DataFrame:
    """(keys, identity, start, end, n): maximal runs of one identity, null being one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = ~F.col(identity).eqNullSafe(F.lag(identity).over(w)) | F.lag(F.lit(1)).over(w).isNull()
    marked = islands(df.withColumn("_new", changed), keys, order, F.col("_new"))
    return marked.groupBy(*keys, "island", identity).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def alternate(df: DataFrame, keys: Sequence[str], order: str, speaker: str, most: int = 60) -> DataFrame:
    """Fill unknown speakers between two known ones of a block by alternation.

    A gap of unknown turns between anchors A and B is filled B, A, B, A ... from the turn after A on,
    when the two differ and the gap's parity fits: the turn before B is A's.
    Blocks are bounded by `most` turns; longer gaps stay unknown.  No state beyond a window of anchors.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(F.when(F.col(speaker).isNotNull(), F.struct(F.col("_n"), F.col(speaker).alias("s"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(F.col(speaker).isNotNull(), F.struct(F.col("_n"), F.col(speaker).alias("s"))), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = df.withColumn("_n", F.row_number().over(w)).withColumns({"_a": before, "_b": after})
    gap = F.col("_b._n") - F.col("_a._n") - 1
    fits = (F.col("_a.s") != F.col("_b.s")) & (gap % 2 == 0) & (gap <= most)
    filled = F.when(F.col(speaker).isNotNull(), F.col(speaker)).when(fits, F.when((F.col("_n") - F.col("_a._n")) % 2 == 1, F.col("_b.s")).otherwise(F.col("_a.s")))
    kind = F.when(F.col(speaker).isNotNull(), "anchor").when(fits, "alternation").otherwise("none")
    return rows.withColumns({"filled": filled, "attribution": kind}).drop("_n", "_a", "_b")


def suppress_repeats(df: DataFrame, keys: Sequence[str], order: str, text: str, memory: int = 4) -> DataFrame:
    """Rows whose text is not among the last `memory` rows kept before them.

    Which rows are kept depends on those kept before, so each group is read once in order, as a stream: sorted with
    spilling, with no more than `memory` texts and one Arrow batch in memory, whatever the group's size.
    """
    places, value = [df.columns.index(k) for k in keys], df.columns.index(text)

    def run(batches):
        group, recent = None, deque(maxlen=memory)
        for batch in batches:
            keep = []
            for *key, t in zip(*(batch.column(i).to_pylist() for i in (*places, value)), strict=True):
                if key != group:
                    group = key
                    recent.clear()
                keep.append(t not in recent)
                if keep[-1]:
                    recent.append(t)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, df.schema)


def attribute(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """struct<kind, name> of the first pattern, in order of trust, that finds a name; kind none otherwise."""
    found = None
    for kind, pattern in patterns:
        name = F.regexp_extract(text, pattern, 1)
        row = F.struct(F.lit(kind).alias("kind"), name.alias("name"))
        found = F.when(name != "", row) if found is None else found.when(name != "", row)
    return found.otherwise(F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("name")))


def fixed_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, name: str = "chunk") -> DataFrame:
    """df with the number of its group of `size` rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.floor((F.row_number().over(w) - 1) / size))
