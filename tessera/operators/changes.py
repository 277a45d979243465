"""Change detection between snapshots, histories with validity intervals, soft ends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _same(a: Column, b: Column) -> Column:
    """Equal as trimmed text, null and empty being the same."""
    text = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))
    return text(a) == text(b)


def previous_row_changes(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Mapping[str, str | Column], id_col: str) -> DataFrame:
    """One row for each column that differs from the previous row of its key.

    columns: name -> severity, a literal or a column over `old` and `new` text.  Rows without a
    predecessor give none.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    names = list(columns)
    prev = F.lag(F.struct(id_col, *names)).over(w)
    changes = F.array(*(F.struct(F.lit(c).alias("change_type"), F.col(f"_prev.{c}").cast("string").alias("old_value"), F.col(c).cast("string").alias("new_value"), _same(F.col(f"_prev.{c}"), F.col(c)).alias("same")) for c in names))
    rows = df.withColumn("_prev", prev).where("_prev IS NOT NULL").select(*key, F.col(f"_prev.{id_col}").alias("from_id"), F.col(id_col).alias("to_id"), F.explode(F.filter(changes, lambda x: ~x["same"])).alias("c"))
    out = rows.select(*key, "from_id", "to_id", "c.change_type", "c.old_value", "c.new_value")
    severity = F.coalesce(*(F.when(F.col("change_type") == c, F.lit(s) if isinstance(s, str) else s) for c, s in columns.items()))
    return out.withColumn("severity", severity)


def tier_severity(old: str = "old_value", new: str = "new_value") -> Column:
    """major for a gap of two or more, else notable; null unless both are numbers."""
    gap = F.abs(F.try_subtract(F.expr(f"try_cast({old} AS int)"), F.expr(f"try_cast({new} AS int)")))
    return F.when(gap >= 2, "major").when(gap.isNotNull(), "notable")


def set_changes(df: DataFrame, key: Sequence[str], order: Sequence[str], column: str, id_col: str) -> DataFrame:
    """(key, to_id, added, removed) where an array differs, as a set, from the previous row's."""
    w = Window.partitionBy(*key).orderBy(*order)
    old = F.coalesce(F.lag(column).over(w), F.array().cast(df.schema[column].dataType))
    rows = df.withColumn("_old", old).withColumn("_first", F.lag(F.lit(1)).over(w).isNull()).where("NOT _first")
    show = lambda a, b: F.array_sort(F.array_except(F.coalesce(a, F.array().cast(df.schema[column].dataType)), b))
    out = rows.select(*key, F.col(id_col).alias("to_id"), show(F.col(column), F.col("_old")).alias("added"), show(F.col("_old"), F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType))).alias("removed"))
    return out.where((F.size("added") > 0) | (F.size("removed") > 0))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change_type, old_value, new_value): added, removed, or the column that changed; null and '' are equal."""
    a = old.select(F.col(key).alias("_a"), *(F.col(c).alias(f"_o_{c}") for c in columns))
    b = new.select(F.col(key).alias("_b"), *(F.col(c).alias(f"_n_{c}") for c in columns))
    none = F.lit(None).cast("string")
    row = lambda kind, o, n, on: F.when(on, F.struct(F.lit(kind).alias("change_type"), o.cast("string").alias("old_value"), n.cast("string").alias("new_value")))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    found = F.array(row("added", none, none, F.col("_a").isNull()), row("removed", none, none, F.col("_b").isNull()), *(row(c, F.col(f"_o_{c}"), F.col(f"_n_{c}"), both & ~_same(F.col(f"_o_{c}"), F.col(f"_n_{c}"))) for c in columns))
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), F.explode(F.array_compact(found)).alias("c")).select(key, "c.*")


def soft_end(open_rows: DataFrame, seen: DataFrame, keys: Sequence[str], end: str, as_of: Column) -> DataFrame:
    """open_rows with `end` set where the key was not seen; rows that ended before stay as they are."""
    hit = seen.select(*keys).distinct().withColumn("_seen", F.lit(True))
    out = open_rows.join(hit, list(keys), "left")
    return out.withColumn(end, F.when(F.col(end).isNull() & F.col("_seen").isNull(), as_of).otherwise(F.col(end))).select(*open_rows.columns)


def missing_members(active: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return active.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def rotate_terms(terms: DataFrame, changes: DataFrame, current: DataFrame, key: str, start: str, end: str, as_of: Column, boundary: Sequence[str]) -> DataFrame:
    """History after a roster change: open terms of keys with a boundary change are closed and follow-ups opened.

    Only keys that had an open term rotate; other changes leave the history alone.
    """
    turned = changes.where(F.col("change_type").isin(*boundary)).select(key).distinct().withColumn("_turn", F.lit(True))
    marked = terms.join(turned, key, "left").withColumn("_close", F.col("_turn").isNotNull() & F.col(end).isNull())
    closed = marked.withColumn(end, F.when(F.col("_close"), as_of).otherwise(F.col(end))).select(*terms.columns)
    opened = current.join(marked.where("_close").select(key).distinct(), key, "left_semi").withColumns({start: as_of, end: F.lit(None).cast(terms.schema[end].dataType)})
    return closed.unionByName(opened.select(*terms.columns))


def open_missing_terms(terms: DataFrame, active: DataFrame, key: str, start: str, end: str, as_of: Column) -> DataFrame:
    """New open terms for active keys that have none."""
    has = terms.where(F.col(end).isNull()).select(key)
    return active.join(has, key, "left_anti").withColumns({start: as_of, end: F.lit(None).cast(terms.schema[end].dataType)}).select(*terms.columns)


def failure_counter(df: DataFrame, key: Sequence[str], order: Sequence[str], failed: Column) -> DataFrame:
    """df with `failures`: how many rows in a row, this one included, have failed since the last success."""
    w = Window.partitionBy(*key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    wide = df.withColumn("_f", failed).withColumn("_i", island)
    run = Window.partitionBy(*key, "_i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return wide.withColumn("failures", F.sum(F.col("_f").cast("long")).over(run)).drop("_f", "_i")


def reparse_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], sequence: str, digest: str, tier: str) -> DataFrame:
    """(keys, sequence, change): kept, retiered, changed, inserted or deleted, by position and content hash."""
    a = old.select(*keys, sequence, F.col(digest).alias("_oh"), F.col(tier).alias("_ot"), F.lit(True).alias("_o"))
    b = new.select(*keys, sequence, F.col(digest).alias("_nh"), F.col(tier).alias("_nt"), F.lit(True).alias("_n"))
    j = a.join(b, [*keys, sequence], "full")
    change = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "deleted").when(~F.col("_oh").eqNullSafe(F.col("_nh")), "changed").when(~F.col("_ot").eqNullSafe(F.col("_nt")), "retiered").otherwise("kept")
    return j.select(*keys, sequence, change.alias("change"))


def high_water(df: DataFrame, ts: str, overlap_days: int, explicit: str | None = None, since_days: int | None = None, as_of: Column | None = None) -> DataFrame:
    """(since): an explicit start, else days back, else the last time less the overlap; null reads everything."""
    if explicit:
        since = F.lit(explicit).cast("timestamp")
    elif since_days is not None:
        since = as_of - F.make_dt_interval(days=F.lit(since_days))
    else:
        since = F.max(ts) - F.make_dt_interval(days=F.lit(overlap_days))
    return df.agg(since.alias("since")) if since_days is None and not explicit else df.sparkSession.range(1).select(since.alias("since"))


def incremental(df: DataFrame, ts: str, since: DataFrame) -> DataFrame:
    """Rows at or after the one-row mark; all of them if it is null."""
    return df.crossJoin(F.broadcast(since)).where(F.col("since").isNull() | (F.col(ts) >= F.col("since"))).drop("since")
