"""Aggregation operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import latest_per_key, small


def percent(condition: Column, digits: int = 6) -> Column:
    """100 x share of rows; 0 for no rows."""
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    return F.round(F.coalesce(100.0 * F.count_if(condition) / n, F.lit(0.0)), digits)


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, n) of the most frequent values, ties by value; nulls are a value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(key).asc_nulls_last()).limit(n)


def bucket_start(ts: str, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def time_buckets(df: DataFrame, ts: str, measures: Mapping[str, Column], minutes: int, as_of: Column | None = None) -> DataFrame:
    """One row for each bucket that has rows: a minute wide for spans up to two hours, five minutes beyond."""
    seconds = 60 if minutes <= 120 else 300
    if as_of is not None:
        df = df.where((F.col(ts) <= as_of) & (F.col(ts) > as_of - F.make_dt_interval(mins=F.lit(minutes))))
    return df.groupBy(bucket_start(ts, seconds).alias("bucket")).agg(*(c.alias(k) for k, c in measures.items()))


def trailing(df: DataFrame, ts: str, as_of: Column, windows: Mapping[str, int], measure) -> DataFrame:
    """One row with measure(condition) for each trailing window in minutes."""
    return df.agg(*(measure((F.col(ts) <= as_of) & (F.col(ts) > as_of - F.make_dt_interval(mins=F.lit(m)))).alias(k) for k, m in windows.items()))


def facets(df: DataFrame, columns: Mapping[str, Column], score: str, limits: Mapping[str, int] | None = None) -> DataFrame:
    """(facet, key, n, avg_score) of several facets in one pass: rows are unpivoted, then grouped once."""
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("facet"), c.cast("string").alias("key")) for k, c in columns.items())))
    out = df.select(F.col(score).alias("_s"), entries.alias("e")).groupBy("e.facet", "e.key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_s"), 3).alias("avg_score"))
    if not limits:
        return out
    ranked = out.withColumn("_most", F.coalesce(*(F.when(F.col("facet") == k, v) for k, v in limits.items()), F.lit(1 << 30)))
    from pyspark.sql.window import Window

    w = Window.partitionBy("facet").orderBy(F.col("n").desc(), F.col("key").asc_nulls_last())
    return ranked.withColumn("_r", F.row_number().over(w)).where("_r <= _most").drop("_r", "_most")


def level_counts(df: DataFrame, levels: Mapping[str, Column]) -> DataFrame:
    """(level, key, n): counts at several levels by one unpivot and one grouping."""
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), c.cast("string").alias("key")) for k, c in levels.items())))
    return df.select(entries.alias("e")).groupBy("e.level", "e.key").agg(F.count(F.lit(1)).alias("n"))


def open_or_last_end(end: str) -> Column:
    """Null while any row is open, else the last end."""
    return F.when(F.bool_or(F.col(end).isNull()), None).otherwise(F.max(end))


def plurality(df: DataFrame, key: Sequence[str], vote: str) -> DataFrame:
    """The most frequent vote of each key, the smaller on a tie."""
    counts = df.groupBy(*key, vote).agg(F.count(F.lit(1)).alias("votes"))
    return latest_per_key(counts, key, [F.col("votes").desc(), F.col(vote).asc_nulls_last()])


def balance(ledger: DataFrame, user: str, amount: str, state: str, counted: Sequence[str]) -> DataFrame:
    return ledger.groupBy(user).agg(F.round(F.coalesce(F.sum(F.when(F.col(state).isin(*counted), F.col(amount))), F.lit(0.0)), 2).alias("balance"))


def rate_buckets(df: DataFrame, ts: str, key: str, tier: str, limits: DataFrame) -> DataFrame:
    """(key, hour, n, over): use by hour against each tier's limit (limits: tier, most)."""
    used = df.groupBy(key, tier, F.window(ts, "1 hour").start.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return used.join(small(limits), tier, "left").select(key, "hour", "n", F.coalesce(F.col("n") > F.col("most"), F.lit(False)).alias("over"))


def freshness(driving: DataFrame, following: DataFrame, key: str, driving_day: str, following_day: str, default_days: int, overrides: DataFrame | None = None) -> DataFrame:
    """Lag in days between two tables' last days by key; none on the following side is a breach, as is more than allowed."""
    a = driving.groupBy(key).agg(F.max(driving_day).alias("last_driving"))
    b = following.groupBy(key).agg(F.max(following_day).alias("last_following"))
    out = a.join(b, key, "left").withColumn("lag_days", F.datediff("last_driving", "last_following"))
    allowed = F.lit(default_days)
    if overrides is not None:
        out = out.join(small(overrides), key, "left")
        allowed = F.coalesce(F.col("days"), allowed)
    return out.withColumn("breach", F.col("lag_days").isNull() | (F.col("lag_days") > allowed)).select(key, "last_driving", "last_following", "lag_days", "breach")


def coverage(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Counts of several tables by key, side by side: each is grouped on its own, the short results are stacked and pivoted."""
    stacked = None
    for name, df in parts.items():
        one = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(p) for p in parts))


def histogram_percentile(df: DataFrame, keys: Sequence[str], bound: str, cumulative: str, p: float) -> DataFrame:
    """The smallest bucket bound whose cumulative count reaches p of the total."""
    from pyspark.sql.window import Window

    total = F.max(cumulative).over(Window.partitionBy(*keys))
    return df.withColumn("_t", total).where(F.col(cumulative) >= p * F.col("_t")).groupBy(*keys).agg(F.min(bound).alias("bound"))
