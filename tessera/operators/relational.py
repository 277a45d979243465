"""Join, ranking, paging and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 10_000
#: Rows of a key that crowded_pairs hands on as one array, those of them that meet others at a time, blocks of arrays that a key has at most.
PAIR_BLOCK, PAIR_RUN, PAIR_BLOCKS = 4096, 256, 8


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast only if it is seen to have at most `rows` rows; otherwise Spark picks the join."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def top_m_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], m: int, rank: str | None = None) -> DataFrame:
    """The first m rows of each group; plans as a group limit before and after the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= m)
    return out if rank else out.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in the order given (state a unique tie-break)."""
    return top_m_per_group(df, keys, order, 1)


def latest_struct(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The row of the greatest order columns of each key by max_by: partial aggregates, no sort of whole groups."""
    picked = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(picked).select(*keys, "_v.*")


def counts_zero_filled(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "n") -> DataFrame:
    """left with the number of right rows of its key: aggregate first, then one outer join."""
    n = right.groupBy(F.col(right_key).alias("_k")).agg(F.count(F.lit(1)).alias(name))
    return left.join(n, left[left_key] == n["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def or_equi_join(left: DataFrame, right: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """left JOIN right ON c1 OR c2 ...: one hash join for each condition instead of a nested loop.

    A join leaves out the pairs that a condition before it has found, so each comes once and the result is never gathered to tell.
    """
    out, before = None, F.lit(False)
    for c in conditions:
        part = left.join(right, c & ~before)
        out, before = part if out is None else out.unionByName(part), before | F.coalesce(c, F.lit(False))
    return out


def keys_in_both(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """The distinct keys that rows of both sides have: what a join of the sides is asked for when its pairs are not."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), list(on))


def interval_join(facts: DataFrame, spans: DataFrame, on: Sequence[str], at: str, start: str, end: str, closed: str = "left", how: str = "left", open_start: bool = False) -> DataFrame:
    """Join each fact to the spans of its keys that hold its time.

    closed: "left" for start <= t < end, "both" for start <= t <= end.  A null end is open; with
    open_start a null start is too.  The equality keys make it a hash join with a range residual.
    """
    if closed not in ("left", "both"):
        raise ValueError("closed must be left or both")
    t = facts[at]
    begun = spans[start] <= t
    if open_start:
        begun = spans[start].isNull() | begun
    ended = (t < spans[end]) if closed == "left" else (t <= spans[end])
    keys = [facts[k].eqNullSafe(spans[k]) if open_start else facts[k] == spans[k] for k in on]
    condition = begun & (spans[end].isNull() | ended)
    for k in keys:
        condition = k & condition
    joined = facts.join(spans, condition, how)
    for k in on:
        joined = joined.drop(spans[k])
    return joined


def range_bucket_join(facts: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Interval join without an equality key: spans are laid out over time buckets of `width` seconds.

    start <= t < end.  Each span gives a row for every bucket it touches, each fact one; so no nested loop.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / width)
    laid = spans.withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return facts.withColumn("_b", bucket(F.col(at))).join(laid, "_b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time: one union, one window."""
    none = [F.lit(None).cast(right.schema[v].dataType).alias(f"asof_{v}") for v in values]
    a = left.select(*left.columns, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), *none)
    b = right.select(*(F.col(k) if k in keys else F.lit(None).cast(left.schema[k].dataType).alias(k) for k in left.columns), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *(F.col(v).alias(f"asof_{v}") for v in values))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(*(F.col(f"asof_{v}") for v in values))), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("_last", last).where("_side = 1")
    return out.select(*left.columns, *(F.col(f"_last.asof_{v}").alias(f"asof_{v}") for v in values))


def missing_pairs(left: DataFrame, right: DataFrame, existing: DataFrame, on: Sequence[str]) -> DataFrame:
    """The matrix left x right without the pairs that exist; right must be a short list."""
    return left.crossJoin(small(right)).join(existing.select(*on).distinct(), list(on), "left_anti")


def duplicate_pairs(df: DataFrame, key: str, id_col: str, extra: Column | None = None) -> DataFrame:
    """(a, b, key) with a < b for rows of one key; `extra` may refer to the sides as a and b.  For keys of few rows, see crowded_pairs."""
    a, b = df.alias("a"), df.alias("b")
    condition = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))
    if extra is not None:
        condition = condition & extra
    return a.join(b, condition).select(F.col(f"a.{id_col}").alias("a"), F.col(f"b.{id_col}").alias("b"), F.col(f"a.{key}").alias(key))


def crowded_pairs(df: DataFrame, key: str, id_col: str, extra: Column | None = None) -> DataFrame:
    """What duplicate_pairs gives, for keys that many rows share.

    The result grows with the square of a key's rows, what is shuffled only with the rows: by id they are cut into arrays of at most
    PAIR_BLOCK rows, which travel; a key's arrays are dealt into at most PAIR_BLOCKS blocks, and each block meets itself and each later one.
    Two blocks are a unit of work; units are dealt out by number, as AQE would put them together by their bytes.  Within a unit two arrays
    meet at a time, of the later one PAIR_RUN rows, so a task holds few arrays and one row's run of pairs.  Pairs leave in an order that
    columnar files keep small: each a of an array beside the same run of b.  All columns travel: select those that `extra` needs.
    """
    one, values = Window.partitionBy(key), [c for c in df.columns if c != key]
    rows = df.where(F.col(key).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.withColumns({"_at": F.row_number().over(one.orderBy(id_col)) - 1, "_all": F.count(F.lit(1)).over(one)}).withColumn("_parts", F.ceil(F.col("_all") / PAIR_BLOCK))
    rows = rows.withColumns({"_part": F.floor(F.col("_at") * F.col("_parts") / F.col("_all")), "_blocks": F.least("_parts", F.lit(PAIR_BLOCKS))})
    parts = rows.groupBy(key, "_parts", "_blocks", "_part").agg(F.collect_list(F.struct(*values)).alias("_rows")).withColumn("_block", F.floor(F.col("_part") * F.col("_blocks") / F.col("_parts")))
    n, unit = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), [key, "_first", "_second"]
    a = parts.select(key, F.col("_block").alias("_first"), F.explode(F.sequence("_block", F.col("_blocks") - 1)).alias("_second"), F.col("_part").alias("_a_part"), F.col("_rows").alias("_a"))
    b = parts.select(key, F.explode(F.sequence(F.lit(0).cast("long"), "_block")).alias("_first"), F.col("_block").alias("_second"), F.col("_part").alias("_b_part"), F.col("_rows").alias("_b"))
    met = a.repartition(n, *unit).join(b.repartition(n, *unit).hint("merge"), unit).where("_a_part <= _b_part")
    runs = met.select(key, "_a", "_b", F.explode(F.sequence(F.lit(1), F.size("_b"), F.lit(PAIR_RUN))).alias("_from")).select(key, "_a", F.slice("_b", F.col("_from"), PAIR_RUN).alias("_run"))
    runs = runs.withColumn("_last", F.array_max(F.col("_run")[id_col]))
    # the lambda also keeps this step out of generated code, which would hold all pairs of an array before it hands on the first
    some = runs.select(key, "_run", F.explode(F.filter("_a", lambda x: x[id_col] < F.col("_last"))).alias("_one"))
    sides = some.select(key, "_one", F.explode("_run").alias("_two"))
    pairs = sides.select(*[F.struct(*[F.col(key) if c == key else F.col(s)[c].alias(c) for c in df.columns]).alias(side) for s, side in (("_one", "a"), ("_two", "b"))])
    condition = F.col(f"a.{id_col}") < F.col(f"b.{id_col}")
    if extra is not None:
        condition = condition & extra
    return pairs.where(condition).select(F.col(f"a.{id_col}").alias("a"), F.col(f"b.{id_col}").alias("b"), F.col(f"a.{key}").alias(key))


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page of the ordered rows; plans as a top-k with offset."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int = 20) -> DataFrame:
    """(total, pages): at least one page."""
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def capped_count(df: DataFrame, distance: str, most: float, cap: int = 10_000) -> DataFrame:
    """(total, capped): rows within the distance, reported up to the cap."""
    n = df.where(F.col(distance) <= most).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(cap)).alias("total"), (F.col("n") > cap).alias("capped"))


def unique_candidate(df: DataFrame, key: Sequence[str], candidate: str) -> DataFrame:
    """(key, candidate) of keys with exactly one distinct candidate: ambiguity resolves to nothing."""
    return df.groupBy(*key).agg(F.count_distinct(candidate).alias("_n"), F.min(candidate).alias(candidate)).where("_n = 1").drop("_n")


def window_count_gate(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("_n = 1").drop("_n")


def neighbours(df: DataFrame, keys: Sequence[str], order: str, before: int, after: int, value: str) -> DataFrame:
    """Each row with the values of the rows before and after it inside its group, as arrays in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    item = F.struct(F.col(order).alias("at"), F.col(value).alias("value"))
    one = lambda a, b: F.transform(F.array_sort(F.collect_list(item).over(w.rowsBetween(a, b))), lambda x: x["value"])
    return df.withColumn("before", one(-before, -1)).withColumn("after", one(1, after))


def ranked_union(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Union of sources in order of preference; of each key the first source's row stays."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("preference", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return latest_per_key(out, keys, [F.col("preference").asc(), *order])


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str], mode: str = "ignore", confidence: str | None = None) -> DataFrame:
    """target merged with new rows by null-safe keys.

    ignore: rows of known keys are dropped; highest: of a key the row of greater confidence stays, the
    old one on a tie; replace: the new row stays.  Repeated keys among the new rows count once.
    """
    rank = {"ignore": [F.col("_new").asc()], "replace": [F.col("_new").desc()], "highest": [F.col(confidence).desc_nulls_last() if confidence else F.lit(0), F.col("_new").asc()]}[mode]
    both = target.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    tie = [F.col(c).asc_nulls_last() for c in target.columns]
    return latest_per_key(both, keys, [*rank, *tie]).drop("_new")


def sync_columns(child: DataFrame, parent: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """child with denormalised columns taken from parent; `changed` tells rows whose values differed."""
    p = parent.select(on, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = child.join(p, on, "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return joined.withColumn("changed", changed).select(*(F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in child.columns), "changed")


def merge_duplicates(entities: DataFrame, key: str, id_col: str, order: Sequence[str]) -> DataFrame:
    """(id, canonical_id) of entities that share a key: the greatest by `order` is kept, children are re-pointed by this map."""
    best = entities.groupBy(key).agg(F.max_by(id_col, F.struct(*order)).alias("canonical_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return entities.join(best, key).select(F.col(id_col).alias("id"), "canonical_id")


def retention(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """(kept, removed) counts of an age-based clean-up."""
    return df.agg(F.count_if(F.col(ts) >= cutoff).alias("kept"), F.count_if(F.col(ts) < cutoff).alias("removed"))


def claim_next(jobs: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The job each queue would hand out next: what a guarded claim picks, without the lock."""
    return latest_per_key(jobs, keys, order)


def release_stale(jobs: DataFrame, status: str, claimed: str, now: Column, minutes: int, running: str = "running", queued: str = "queued") -> DataFrame:
    """jobs with those back in the queue, unclaimed, that have been running for longer than the time-out; others stay as they are."""
    stale = F.coalesce((F.col(status) == running) & (F.col(claimed) < now - F.make_dt_interval(mins=F.lit(minutes))), F.lit(False))
    return jobs.withColumns({status: F.when(stale, F.lit(queued)).otherwise(F.col(status)), claimed: F.when(~stale, F.col(claimed))})


def match_by_rules(left: DataFrame, right: DataFrame, day: str, left_id: str, right_id: str, rules: Sequence[tuple[Column, Column]], within: tuple[str, str] | None = None) -> DataFrame:
    """(right_id, left_id, rule): each right row's one partner of its day by the first rule, in order, that finds any.

    A rule is a pair of keys, of left and right, that must be equal and not empty: an equi-join each.  Last, with
    `within`, the names of two key columns, one holding the other; distinct names of a day are compared there, not rows,
    and only those of rows that no rule has matched.  Of several partners the least id counts.
    """
    out, rest = None, right
    for i, (a, b) in enumerate(rules, 1):
        keyed = left.select(F.col(day).alias("_day"), a.alias("_key"), left_id).where("_key <> ''").groupBy("_day", "_key").agg(F.min(left_id).alias(left_id))
        met = rest.select(F.col(day).alias("_day"), b.alias("_key"), right_id).join(keyed, ["_day", "_key"]).select(right_id, left_id, F.lit(i).alias("rule"))
        out = met if out is None else out.unionByName(met)
        rest = rest.join(met.select(right_id), right_id, "left_anti")
    if within is None:
        return out
    a, b = within
    names = left.where(F.col(a) != "").groupBy(F.col(day).alias("_day"), F.col(a).alias("_a")).agg(F.min(left_id).alias(left_id))
    asked = rest.where(F.col(b) != "").select(F.col(day).alias("_day"), F.col(b).alias("_b"))
    holds = names.join(asked.distinct(), "_day").where(F.contains("_a", "_b") | F.contains("_b", "_a")).groupBy("_day", "_b").agg(F.min(left_id).alias(left_id))
    met = rest.join(holds, (rest[day] == holds["_day"]) & (rest[b] == holds["_b"])).select(right_id, left_id, F.lit(len(rules) + 1).alias("rule"))
    return out.unionByName(met)


def match_same_or_begun(left: DataFrame, right: DataFrame, day: str, left_id: str, body: str, right_id: str, same: Column, begin: Column) -> DataFrame:
    """(left_id, right_id, rank): each left row's partner of its day, by rank: 1, the body is the same; 2, it begins with `begin`.

    Of several the least id counts.  Distinct bodies of a day look up themselves and their beginnings, no longer than the
    longest to be found, by equi-join; rows of a day never meet one by one.
    """
    keys = F.explode(F.array(F.struct(F.lit(1).alias("rank"), same.alias("_key")), F.struct(F.lit(2).alias("rank"), begin.alias("_key")))).alias("x")
    pool = right.select(F.col(day).alias("_day"), F.col(right_id).alias("_id"), keys).groupBy("_day", "x.rank", "x._key").agg(F.min("_id").alias(right_id))
    longest = right.groupBy(F.col(day).alias("_day")).agg(F.max(F.length(begin)).alias("_most"))
    bodies = left.select(F.col(day).alias("_day"), F.col(body).alias("_body")).distinct().join(longest, "_day").where("_body IS NOT NULL")
    begun = F.transform(F.sequence(F.lit(0), F.least(F.length("_body"), F.coalesce("_most", F.lit(0)))), lambda n: F.struct(F.lit(2).alias("rank"), F.left("_body", n).alias("_key")))
    asked = F.concat(F.array(F.struct(F.lit(1).alias("rank"), F.col("_body").alias("_key"))), begun)
    met = bodies.select("_day", "_body", F.explode(asked).alias("x")).select("_day", "_body", "x.*").join(pool, ["_day", "rank", "_key"])
    best = met.groupBy("_day", "_body").agg(F.min(F.struct("rank", right_id)).alias("x"))
    return left.join(best, (left[day] == best["_day"]) & (left[body] == best["_body"])).select(left_id, f"x.{right_id}", "x.rank")


def near_pairs(df: DataFrame, keys: Sequence[str], id_col: str, value: str, within: float) -> DataFrame:
    """(a, b) with a < b for rows of equal keys whose values differ by less than `within`.

    Rows meet those of their own and the two neighbouring bands of that width only.  Null and NaN values pair with nothing.
    """
    rows = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(id_col).alias("_id"), F.col(value).alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan(F.col("_x").cast("double")))
    band = F.floor(F.col("_x") / F.lit(within * 1.001)).cast("double")  # a little wider, for rounding
    on = [*(f"_k{i}" for i in range(len(keys))), "_band"]
    a = rows.withColumn("_band", F.explode(F.array_distinct(F.array(band - 1, band, band + 1)))).withColumnsRenamed({"_id": "a", "_x": "_a"})
    b = rows.withColumn("_band", band).withColumnsRenamed({"_id": "b", "_x": "_b"})
    return a.join(b, on).where((F.col("a") < F.col("b")) & (F.abs(F.col("_a") - F.col("_b")) < within)).select("a", "b")


def one_per_handle(handles: DataFrame, keys: Sequence[str], handle: str, order: Sequence[Column]) -> DataFrame:
    """One row of each handle, whatever its letters' case: the first in order."""
    rows = handles.withColumn("_handle", F.lower(F.trim(handle)))
    return latest_per_key(rows, [*keys, "_handle"], order).drop("_handle")


def promote(runs: DataFrame, run_id: str, chosen: object, flag: str = "is_current") -> DataFrame:
    """runs with the pointer on one run and all others superseded."""
    return runs.withColumn(flag, F.col(run_id) == F.lit(chosen))
