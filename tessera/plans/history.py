"""Change detection, histories, resolution, and turn queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import captions as cp
from tessera.operators import changes as ch
from tessera.operators import relational as rel
from tessera.operators import resolve as rs
from tessera.operators import turns as tn
from tessera.registry import ORACLES, query
from tessera.sources.tables import Tables

CUT = "1998-06-01"


def _snap(t, before: bool):
    """The latest order of each customer before the cut, or of all time: two snapshots of a roster."""
    o = t.orders.where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp")) if before else t.orders
    return rel.latest_struct(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderpriority", "o_orderstatus"]).withColumnRenamed("o_custkey", "k")


_SNAPS = f"""
WITH old AS (SELECT o_custkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
new AS (SELECT o_custkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_custkey % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


@query("scan_diff_changes", """
WITH w AS (SELECT user_id, event_id, event_type, floor(value / 50)::INTEGER AS tier, lag(event_id) OVER x AS pid, lag(event_type) OVER x AS pt, lag(floor(value / 50)::INTEGER) OVER x AS pv FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, pid AS from_id, event_id AS to_id, 'event_type' AS change_type, pt AS old_value, event_type AS new_value, 'major' AS severity FROM w WHERE pid IS NOT NULL AND pt <> event_type
UNION ALL SELECT user_id, pid, event_id, 'tier', pv::VARCHAR, tier::VARCHAR, CASE WHEN abs(tier - pv) >= 2 THEN 'major' ELSE 'notable' END FROM w WHERE pid IS NOT NULL AND pv <> tier""")
def scan_diff_changes(spark, d):
    e = Tables(spark, d).events.withColumn("tier", F.floor(F.col("value") / 50).cast("int"))
    return ch.previous_row_changes(e, ["user_id"], ["ts", "event_id"], {"event_type": "major", "tier": ch.tier_severity()}, "event_id")


@query("set_diff_changes", """
WITH s AS (SELECT o_custkey, o_orderdate, list(DISTINCT o_orderpriority) AS p, max(o_orderkey) AS k FROM orders GROUP BY o_custkey, o_orderdate),
w AS (SELECT *, lag(p) OVER x AS q, lag(1) OVER x AS had FROM s WINDOW x AS (PARTITION BY o_custkey ORDER BY o_orderdate))
SELECT o_custkey, k AS to_id, array_to_string(list_sort(list_filter(p, lambda v: NOT list_contains(q, v))), ',') AS added, array_to_string(list_sort(list_filter(q, lambda v: NOT list_contains(p, v))), ',') AS removed
FROM w WHERE had IS NOT NULL AND list_sort(p) <> list_sort(q)""")
def set_diff_changes(spark, d):
    s = Tables(spark, d).orders.groupBy("o_custkey", "o_orderdate").agg(F.collect_set("o_orderpriority").alias("p"), F.max("o_orderkey").alias("k"))
    out = ch.set_changes(s, ["o_custkey"], ["o_orderdate"], "p", "k")
    return out.select("o_custkey", "to_id", *(F.array_join(c, ",").alias(c) for c in ("added", "removed")))


@query("snapshot_diff", _SNAPS + """
SELECT coalesce(old.k, new.k) AS k, u.c AS change_type, u.o AS old_value, u.n AS new_value FROM old FULL JOIN new ON old.k = new.k,
LATERAL (SELECT * FROM (VALUES ('added', NULL, NULL, old.k IS NULL), ('removed', NULL, NULL, new.k IS NULL), ('party', old.p, new.p, old.k IS NOT NULL AND new.k IS NOT NULL AND old.p <> new.p), ('office', old.s, new.s, old.k IS NOT NULL AND new.k IS NOT NULL AND old.s <> new.s)) v(c, o, n, yes) WHERE yes) u""")
def snapshot_diff(spark, d):
    t = Tables(spark, d)
    names = {"o_orderpriority": "party", "o_orderstatus": "office"}
    return ch.snapshot_diff(_snap(t, True).withColumnsRenamed(names), _snap(t, False).where("k % 11 <> 0").withColumnsRenamed(names), "k", ["party", "office"])


@query("retired_members", _SNAPS + " SELECT k FROM old WHERE k NOT IN (SELECT k FROM new)")
def retired_members(spark, d):
    t = Tables(spark, d)
    return ch.missing_members(_snap(t, True), _snap(t, False).where("k % 11 <> 0"), ["k"]).select("k")


@query("soft_end", _SNAPS + f" SELECT k, p, CASE WHEN k IN (SELECT k FROM new) THEN NULL ELSE '{CUT}' END AS ended FROM old")
def soft_end(spark, d):
    t = Tables(spark, d)
    rows = _snap(t, True).select("k", F.col("o_orderpriority").alias("p"), F.lit(None).cast("string").alias("ended"))
    return ch.soft_end(rows, _snap(t, False).where("k % 11 <> 0"), ["k"], "ended", F.lit(CUT))


@query("scd2_rotate", _SNAPS + f""", turned AS (SELECT k FROM old JOIN new USING (k) WHERE old.p <> new.p AND k % 2 = 0)
SELECT k, p, '1990-01-01' AS started, CASE WHEN k IN (SELECT k FROM turned) THEN '{CUT}' WHEN k % 2 = 1 THEN '1995-01-01' END AS ended FROM old
UNION ALL SELECT k, p, '{CUT}', NULL FROM new WHERE k IN (SELECT k FROM turned)""")
def scd2_rotate(spark, d):
    t = Tables(spark, d)
    names = {"o_orderpriority": "p", "o_orderstatus": "s"}
    old, new = _snap(t, True).withColumnsRenamed(names), _snap(t, False).where("k % 11 <> 0").withColumnsRenamed(names)
    terms = old.select("k", "p", F.lit("1990-01-01").alias("started"), F.when(F.col("k") % 2 == 1, F.lit("1995-01-01")).alias("ended"))
    return ch.rotate_terms(terms, ch.snapshot_diff(old, new, "k", ["p", "s"]), new.select("k", "p"), "k", "started", "ended", F.lit(CUT), ["p"])


@query("open_missing_terms", f"SELECT c_custkey AS k, '{CUT}' AS started, NULL::VARCHAR AS ended FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def open_missing_terms(spark, d):
    t = Tables(spark, d)
    terms = t.orders.select(F.col("o_custkey").alias("k"), F.lit("1990-01-01").alias("started"), F.when(F.col("o_orderstatus") != "O", F.lit("1995-01-01")).alias("ended"))
    return ch.open_missing_terms(terms, t.customer.select(F.col("c_custkey").alias("k")), "k", "started", "ended", F.lit(CUT))


@query("failure_counter", """
WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS failures FROM i""")
def failure_counter(spark, d):
    return ch.failure_counter(Tables(spark, d).events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "failures")


@query("reparse_diff", """
WITH a AS (SELECT conv_id, turn, role, md5(text) AS h FROM conversations WHERE turn % 5 <> 4), b AS (SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'x' ELSE role END AS role, md5(CASE WHEN conv_id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM conversations WHERE turn % 7 <> 2)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, CASE WHEN a.h IS NULL THEN 'inserted' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'changed' WHEN a.role <> b.role THEN 'retiered' ELSE 'kept' END AS change
FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def reparse_diff(spark, d):
    c = Tables(spark, d).conversations
    old = c.where("turn % 5 <> 4").withColumn("h", F.md5("text"))
    new = c.where("turn % 7 <> 2").withColumn("h", F.md5(F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))).withColumn("role", F.when(F.col("turn") == 1, "x").otherwise(F.col("role")))
    return ch.reparse_diff(old, new, ["conv_id"], "turn", "h", "role")


@query("high_water_incremental", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-20') - INTERVAL 14 DAY")
def high_water_incremental(spark, d):
    e = Tables(spark, d).events
    mark = ch.high_water(e.where((F.col("event_id") % 2 == 0) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp"))), "ts", 14)
    return ch.incremental(e, "ts", mark).select("event_id")


# -- resolution --------------------------------------------------------------------------------


@query("resolve_staged", """
WITH f AS (SELECT o_orderkey, o_custkey % 40 AS slug, o_custkey % 7 AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 10 = 0),
s1 AS (SELECT c_custkey % 40 AS slug, min(c_custkey) AS c FROM customer WHERE c_custkey < 60 GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1),
s2 AS (SELECT c_custkey % 7 AS a, '1-URGENT' AS b, min(c_custkey) AS c FROM customer WHERE c_custkey < 5 GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1)
SELECT o_orderkey, coalesce(s1.c, s2.c) AS candidate, CASE WHEN s1.c IS NOT NULL THEN 0.85 WHEN s2.c IS NOT NULL THEN 0.8 END::DOUBLE AS confidence FROM f LEFT JOIN s1 USING (slug) LEFT JOIN s2 USING (a, b)""")
def resolve_staged(spark, d):
    t = Tables(spark, d)
    f = t.orders.where("o_orderkey % 10 = 0").select("o_orderkey", (F.col("o_custkey") % 40).alias("slug"), (F.col("o_custkey") % 7).alias("a"), F.col("o_orderpriority").alias("b"))
    c = t.customer.select(F.col("c_custkey").alias("candidate"))
    one = c.where("candidate < 60").withColumn("slug", F.col("candidate") % 40)
    two = c.where("candidate < 5").withColumns({"a": F.col("candidate") % 7, "b": F.lit("1-URGENT")})
    return rs.staged(f, [(one, ["slug"], 0.85), (two, ["a", "b"], 0.8)], "candidate").select("o_orderkey", "candidate", "confidence")


@query("resolve_dated", """
WITH terms AS (SELECT c_nationkey AS k, c_custkey AS person, make_timestamp(1995 + (c_custkey % 5), 1, 1, 0, 0, 0) AS a, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE make_timestamp(1996 + (c_custkey % 5), 1, 1, 0, 0, 0) END AS b FROM customer WHERE c_acctbal > 8500),
f AS (SELECT o_orderkey, c_nationkey AS k, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, min(person) AS person, 0.9::DOUBLE AS confidence FROM f JOIN terms USING (k) WHERE a <= o_orderdate AND (b IS NULL OR o_orderdate < b) GROUP BY 1 HAVING count(DISTINCT person) = 1""")
def resolve_dated(spark, d):
    t = Tables(spark, d)
    year = lambda base: F.make_timestamp((base + F.col("c_custkey") % 5).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    terms = t.customer.where("c_acctbal > 8500").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("person"), year(1995).alias("a"), F.when(F.col("c_custkey") % 3 != 0, year(1996)).alias("b"))
    f = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("k"), "o_orderdate")
    return rs.dated(f, terms, ["k"], "o_orderdate", "a", "b", "person", "o_orderkey", 0.9)


@query("resolve_propagated", """
WITH r AS (SELECT o_custkey AS doc, o_orderpriority AS k, o_orderkey % 4 AS person FROM orders WHERE o_orderstatus = 'F'), one AS (SELECT doc, k, min(person) AS person FROM r GROUP BY ALL HAVING count(DISTINCT person) = 1)
SELECT o_orderkey, person, 0.75::DOUBLE AS confidence FROM orders JOIN one ON o_custkey = doc AND o_orderpriority = k WHERE o_orderstatus <> 'F'""")
def resolve_propagated(spark, d):
    o = Tables(spark, d).orders.withColumns({"person": F.col("o_orderkey") % 4})
    done, rest = o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'").drop("person")
    return rs.propagate(done, rest, ["o_custkey", "o_orderpriority"], "person", 0.75).select("o_orderkey", "person", "confidence")


@query("fuzzy_unique_match", """
WITH n AS (SELECT DISTINCT left(p_name, 1) || substr(p_name, 3) AS name FROM part UNION SELECT DISTINCT 'z' || substr(p_name, 2) FROM part), r AS (SELECT p_name AS ref, min(p_partkey) AS id FROM part GROUP BY 1),
m AS (SELECT name, id, levenshtein(name, ref) AS distance FROM n, r WHERE levenshtein(name, ref) <= 2),
b AS (SELECT name, distance, count(DISTINCT id) AS c, min(id) AS id FROM m GROUP BY ALL)
SELECT name, id, distance::INTEGER AS distance FROM b WHERE c = 1 AND distance = (SELECT min(distance) FROM b x WHERE x.name = b.name)""")
def fuzzy_unique_match(spark, d):
    """Names with a letter missing, and names with another first letter."""
    p = Tables(spark, d).part
    names = p.select(F.explode(F.array(F.concat(F.left("p_name", F.lit(1)), F.substring("p_name", 3, 1000)), F.concat(F.lit("z"), F.substring("p_name", 2, 1000)))).alias("name"))
    roster = p.groupBy(F.col("p_name").alias("ref")).agg(F.min("p_partkey").alias("id"))
    return rs.fuzzy_unique(names, roster, "name", "ref", "id")


@query("match_score", """
SELECT c_custkey, round(greatest(0, least(1, CASE WHEN NOT (ctx OR rid OR prov OR par) THEN least(raw, 0.55) ELSE raw END)), 6) AS score FROM (
SELECT *, o * 0.6 + ctx::INT * 0.2 + rid::INT * 0.15 + prov::INT * 0.1 + par::INT * 0.05 - con::INT * 0.3 - jok::INT * 0.4 AS raw FROM (
SELECT c_custkey, (c_custkey % 4) / 3.0::DOUBLE AS o, c_custkey % 3 = 0 AS ctx, c_custkey % 5 = 0 AS rid, c_nationkey % 2 = 0 AS prov, c_mktsegment = 'BUILDING' AS par, c_custkey % 13 = 0 AS con, c_custkey % 17 = 0 AS jok FROM customer))""")
def match_score(spark, d):
    c = Tables(spark, d).customer
    k = F.col("c_custkey")
    s = rs.match_score((k % 4) / 3.0, k % 3 == 0, k % 5 == 0, F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment") == "BUILDING", k % 13 == 0, k % 17 == 0)
    return c.select("c_custkey", F.round(s, 6).alias("score"))


@query("pair_filter", """
SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey AND least(l_partkey, l_suppkey) IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) AND greatest(l_partkey, l_suppkey) IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)""")
def pair_filter(spark, d):
    t = Tables(spark, d)
    return rs.pair_filter(t.lineitem, "l_partkey", "l_suppkey", t.supplier.where("s_nationkey < 12"), "s_suppkey")


@query("confidence_raised", "SELECT c_custkey, greatest(round(c_acctbal / 10000, 2), 0.5) AS confidence FROM customer")
def confidence_raised(spark, d):
    return Tables(spark, d).customer.select("c_custkey", rs.raised(F.round(F.col("c_acctbal") / 10000, 2), F.lit(0.5)).alias("confidence"))


# -- turns -------------------------------------------------------------------------------------


@query("turn_collapse", """
WITH i AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)
SELECT conv_id, island::BIGINT AS island, md5(string_agg(text, ' ' ORDER BY turn)) AS digest, min(turn) AS start, max(turn) AS "end", count(*) AS lines FROM i GROUP BY conv_id, island""")
def turn_collapse(spark, d):
    out = tn.collapse_turns(Tables(spark, d).conversations, ["conv_id"], "turn", F.col("role") == "user", "text", "turn", "turn")
    return out.select("conv_id", "island", F.md5("text").alias("digest"), "start", "end", "lines")


@query("runs_to_intervals", """
WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM c)
SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM i GROUP BY user_id, g, event_type""")
def runs_to_intervals(spark, d):
    out = tn.runs_to_intervals(Tables(spark, d).events, ["user_id"], ["ts", "event_id"], "event_type", "ts")
    return out.select("user_id", "event_type", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")), "n")


@query("alternation_fill", """
WITH k AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 's' || (turn % 2) END AS speaker, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
g AS (SELECT *, max(CASE WHEN speaker IS NOT NULL THEN n END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS an, min(CASE WHEN speaker IS NOT NULL THEN n END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS bn FROM k),
j AS (SELECT g.*, a.speaker AS sa, b.speaker AS sb, coalesce(a.speaker <> b.speaker AND (bn - an - 1) % 2 = 0 AND bn - an - 1 <= 60, false) AS fits FROM g LEFT JOIN k a ON g.conv_id = a.conv_id AND g.an = a.n LEFT JOIN k b ON g.conv_id = b.conv_id AND g.bn = b.n)
SELECT conv_id, turn, CASE WHEN speaker IS NOT NULL THEN speaker WHEN fits THEN CASE WHEN (n - an) % 2 = 1 THEN sb ELSE sa END END AS filled, CASE WHEN speaker IS NOT NULL THEN 'anchor' WHEN fits THEN 'alternation' ELSE 'none' END AS attribution FROM j""")
def alternation_fill(spark, d):
    """Every third turn's speaker is known; the gaps between are filled where they alternate."""
    c = Tables(spark, d).conversations
    known = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("s"), (F.col("turn") % 2).cast("string")))
    return tn.alternate(c.select("conv_id", "turn", known.alias("speaker")), ["conv_id"], "turn", "speaker").select("conv_id", "turn", "filled", "attribution")


@query("repeat_suppression", """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT user_id, event_id, event_type, n, event_type AS last, '' AS before, true AS kept FROM e WHERE n = 1 UNION ALL
SELECT e.user_id, e.event_id, e.event_type, e.n, CASE WHEN e.event_type IN (s.last, s.before) THEN s.last ELSE e.event_type END, CASE WHEN e.event_type IN (s.last, s.before) THEN s.before ELSE s.last END, e.event_type NOT IN (s.last, s.before) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, event_id, event_type FROM s WHERE kept""")
def repeat_suppression(spark, d):
    """Events of a user without those whose type is among the last two kept."""
    e = Tables(spark, d).events.select("user_id", "event_id", "event_type")
    return tn.suppress_repeats(e, ["user_id"], "event_id", "event_type", 2)


@query("attribution_cascade", """
SELECT conv_id, turn, CASE WHEN regexp_extract(text, '^([A-Z][a-z]+) and', 1) <> '' THEN 'macro' WHEN regexp_extract(text, '\\. (The[a-z]*)', 1) <> '' THEN 'recognition' ELSE 'none' END AS kind,
CASE WHEN regexp_extract(text, '^([A-Z][a-z]+) and', 1) <> '' THEN regexp_extract(text, '^([A-Z][a-z]+) and', 1) ELSE nullif(regexp_extract(text, '\\. (The[a-z]*)', 1), '') END AS name FROM conversations""")
def attribution_cascade(spark, d):
    found = tn.attribute(F.col("text"), [("macro", r"^([A-Z][a-z]+) and"), ("recognition", r"\. (The[a-z]*)")])
    return Tables(spark, d).conversations.select("conv_id", "turn", found.alias("f")).select("conv_id", "turn", "f.kind", "f.name")


@query("fixed_groups", "SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::BIGINT AS chunk FROM conversations")
def fixed_groups(spark, d):
    return tn.fixed_groups(Tables(spark, d).conversations, ["conv_id"], ["turn"], 3).select("conv_id", "turn", "chunk")


@query("previous_value_lag", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def previous_value_lag(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return Tables(spark, d).events.select("event_id", F.lag("value").over(w).alias("previous"))


# -- captions ------------------------------------------------------------------------------------

#: Caption lines, and what each means: kind, line.
CAPTIONS = (
    ">> Mayor Ada Byron: Order, please. Councillor Tang?",
    ">> The Clerk: The next item is the budget.",
    ">> We have two crews on that road.",
    ">> Thank you, Councillor Tang. We will report back.",
    ">> Thank you, Mayor. What does it cost?",
    ">> Do you have a motion, please go ahead.",
    "and that was the plan",
    ">> Thank you, Councillor Parm.",
    ">> My name is Lisa O'Neil-Roy and I live here.",
    ">> Good morning from Councillor Wright.",
    ">> I am out of time. Seconded by Councillor Parm.",
    ">> Councillor Parm, do you have questions?",
)
_CAPTION_ROWS = ", ".join("({}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(CAPTIONS))


def _captions(t):
    """Each user's events as a meeting's caption lines."""
    kind = (F.col("event_id") * 31 + F.floor("value")) % len(CAPTIONS)
    line = F.element_at(F.array(*map(F.lit, CAPTIONS)), (kind + 1).cast("int"))
    return t.events.select(F.col("user_id").alias("meeting"), F.col("event_id").alias("pos"), F.col("event_id").alias("start"), F.col("event_id").alias("end"), line.alias("text"))


@query("caption_turns", f"""
WITH c(k, line) AS (VALUES {_CAPTION_ROWS}),
l AS (SELECT user_id AS meeting, event_id AS pos, (event_id * 31 + floor(value)::BIGINT) % {len(CAPTIONS)} AS k FROM events),
i AS (SELECT *, sum((k <> 6)::INTEGER) OVER (PARTITION BY meeting ORDER BY pos) AS raw FROM l),
r AS (SELECT meeting, raw, coalesce(max(CASE WHEN k <> 6 THEN k END), -1) AS k, count(*) FILTER (WHERE k = 6) AS more, min(pos) AS "start", max(pos) AS "end", string_agg(trim(regexp_replace(line, '^>>( Mayor Ada Byron:| The Clerk:)?', '')), ' ' ORDER BY pos) AS text FROM i JOIN c USING (k) GROUP BY ALL),
h AS (SELECT *, CASE WHEN k = 0 AND more = 0 THEN 'TANG' WHEN k = 9 AND more = 0 THEN 'WRIGHT' WHEN k = 11 AND more <= 2 THEN 'PARM' END AS hands FROM r),
b AS (SELECT *, CASE WHEN raw > 0 AND k NOT IN (0, 1) THEN lag(hands) OVER (PARTITION BY meeting ORDER BY raw) END AS got, row_number() OVER (PARTITION BY meeting ORDER BY raw) AS seq FROM h),
a AS (SELECT *, CASE WHEN k IN (0, 1) THEN 'macro' WHEN got IS NOT NULL AND NOT (k = 9 AND more <= 1 AND got <> 'WRIGHT') THEN 'recognition' WHEN k = 8 THEN 'self_intro' END AS said FROM b),
g AS (SELECT *, count(said) OVER (PARTITION BY meeting ORDER BY seq) AS run FROM a),
o AS (SELECT *, max(CASE WHEN said = 'recognition' THEN got END) OVER (PARTITION BY meeting, run) AS owner, min(seq) OVER (PARTITION BY meeting, run) AS opened FROM g),
p AS (SELECT *, CASE k WHEN 3 THEN 'TANG' WHEN 7 THEN 'PARM' END AS addressed, owner IS NOT NULL AND said IS NULL AND seq - opened BETWEEN 1 AND 60 AS bare FROM o),
q AS (SELECT *, min(CASE WHEN bare AND addressed <> owner THEN seq END) OVER (PARTITION BY meeting, run) AS stops FROM p),
s AS (SELECT *, bare AND coalesce(seq < stops, true) AS kept FROM q),
x AS (SELECT *, CASE WHEN owner IS NOT NULL AND seq = opened THEN 'owner' WHEN kept THEN CASE WHEN addressed IS NOT NULL THEN 'staff' WHEN k IN (4, 10) THEN 'owner' WHEN k IN (5, 11) AND more <= 5 THEN 'chair' END END AS known FROM s),
y AS (SELECT *, max(CASE WHEN known IS NOT NULL THEN seq END) OVER (PARTITION BY meeting, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la, min(CASE WHEN known IS NOT NULL THEN seq END) OVER (PARTITION BY meeting, run ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nb FROM x),
z AS (SELECT y.*, l.known AS lk, n.known AS nk FROM y LEFT JOIN x l ON l.meeting = y.meeting AND l.seq = y.la LEFT JOIN x n ON n.meeting = y.meeting AND n.seq = y.nb),
f AS (SELECT *, said IS NULL AND coalesce(CASE WHEN known IS NOT NULL THEN known = 'owner' ELSE kept AND (nb IS NULL OR nk = 'chair' OR ((nb - la) % 2 = 0) = ((lk = 'owner') = (nk = 'owner'))) AND ((seq - la) % 2 = 0) = (lk = 'owner') END, false) AS fills FROM z)
SELECT meeting, seq::INTEGER AS seq, "start", "end", text,
CASE WHEN fills THEN 'alternation' ELSE said END AS attribution,
CASE WHEN fills THEN owner WHEN said = 'macro' THEN CASE k WHEN 0 THEN 'Ada Byron' ELSE 'The Clerk' END WHEN said = 'recognition' THEN got WHEN said = 'self_intro' THEN 'Lisa O''Neil-Roy' END AS name,
CASE WHEN fills OR said = 'recognition' THEN 'Councillor' WHEN said = 'macro' THEN CASE k WHEN 0 THEN 'Mayor' ELSE 'Clerk' END END AS role FROM f""")
def caption_turns(spark, d):
    """Turns of every meeting's captions, with their speakers."""
    spoken = cp.turns(_captions(Tables(spark, d)), "meeting", "pos", "start", "end", "text")
    return cp.alternation(spoken, "meeting")


_ROSTER = ((0, 1, "Tang", False, 0, 500), (0, 5, "Tang", False, 500, None), (0, 3, "Wright", False, 0, None), (0, 6, "Wright", False, 300, 600), (0, 2, "Parmm", False, 0, None), (0, 4, "Byron", True, 0, None), (1, 7, "Tong", False, 0, None), (1, 8, "Ting", False, 0, 700), (1, 9, "Parm", False, 0, None), (1, 10, "Other", True, 100, None))
_ROSTER_ROWS = ", ".join(str(r).replace("None", "NULL") for r in _ROSTER)


@query("caption_members", f"""
WITH t AS ({ORACLES["caption_turns"]}), r(council, member, surname, mayor, s, e) AS (VALUES {_ROSTER_ROWS}),
q AS (SELECT meeting || ':' || seq AS turn, meeting % 2 AS council, "start" AS moment, attribution, role = 'Mayor' AS mayoral, upper(string_split(name, ' ')[-1]) AS sn FROM t WHERE name IS NOT NULL AND attribution <> 'self_intro' AND role <> 'Clerk'),
m AS (SELECT q.*, member, mayor, levenshtein(sn, upper(surname)) AS d FROM q JOIN r ON q.council = r.council AND s <= moment AND (e IS NULL OR moment < e)),
a AS (SELECT turn, attribution, list(DISTINCT member) FILTER (WHERE mayor AND mayoral) AS ms, list(DISTINCT member) FILTER (WHERE d = 0) AS xs, list(DISTINCT member) FILTER (WHERE d = 1) AS d1, list(DISTINCT member) FILTER (WHERE d = 2) AS d2 FROM m GROUP BY ALL),
f AS (SELECT turn, CASE WHEN len(ms) = 1 THEN ms[1] WHEN len(xs) = 1 THEN xs[1] END AS sure, CASE WHEN len(xs) > 1 THEN NULL WHEN len(d1) > 0 THEN CASE WHEN len(d1) = 1 THEN d1[1] END WHEN len(d2) = 1 THEN d2[1] END AS spelt, CASE attribution WHEN 'macro' THEN 0.9 WHEN 'recognition' THEN 0.7 WHEN 'alternation' THEN 0.65 END::DOUBLE AS trust FROM a)
SELECT turn, coalesce(sure, spelt)::INTEGER AS member, CASE WHEN sure IS NOT NULL THEN trust ELSE 0.6 END::DOUBLE AS confidence FROM f WHERE coalesce(sure, spelt) IS NOT NULL""")
def caption_members(spark, d):
    """The members behind the turns of captions, by rosters that change."""
    spoken = cp.alternation(cp.turns(_captions(Tables(spark, d)), "meeting", "pos", "start", "end", "text"), "meeting")
    asked = spoken.select(F.concat_ws(":", "meeting", "seq").alias("turn"), (F.col("meeting") % 2).cast("int").alias("council"), F.col("start").alias("at"), "role", "name", "attribution")
    cells = [F.struct(*(F.lit(v).cast(k).alias(n) for n, k, v in zip(("council", "member", "surname", "mayor", "start", "end"), ("int", "int", "string", "boolean", "long", "long"), r, strict=True))) for r in _ROSTER]
    roster = spark.range(1).select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    return rs.caption_members(asked, roster, "turn", "council", "at")
