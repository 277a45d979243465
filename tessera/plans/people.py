"""Names, labels, resolution and report queries; short literal inputs where the shapes are textual."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import aggregates as ag
from tessera.operators import relational as rel
from tessera.operators import resolve as rs
from tessera.operators import vector as vec
from tessera.registry import query
from tessera.sources.tables import Tables


def rows(spark, schema: str, *values):
    """A literal table: (schema, tuples)."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split(" ", 1)[1] for c in schema.split(", ")]
    cells = [F.struct(*(F.lit(v).cast(k).alias(n) for n, k, v in zip(names, kinds, r, strict=True))) for r in values]
    return spark.range(1).select(F.explode(F.array(*cells)).alias("r")).select("r.*")


@query("role_relink_counts", "SELECT CASE WHEN regexp_matches(role, '^(assistant|system)$') THEN 'staff' ELSE 'public' END AS kind, count(*) AS n FROM conversations GROUP BY 1")
def role_relink_counts(spark, d):
    kind = F.when(F.col("role").rlike("^(assistant|system)$"), "staff").otherwise("public")
    return Tables(spark, d).conversations.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("rollup_with_defaults", "SELECT coalesce(quality::VARCHAR, 'unlabelled') AS quality, coalesce(nullif(lang, 'de'), 'other') AS language, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(quality::VARCHAR, 'unlabelled'), coalesce(nullif(lang, 'de'), 'other'))::INTEGER AS place FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2 QUALIFY place <= 6")
def rollup_with_defaults(spark, d):
    t = Tables(spark, d)
    j = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    g = j.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unlabelled")).alias("quality"), F.coalesce(F.nullif("lang", F.lit("de")), F.lit("other")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    top = g.orderBy(F.desc("n"), "quality", "language").limit(6)  # a report's few rows
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "quality", "language")))


@query("report_selection", "SELECT e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE label = 2 AND 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) <= 1.05 ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), vec_id LIMIT 40")
def report_selection(spark, d):
    e = Tables(spark, d).embeddings
    near = vec.with_similarity(e.where("label = 2"), vec.anchor_vector(e, "vec_id", 3)).withColumn("distance", 1 - F.col("similarity"))
    return near.where("distance <= 1.05").orderBy("distance", "vec_id").limit(40).select("vec_id", F.round("distance", 6).alias("distance"))


@query("cluster_browse", "SELECT label // 5 AS parent, label, count(*) AS members, min(vec_id) AS first FROM embeddings WHERE label // 5 = 1 GROUP BY ALL ORDER BY members DESC, label")
def cluster_browse(spark, d):
    e = Tables(spark, d).embeddings.withColumn("parent", F.floor(F.col("label") / 5).cast("int"))
    return e.where("parent = 1").groupBy("parent", "label").agg(F.count(F.lit(1)).alias("members"), F.min("vec_id").alias("first"))


@query("duplicate_people", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey AND abs(a.c_acctbal - b.c_acctbal) < 50 AND a.c_custkey < b.c_custkey")
def duplicate_people(spark, d):
    return rel.near_pairs(Tables(spark, d).customer, ["c_mktsegment", "c_nationkey"], "c_custkey", "c_acctbal", 50)


@query("status_rollup", "SELECT CASE WHEN n_regionkey = 0 THEN 'live' ELSE 'none' END AS status, count(*) AS n, count(*) FILTER (n_nationkey % 2 = 0) AS even FROM nation GROUP BY 1")
def status_rollup(spark, d):
    status = F.when(F.col("n_regionkey") == 0, "live").otherwise("none")
    return Tables(spark, d).nation.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_nationkey") % 2 == 0).alias("even"))


@query("best_and_worst", "SELECT o_custkey, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS worst, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY 1")
def best_and_worst(spark, d):
    k = F.struct("o_totalprice", "o_orderkey")
    return Tables(spark, d).orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", k).alias("worst"), F.max_by("o_orderkey", k).alias("best"))


@query("guarded_average", "SELECT c_mktsegment, round(avg(c_acctbal) FILTER (c_acctbal > 9900), 6) AS mean FROM customer GROUP BY 1")
def guarded_average(spark, d):
    return Tables(spark, d).customer.groupBy("c_mktsegment").agg(F.round(F.avg(F.when(F.col("c_acctbal") > 9900, F.col("c_acctbal"))), 6).alias("mean"))


@query("percent_helper", "SELECT round(coalesce(100.0 * count(*) FILTER (value > 50) / nullif(count(*), 0), 0), 6) AS pct FROM events")
def percent_helper(spark, d):
    return Tables(spark, d).events.agg(ag.percent(F.col("value") > 50).alias("pct"))


@query("resolve_legislatures", """
WITH m AS (SELECT s_suppkey AS member, CASE WHEN s_suppkey % 4 = 0 THEN 'van de' ELSE 'de' END || s_suppkey % 37 AS full_name, 'de' || s_suppkey % 37 AS last_word FROM supplier),
keys AS (SELECT member, full_name AS key FROM m UNION SELECT member, last_word FROM m), terms AS (SELECT DISTINCT s_suppkey AS member, s_suppkey % 5 + k AS legl FROM supplier, range(0, 3) u(k)),
f AS (SELECT o_orderkey AS id, o_custkey AS doc, year(o_orderdate) - 1992 AS legl, CASE WHEN o_orderkey % 9 = 0 THEN 'van de' ELSE 'de' END || o_orderkey % 41 AS key, CASE WHEN o_orderkey % 3 = 0 THEN (SELECT member FROM m WHERE member = o_orderkey % 100) END AS given FROM orders),
one AS (SELECT id, min(member) AS member FROM f JOIN keys USING (key) JOIN terms USING (member, legl) WHERE given IS NULL GROUP BY id HAVING count(DISTINCT member) = 1),
known AS (SELECT DISTINCT doc, coalesce(given, one.member) AS member FROM f LEFT JOIN one USING (id) WHERE coalesce(given, one.member) IS NOT NULL),
two AS (SELECT id, min(member) AS member FROM (SELECT * FROM f WHERE given IS NULL AND id NOT IN (SELECT id FROM one)) JOIN (SELECT * FROM known JOIN keys USING (member)) USING (doc, key) JOIN terms USING (member, legl) GROUP BY id HAVING count(DISTINCT member) = 1)
SELECT id AS o_orderkey, member, 0.9::DOUBLE AS confidence FROM one UNION ALL SELECT id, member, 0.75::DOUBLE FROM two""")
def resolve_legislatures(spark, d):
    """Surnames within a legislature, whose terms overlap, then along each document: what is attributed there carries over."""
    t = Tables(spark, d)
    key, n = F.col("s_suppkey"), F.col("o_orderkey")
    members = t.supplier.select(key.alias("member"), F.concat(F.when(key % 4 == 0, "Van Dé").otherwise("Dé"), (key % 37).cast("string")).alias("last"))
    terms = t.supplier.select(key.alias("member"), F.explode(F.array(*(key % 5 + k for k in (0, 1, 1, 2)))).alias("legl"))
    speech = F.concat(F.when(n % 9 == 0, "VAN DE").otherwise("dé"), (n % 41).cast("string"))
    facts = t.orders.select("o_orderkey", "o_custkey", (F.year("o_orderdate").cast("long") - 1992).alias("legl"), speech.alias("surname"), F.when(n % 3 == 0, n % 100).alias("given"))
    given = facts.join(members.select(F.col("member").alias("given")), "given", "left_semi").select("o_orderkey", "o_custkey", F.col("given").alias("member"))
    open_ = facts.join(given, "o_orderkey", "left_anti")
    one = rs.by_legislature(open_, members, terms, "o_orderkey", "legl", "surname", "member", "last")
    attributed = given.unionByName(open_.join(one, "o_orderkey").select("o_orderkey", "o_custkey", "member"))
    two = rs.continued(attributed, open_.join(one, "o_orderkey", "left_anti"), members, terms, "o_orderkey", "o_custkey", "legl", "surname", "member", "last")
    return one.unionByName(two)
