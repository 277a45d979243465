"""Source, geometry, cluster, classification and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import classify as cf
from tessera.operators import cluster as cl
from tessera.operators import geo
from tessera.operators import passages as ps
from tessera.operators import relational as rel
from tessera.registry import query
from tessera.sources import landing
from tessera.sources.tables import SCHEMAS, Tables
from tessera.streaming import streams as st


# -- sources -----------------------------------------------------------------------------------





@query("transcript_turns", "SELECT page_id, 'heading' AS grammar, trim(regexp_extract(html, '(?s)<h[12][^>]*>([^<]*)', 1)) AS first_speaker FROM pages WHERE regexp_matches(html, '<h[12]\\b') AND NOT regexp_matches(html, '<p>\\s*<b>[^<]+:\\s*</b>')")
def transcript_turns(spark, d):
    turns = landing.transcript_turns(Tables(spark, d).pages, "page_id", "html")
    return turns.where("sequence = 0 AND grammar = 'heading'").select("page_id", "grammar", F.col("speaker").alias("first_speaker"))






@query("geo_ip_join", """
WITH e AS (SELECT event_id, (10 * 16777216 + (event_id % 3) * 65536 * 7 + user_id * 300)::BIGINT AS n FROM events), r AS (SELECT * FROM (VALUES (167772160, 167850000, 'CA'), (167850001, 168231000, 'US'), (168600000, 168700000, 'FR')) t(low, high, country))
SELECT event_id, country FROM e LEFT JOIN r ON n BETWEEN low AND high""")
def geo_ip_join(spark, d):
    n = F.lit(10 * 16777216) + (F.col("event_id") % 3) * (65536 * 7) + F.col("user_id") * 300
    part = lambda k: F.pmod(F.floor(n / k), F.lit(256)).cast("string")
    e = Tables(spark, d).events.select("event_id", F.concat_ws(".", part(16777216), part(65536), part(256), part(1)).alias("ip"))
    ranges = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high"), F.lit(c).alias("country")) for a, b, c in ((167772160, 167850000, "CA"), (167850001, 168231000, "US"), (168600000, 168700000, "FR"))))).alias("r")).select("r.*")
    return landing.geo_ip(e, "ip", ranges).select("event_id", "country")


@query("social_post_fields", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props->>'$.k' END AS likes FROM events")
def social_post_fields(spark, d):
    e = Tables(spark, d).events.withColumn("platform", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"))
    return landing.social_posts(e, "props", {"a": {"likes": "$.k"}, "b": {"likes": "$.none"}}).select("event_id", "likes")


@query("sample_to_target", "SELECT doc_id, lang FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT 100")
def sample_to_target(spark, d):
    """A sampling operator: a hundred documents."""
    return landing.sample_to(Tables(spark, d).documents.select("doc_id", "lang"), 100, "doc_id", 5)


# -- classification ----------------------------------------------------------------------------


@query("hosting_tiers", """
SELECT c_custkey, CASE WHEN f AND country IS NULL AND p IS NULL AND cdn IS NULL THEN 6 WHEN country = 'CA' AND dom THEN 1 WHEN country = 'CA' THEN 2 WHEN cdn IS NOT NULL THEN 3 WHEN country = 'US' THEN 4 WHEN country IS NOT NULL THEN 5 WHEN p IS NOT NULL THEN 5 ELSE 6 END::INTEGER AS tier FROM (
SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'US' WHEN 2 THEN 'FR' END AS country, CASE WHEN c_custkey % 3 = 0 THEN 'host' END AS p, c_custkey % 2 = 0 AS dom, CASE WHEN c_custkey % 5 = 0 THEN 'edge' END AS cdn, c_custkey % 7 = 0 AS f FROM customer)""")
def hosting_tiers(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    country = F.when(n == 0, "CA").when(n == 1, "US").when(n == 2, "FR")
    tier = cf.hosting_tier(country, F.when(k % 3 == 0, "host"), k % 2 == 0, F.when(k % 5 == 0, "edge"), k % 7 == 0)
    return Tables(spark, d).customer.select("c_custkey", tier.alias("tier"))


@query("hosting_profiles", """
WITH x AS (SELECT c_custkey, ['CA', 'US', NULL][c_nationkey % 3 + 1] AS country, c_custkey % 2 = 0 AS failed, c_custkey % 6 = 2 OR c_custkey % 11 = 0 AS dom,
[NULL, 'Amazon Web Services', NULL, NULL, 'OVHcloud', NULL][c_custkey % 6 + 1] AS op, [NULL, NULL, NULL, 'Cloudflare', NULL, NULL][c_custkey % 6 + 1] AS oc,
[NULL, 'Netlify', NULL, 'AWS CloudFront'][c_nationkey % 4 + 1] AS cc, [NULL, 'Wix', NULL, NULL][c_nationkey % 4 + 1] AS cw,
[NULL, NULL, 'Google', 'WordPress.com (Automattic)', NULL][c_custkey % 5 + 1] AS sp, [NULL, NULL, NULL, 'WordPress', 'Drupal'][c_custkey % 5 + 1] AS sm, CASE WHEN c_custkey % 7 = 0 THEN 'Akamai' END AS nc FROM customer),
y AS (SELECT *, coalesce(cc, oc, nc) AS cdn, coalesce(op, cw, sp, cc, oc, nc) AS provider, coalesce(sm, cw) AS cms FROM x)
SELECT c_custkey, provider, country, cdn, cms, CASE WHEN failed AND country IS NULL AND provider IS NULL THEN 6 WHEN country = 'CA' AND dom THEN 1 WHEN country = 'CA' THEN 2 WHEN cdn IS NOT NULL THEN 3 WHEN country = 'US' THEN 4 WHEN provider IS NOT NULL THEN 5 ELSE 6 END::INTEGER AS tier FROM y""")
def hosting_profiles(spark, d):
    """Tier, provider, CDN and content system of sites from network owners, names and headers."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda i, *xs: F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), (i % len(xs) + 1).cast("int"))
    names = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit("www.x.Netlify.app"), F.lit("x.wixdns.net"))).when(n % 4 == 3, F.array(F.lit("d1.cloudfront.net")))
    seen = cf.hosting(
        pick(n, "CA", "US", None), pick(k, None, "AMAZON-02", "Bell Canada", "Cloudflare, Inc.", "OVH SAS", "Example Net"), F.when(k % 11 == 0, "AS577").otherwise("AS15169"),
        names, pick(k, None, "nginx", "Google Frontend", "WordPress VIP", "Drupal 9"), F.lit(None).cast("string"), F.when(k % 7 == 0, F.array(F.lit(None).cast("string"), F.lit("a.akamai.com"))), k % 2 == 0,
    )
    return Tables(spark, d).customer.select("c_custkey", seen.alias("h")).select("c_custkey", "h.*")


@query("first_label_in_order", "SELECT p_partkey, CASE WHEN p_name ILIKE '%ring%' THEN 'R' WHEN p_name ILIKE '%widget%' THEN 'W' WHEN p_type ILIKE '%ring%' THEN 'R' WHEN p_type ILIKE '%econ%' THEN 'E' END AS label FROM part")
def first_label_in_order(spark, d):
    label = cf.first_label([F.col("p_name"), F.col("p_type")], {"RING": "R", "widget": "W", "Econ": "E"})
    return Tables(spark, d).part.select("p_partkey", label.alias("label"))


@query("review_flags", "SELECT c_custkey, CASE WHEN conf >= CASE WHEN c_mktsegment IN ('BUILDING') THEN 0.85 ELSE 0.95 END THEN 'promote' WHEN conf >= 0.7 THEN 'flag' ELSE 'reject' END AS flag FROM (SELECT *, abs(c_acctbal) / 10000 AS conf FROM customer)")
def review_flags(spark, d):
    return Tables(spark, d).customer.select("c_custkey", cf.review_flag(F.col("c_mktsegment"), F.abs("c_acctbal") / 10000, ("BUILDING",)).alias("flag"))


@query("site_classes", "SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'shared' WHEN regexp_matches(lower(url), 'cheap-pills\\.example|thther\\.example') THEN 'party_managed' ELSE 'personal' END AS class FROM pages")
def site_classes(spark, d):
    label = F.when(F.col("page_id") % 10 == 0, "shared_official")
    return Tables(spark, d).pages.select("page_id", cf.site_class(label, F.col("url"), ("cheap-pills.example", "thther.example")).alias("class"))


# -- geometry ----------------------------------------------------------------------------------


@query("point_in_polygon", """
WITH s AS (SELECT x, y FROM range(0, 5) a(x), range(0, 4) b(y)), p AS (SELECT c_custkey, (c_custkey % 97) / 9.0 AS px, (c_custkey % 89) / 11.0 AS py FROM customer)
SELECT c_custkey, (x * 10 + y)::BIGINT AS shape FROM p JOIN s ON px >= x * 2 AND px < x * 2 + 1.5 AND py >= y * 2 AND py < y * 2 + 1.5
WHERE NOT (px >= x * 2 + 0.5 AND px < x * 2 + 1 AND py >= y * 2 + 0.5 AND py < y * 2 + 1)""")
def point_in_polygon(spark, d):
    x, y = F.col("x") * 2.0, F.col("y") * 2.0
    corner = lambda a, b: F.struct((x + a).alias("lng"), (y + b).alias("lat"))
    square = lambda a, b: F.array(corner(a, a), corner(b, a), corner(b, b), corner(a, b), corner(a, a))
    shapes = spark.range(5).withColumnRenamed("id", "x").crossJoin(spark.range(4).withColumnRenamed("id", "y"))
    shapes = shapes.select((F.col("x") * 10 + F.col("y")).alias("shape"), F.array(square(0.0, 1.5), square(0.5, 1.0)).alias("rings"))
    shapes = shapes.select("*", *(c.alias(k) for k, c in geo.bounds(F.col("rings")).items()))
    points = Tables(spark, d).customer.select("c_custkey", ((F.col("c_custkey") % 97) / 9.0).alias("px"), ((F.col("c_custkey") % 89) / 11.0).alias("py"))
    return geo.polygon_join(points, "px", "py", shapes, "rings").select("c_custkey", "shape")


def _ring(*corners):
    """A closed ring of (x, y) columns."""
    return F.array(*(F.struct(F.lit(x).cast("double").alias("lng"), F.lit(y).cast("double").alias("lat")) for x, y in (*corners, corners[0])))


@query("polygon_measures", """
SELECT c_custkey, round((3 + c_custkey % 4) * (1 + c_custkey % 6) / 2.0 - CASE WHEN c_custkey % 2 = 0 THEN 0.01 ELSE 0 END, 6) AS area,
round((c_custkey % 7 * 3 + 5 + c_custkey % 4) / 3.0, 6) AS lng, round(c_custkey % 5 + (1 + c_custkey % 6) / 3.0, 6) AS lat FROM customer""")
def polygon_measures(spark, d):
    """Triangles, clockwise or not, every other one with a hole about its centre of mass."""
    k = F.col("c_custkey")
    x, y, wide, high = k % 7, k % 5, 3 + k % 4, 1 + k % 6
    a, b, c = (x, y), (x + wide, y), (x + 2, y + high)
    cx, cy = (x * 3 + 2 + wide) / 3, y + high / 3
    hole = _ring((cx - 0.05, cy - 0.05), (cx + 0.05, cy - 0.05), (cx + 0.05, cy + 0.05), (cx - 0.05, cy + 0.05))
    outline = F.when(k % 3 == 0, _ring(a, c, b)).otherwise(_ring(a, b, c))
    rings = F.when(k % 2 == 0, F.array(outline, hole)).otherwise(F.array(outline))
    shapes = Tables(spark, d).customer.select("c_custkey", rings.alias("rings"))
    middle = geo.weighted_centroid(F.col("rings"))
    return shapes.select("c_custkey", F.round(geo.area(F.col("rings")), 6).alias("area"), F.round(middle["lng"], 6).alias("lng"), F.round(middle["lat"], 6).alias("lat"))


@query("polygon_simplified", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 8 END AS corners, round(((10 + c_custkey % 9) * (5 + c_custkey % 4) + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 0.25 * (10 + c_custkey % 9) END)::DOUBLE, 6) AS area, 1 AS rings FROM customer""")
def polygon_simplified(spark, d):
    """Boxes whose sides waver by less than the tolerance, every other one with a peak that stays; a tiny hole goes."""
    k = F.col("c_custkey")
    w, h = 10 + k % 9, 5 + k % 4
    peak = F.when(k % 2 == 0, h + 0.05).otherwise(h + 1.0)
    outline = _ring((0, 0), (w * 0.5, 0.01), (w, 0), (w + 0.02, h * 0.5), (w, h), (w * 0.75, h + 0.01), (w * 0.5, peak), (w * 0.25, h - 0.01), (0, h))
    hole = _ring((1.0, 1.0), (1.01, 1.0), (1.01, 1.01))
    shapes = Tables(spark, d).customer.select("c_custkey", geo.simplify(F.array(outline, hole), 0.1).alias("rings"))
    return shapes.select("c_custkey", F.size(F.col("rings")[0]).alias("corners"), F.round(geo.area(F.col("rings")), 6).alias("area"), F.size("rings").alias("rings"))


@query("geojson_features", "SELECT n_nationkey, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || ',' || n_regionkey || ']},\"properties\":{\"name\":\"' || n_name || '\"}}' AS feature FROM nation")
def geojson_features(spark, d):
    f = geo.feature(geo.point(F.col("n_nationkey"), F.col("n_regionkey")), F.struct(F.col("n_name").alias("name")))
    return Tables(spark, d).nation.select("n_nationkey", f.alias("feature"))


# -- clusters ----------------------------------------------------------------------------------


@query("cluster_stats", "SELECT label, count(*) AS members, round(avg(embedding[1]::DOUBLE), 6) AS c1, round(avg(embedding[64]::DOUBLE), 6) AS c64 FROM embeddings GROUP BY 1")
def cluster_stats(spark, d):
    c = cl.centroids(Tables(spark, d).embeddings, "label", 64)
    return c.select("label", "members", F.round(F.col("centroid")[0], 6).alias("c1"), F.round(F.col("centroid")[63], 6).alias("c64"))


@query("nearest_centroid", """
WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) u(i) GROUP BY ALL),
x AS (SELECT vec_id, c.label, round(sqrt(sum((embedding[i]::DOUBLE - m) * (embedding[i]::DOUBLE - m))), 9) AS dist FROM embeddings e, c GROUP BY ALL)
SELECT vec_id, label FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) = 1""")
def nearest_centroid(spark, d):
    e = Tables(spark, d).embeddings
    return cl.assign(e, cl.centroids(e, "label", 64), "label", "vec_id")


@query("cluster_parents", "SELECT label, parent FROM (SELECT label, vec_id % 3 AS parent, count(*) AS n FROM embeddings WHERE label <> 9 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, parent) = 1")
def cluster_parents(spark, d):
    e = Tables(spark, d).embeddings.withColumns({"parent": F.col("vec_id") % 3, "label": F.when(F.col("label") == 9, -1).otherwise(F.col("label"))})
    return cl.parents(e, "label", "parent")


@query("cluster_levels")
def cluster_levels(spark, d):
    return cl.cluster_levels(Tables(spark, d).embeddings, "vec_id", {"l1": 4, "l2": 12})


@query("projection")
def projection(spark, d):
    return cl.project(Tables(spark, d).embeddings, "vec_id", 3)


@query("stratified_sample", "SELECT lang, round(200.0 * count(*) / (SELECT count(*) FROM documents))::BIGINT AS n FROM documents GROUP BY 1")
def stratified_sample(spark, d):
    t = Tables(spark, d).documents.select("doc_id", "lang")
    return cl.stratified_sample(t, ["lang"], "doc_id", 200).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


# -- streams -----------------------------------------------------------------------------------


def _events(spark, d):
    return st.file_stream(spark, f"{d}/events.parque[t]", SCHEMAS["events"])  # as a pattern: a lone file is no folder


@query("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    agg = st.tumbling(_events(spark, d), "ts", "5 minutes", "1 hour", {"n": F.count(F.lit(1)), "total": F.sum("value")}, ("event_type",))
    return st.drain(agg, "tumbling", "complete").select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "event_type", "n", F.round("total", 2).alias("total"))


@query("stream_sliding", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (k) HOUR, '%Y-%m-%d %H:%M') AS bucket, count(*) AS n FROM events, range(0, 2) u(k) GROUP BY 1")
def stream_sliding(spark, d):
    agg = st.sliding(_events(spark, d), "ts", "2 hours", "1 hour", "1 hour", {"n": F.count(F.lit(1))})
    return st.drain(agg, "sliding", "complete").select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "n")


@query("stream_sessions", """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, d):
    agg = st.sessions(_events(spark, d), "ts", "user_id", "6 hours", "1 hour")
    return st.drain(agg, "sessions", "complete").select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("stream_idempotent", "SELECT event_id, event_type FROM events")
def stream_idempotent(spark, d):
    twice = _events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return st.drain(st.idempotent(twice, "ts", ["event_id"]).select("event_id", "event_type"), "idempotent")


@query("alert_matches", """
WITH s AS (SELECT * FROM (VALUES (1, 'error', TIMESTAMP '2024-01-20', 'daily'), (2, 'signup', NULL, 'weekly'), (3, 'view', TIMESTAMP '2024-01-24 12:00:00', 'daily'), (4, 'click', TIMESTAMP '2024-01-22', 'weekly')) t(sid, kind, mark, cadence)),
due AS (SELECT * FROM s WHERE mark IS NULL OR mark < TIMESTAMP '2024-01-25' - CASE cadence WHEN 'daily' THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END)
SELECT sid, event_id FROM events JOIN due ON event_type = kind WHERE ts > coalesce(mark, TIMESTAMP '2024-01-25' - INTERVAL 30 DAY) AND ts <= TIMESTAMP '2024-01-25'""")
def alert_matches(spark, d):
    as_of = F.lit("2024-01-25").cast("timestamp")
    rows = [(1, "error", "2024-01-20", "daily"), (2, "signup", None, "weekly"), (3, "view", "2024-01-24 12:00:00", "daily"), (4, "click", "2024-01-22", "weekly")]
    cell = lambda r: F.struct(F.lit(r[0]).alias("sid"), F.lit(r[1]).alias("kind"), F.lit(r[2]).cast("timestamp").alias("last_checked_at"), F.lit(r[3]).alias("cadence"))
    searches = spark.range(1).select(F.explode(F.array(*map(cell, rows))).alias("s")).select("s.*")
    return st.new_matches(Tables(spark, d).events, st.due(searches, as_of), lambda: F.col("event_type") == F.col("kind"), "ts", as_of).select("sid", "event_id")


@query("pending_queue", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_queue(spark, d):
    t = Tables(spark, d)
    return st.pending(t.documents.select("doc_id"), t.labels, "doc_id")


@query("materialized_view", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def materialized_view(spark, d):
    """A view kept as a table: rebuilt under a fresh path, then read."""
    path = st.shared(spark, "view")
    Tables(spark, d).customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return spark.read.schema("c_nationkey int, n long").parquet(path)


@query("small_side_checked", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def small_side_checked(spark, d):
    t = Tables(spark, d)
    return t.nation.join(rel.small(t.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
