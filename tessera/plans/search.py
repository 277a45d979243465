"""Search queries over passages with vectors: embeddings stand for passages, label for their group."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as ag
from tessera.operators import relational as rel
from tessera.operators import vector as vec
from tessera.plans import filters
from tessera.registry import query
from tessera.sources.tables import Tables
from tessera.streaming.streams import shared

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_ALL = f"(SELECT e.vec_id, e.label, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _anchor(t):
    return vec.anchor_vector(t.embeddings, "vec_id", 0)


@query("anchor_topk", f"SELECT vec_id, label, round(s, 6) AS similarity FROM {_ALL} WHERE vec_id <> 0 ORDER BY s DESC, vec_id LIMIT 20")
def anchor_topk(spark, d):
    t = Tables(spark, d)
    return vec.knn(t.embeddings, _anchor(t), "vec_id", 20, exclude=0).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("anchor_floor", f"SELECT vec_id, round(s, 6) AS similarity FROM {_ALL} WHERE vec_id <> 0 AND s >= 0.2 ORDER BY s DESC, vec_id LIMIT 100")
def anchor_floor(spark, d):
    t = Tables(spark, d)
    return vec.knn(t.embeddings, _anchor(t), "vec_id", 100, floor=0.2, exclude=0).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("anchor_filtered", f"SELECT vec_id, label, round(s, 6) AS similarity FROM {_ALL} WHERE vec_id <> 0 AND label IN (1, 4, 7) ORDER BY s DESC, vec_id LIMIT 10")
def anchor_filtered(spark, d):
    t = Tables(spark, d)
    f = filters.SearchFilter(ids=(1, 4, 7, 4), columns={"id": "label", "at": "vec_id"})
    return vec.knn(t.embeddings.where(filters.predicate(f)), _anchor(t), "vec_id", 10, exclude=0).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("anchor_missing", "SELECT vec_id, 0.0::DOUBLE AS similarity FROM embeddings WHERE false")
def anchor_missing(spark, d):
    t = Tables(spark, d)
    return vec.knn(t.embeddings, vec.anchor_vector(t.embeddings, "vec_id", -5), "vec_id", 20).select("vec_id", "similarity")


@query("anchor_count_capped", f"SELECT least(count(*), 100)::BIGINT AS total, count(*) > 100 AS capped FROM {_ALL} WHERE 1 - s <= 1.0")
def anchor_count_capped(spark, d):
    t = Tables(spark, d)
    near = vec.with_similarity(t.embeddings, _anchor(t)).withColumn("distance", 1 - F.col("similarity"))
    return rel.capped_count(near, "distance", 1.0, 100).select(F.col("total").cast("long").alias("total"), "capped")


def _grouped(sort, order):
    @query(f"grouped_search_{sort}", f"""
WITH near AS (SELECT * FROM {_ALL} ORDER BY s DESC, vec_id LIMIT 200), ok AS (SELECT *, label % 2 = 0 AS hit FROM near WHERE label IS NOT NULL AND s >= 0.05),
stats AS (SELECT label, count(*) AS mentions, max(s) AS best, avg(s) AS average, count(*) FILTER (hit) AS keyword_hits FROM ok GROUP BY label ORDER BY {order} DESC, best DESC, label LIMIT 4)
SELECT label, vec_id, round(s, 6) AS similarity, r::INTEGER AS place, mentions, round(average, 6) AS average, keyword_hits
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM ok) JOIN stats USING (label) WHERE r <= 3""")
    def run(spark, d):
        t = Tables(spark, d)
        out = vec.grouped_search(t.embeddings, _anchor(t), "vec_id", "label", sort, pool=200, floor=0.05, groups=4, per_group=3, hits=F.col("label") % 2 == 0)
        return out.select("label", "vec_id", F.round("similarity", 6).alias("similarity"), "place", "mentions", F.round("average", 6).alias("average"), "keyword_hits")

    return run


for _s, _o in (("mentions", "mentions"), ("best_match", "best"), ("avg_match", "average"), ("keyword_hits", "keyword_hits")):
    _grouped(_s, _o)


@query("related_best_per_group", f"""
WITH near AS (SELECT * FROM {_ALL} WHERE label <> (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY s DESC, vec_id LIMIT 30)
SELECT label, vec_id, round(s, 6) AS similarity FROM near QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1 ORDER BY s DESC, vec_id LIMIT 5""")
def related_best_per_group(spark, d):
    t = Tables(spark, d)
    own = t.embeddings.where("vec_id = 0").select(F.col("label").alias("own"))
    others = t.embeddings.crossJoin(F.broadcast(own.limit(1))).where(F.col("label") != F.col("own")).drop("own")
    return vec.best_per_parent(others, _anchor(t), "vec_id", "label", 5).select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("facets_topk", f"""
WITH k AS (SELECT *, vec_id % 7 AS bucket FROM {_ALL} ORDER BY s DESC, vec_id LIMIT 200),
f AS (SELECT 'label' AS facet, label::VARCHAR AS key, s FROM k UNION ALL SELECT 'bucket', bucket::VARCHAR, s FROM k)
SELECT facet, key, count(*) AS n, round(avg(s), 3) AS avg_score FROM f GROUP BY 1, 2 QUALIFY facet <> 'label' OR row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, key) <= 10""")
def facets_topk(spark, d):
    t = Tables(spark, d)
    top = vec.knn(t.embeddings, _anchor(t), "vec_id", 200)
    return ag.facets(top, {"label": F.col("label"), "bucket": F.col("vec_id") % 7}, "similarity", {"label": 10})


@query("recent_mode", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 20")
def recent_mode(spark, d):
    return vec.recent(Tables(spark, d).events, "ts", "event_id", 20).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("filter_dates_half_open", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-03-16' AND o_orderpriority = '1-URGENT'")
def filter_dates_half_open(spark, d):
    f = filters.SearchFilter(party="1-URGENT", date_from="1997-03-01", date_to="1997-03-15", columns={"party": "o_orderpriority", "at": "o_orderdate"})
    return Tables(spark, d).orders.where(filters.predicate(f)).select("o_orderkey")


@query("filter_dates_alert_end", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate <= TIMESTAMP '1997-03-15'")
def filter_dates_alert_end(spark, d):
    f = filters.SearchFilter(date_from="1997-03-01", date_to="1997-03-15", inclusive_end=False, columns={"at": "o_orderdate"})
    return Tables(spark, d).orders.where(filters.predicate(f)).select("o_orderkey")


@query("filter_empty_selector", "SELECT o_orderkey FROM orders WHERE false")
def filter_empty_selector(spark, d):
    f = filters.SearchFilter(resolved=True, columns={"at": "o_orderdate"})
    return Tables(spark, d).orders.where(filters.predicate(f)).select("o_orderkey")


@query("filter_pair_ignored", "SELECT p_partkey FROM part WHERE p_size = 7 AND p_type = 'ECONOMY' UNION ALL SELECT -p_partkey FROM part")
def filter_pair_ignored(spark, d):
    p = Tables(spark, d).part
    names = {"parliament": "p_size", "session": "p_type", "at": "p_partkey"}
    both = p.where(filters.predicate(filters.SearchFilter(parliament=7, session="ECONOMY", columns=names)))
    one = p.where(filters.predicate(filters.SearchFilter(parliament=7, columns=names)))
    return both.select("p_partkey").unionByName(one.select((-F.col("p_partkey")).alias("p_partkey")))


@query("filter_ilike_columns", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' OR p_type ILIKE '%RING%'")
def filter_ilike_columns(spark, d):
    f = filters.SearchFilter(text_like=("RING",), columns={"text": ("p_name", "p_type"), "at": "p_partkey"})
    return Tables(spark, d).part.where(filters.predicate(f)).select("p_partkey")


@query("filter_tokens_folded", "SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'eau') AND contains(strip_accents(lower(text)), 'ere')")
def filter_tokens_folded(spark, d):
    return filters.token_search(Tables(spark, d).documents, F.col("text"), "Éau èRe").select("doc_id")


@query("filter_json_path", "SELECT event_id FROM events WHERE props->>'$.k' IS NOT NULL AND (props->>'$.k')::INTEGER > 50")
def filter_json_path(spark, d):
    k = F.get_json_object("props", "$.k")
    return Tables(spark, d).events.where(k.isNotNull() & (k.cast("int") > 50)).select("event_id")


@query("filter_regex_null_aware", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE regexp_matches(source, '(?i)^SRC1?[0-4]$') AND coalesce(l.toxic, 0) <> 1 AND l.quality IS DISTINCT FROM 0")
def filter_regex_null_aware(spark, d):
    t = Tables(spark, d)
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return j.where(F.col("source").rlike("(?i)^SRC1?[0-4]$") & (F.coalesce("toxic", F.lit(0)) != 1) & ~F.col("quality").eqNullSafe(F.lit(0))).select("doc_id")


@query("filter_bbox", "SELECT p_partkey FROM part WHERE p_size <= 20 AND p_size + 5 >= 10 AND p_retailprice <= 1000 AND p_retailprice + 50 >= 950")
def filter_bbox(spark, d):
    p = Tables(spark, d).part.withColumns({"x2": F.col("p_size") + 5, "y2": F.col("p_retailprice") + 50})
    return p.where(filters.bbox_overlaps("p_size", "p_retailprice", "x2", "y2", (10, 950, 20, 1000))).select("p_partkey")


@query("filter_presiding_active", "SELECT conv_id, turn FROM conversations WHERE coalesce(nullif(role, 'user'), '') = '' AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def filter_presiding_active(spark, d):
    c = Tables(spark, d).conversations
    people = c.groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("is_active"))
    rows = filters.exclude_presiding(c.withColumn("role", F.nullif("role", F.lit("user"))), "role")
    return filters.only_active(rows, people, "conv_id").select("conv_id", "turn")


@query("ndcg_recall", f"""
WITH q AS (SELECT vec_id AS query, embedding, label FROM embeddings WHERE vec_id < 8),
r AS (SELECT q.query, q.label, e.vec_id, e.label AS l, row_number() OVER (PARTITION BY q.query ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM q, embeddings e WHERE e.vec_id <> q.query),
g AS (SELECT query, count(*) AS n FROM r WHERE l = label GROUP BY 1), i AS (SELECT query, sum(1 / log2(k + 1)) AS ideal FROM g, range(1, 11) u(k) WHERE k <= n GROUP BY 1)
SELECT query, round(coalesce(sum(1 / log2(rank + 1)) FILTER (l = label) / any_value(ideal), 0), 6) AS ndcg, round(coalesce(count(*) FILTER (l = label) * 1.0 / any_value(n), 0), 6) AS recall FROM r LEFT JOIN g USING (query) LEFT JOIN i USING (query) WHERE rank <= 10 GROUP BY query""")
def ndcg_recall(spark, d):
    from pyspark.sql.window import Window

    e = Tables(spark, d).embeddings
    q = e.where("vec_id < 8").select(F.col("vec_id").alias("query"), F.col("embedding").alias("_q"), F.col("label").alias("ql"))
    scored = e.crossJoin(rel.small(q)).where("vec_id <> query").withColumn("s", vec.cosine("embedding", "_q"))
    w = Window.partitionBy("query").orderBy(F.desc("s"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).select("query", "vec_id", "rank", (F.col("label") == F.col("ql")).alias("rel"))
    return vec.ndcg(ranked, ranked.where("rel"), "query", "vec_id", "rank", 10)


@query("margin_match", """
WITH c AS (SELECT label, [avg(embedding[i]::DOUBLE) FOR i IN range(1, 65)] AS dummy FROM embeddings WHERE false GROUP BY label),
s AS (SELECT e.vec_id, r.vec_id AS reference, list_cosine_similarity(e.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 10) r WHERE e.vec_id >= 10),
t AS (SELECT *, row_number() OVER w AS p, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, reference))
SELECT vec_id, reference, round(score, 6) AS score FROM t WHERE p = 1 AND score >= 0.2 AND score - second >= 0.05""".replace("""WITH c AS (SELECT label, [avg(embedding[i]::DOUBLE) FOR i IN range(1, 65)] AS dummy FROM embeddings WHERE false GROUP BY label),
s AS""", "WITH s AS"))
def margin_match(spark, d):
    e = Tables(spark, d).embeddings
    out = vec.margin_match(e.where("vec_id >= 10"), e.where("vec_id < 10"), "vec_id", "vec_id", 0.2, 0.05)
    return out.select("vec_id", "reference", F.round("score", 6).alias("score"))


@query("centroid_distance", """
WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) u(i) GROUP BY ALL),
x AS (SELECT vec_id, e.label, sqrt(sum((embedding[i]::DOUBLE - m) * (embedding[i]::DOUBLE - m))) AS dist FROM embeddings e JOIN c ON e.label = c.label GROUP BY ALL)
SELECT label, vec_id, round(dist, 6) AS distance FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(dist, 9), vec_id) <= 15""")
def centroid_distance(spark, d):
    from tessera.operators.cluster import centroids, representatives

    e = Tables(spark, d).embeddings
    return representatives(e, centroids(e, "label", 64), "label", "vec_id", 15).select("label", "vec_id", F.round("distance", 6).alias("distance"))


@query("approximate_recall")
def approximate_recall(spark, d):
    """Recall at 10 of the hyperplane index against exact search, for ids divisible by 100."""
    e = Tables(spark, d).embeddings.select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0")
    index = vec.hyperplane_tables(e, "vec_id", 64)
    found, stage = vec.approximate_knn(index, e, q.select("vec_id"), "vec_id", 10), shared(spark, "approximate")
    found.write.parquet(stage)
    near = spark.read.schema(found.schema).parquet(stage)
    exact = vec.nearest(e, q.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), "vec_id", 10, stage=shared(spark, "nearest")).select("query", "vec_id")
    return exact.join(near.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left").groupBy("query").agg(F.round(F.count("hit") / F.count(F.lit(1)), 3).alias("recall"))
