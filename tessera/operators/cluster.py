"""Clusters of vectors: projection, levels of granularity, centroids, parents, representatives, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.aggregates import plurality
from tessera.functions.text import fold
from tessera.operators.relational import small, top_m_per_group
from tessera.operators.vector import euclidean


VOCABULARY = 200_000  # terms that are broadcast


def centroids(df: DataFrame, cluster: str, dims: int, vector: str = "embedding") -> DataFrame:
    """(cluster, centroid, members): means by dimension, pre-aggregated, no vectors gathered."""
    means = F.array(*(F.avg(F.col(vector)[i].cast("double")) for i in range(dims)))
    return df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(means.alias("centroid"), F.count(F.lit(1)).alias("members"))


def representatives(df: DataFrame, centers: DataFrame, cluster: str, id_col: str, m: int = 15, vector: str = "embedding") -> DataFrame:
    """The m members nearest to each centroid, ties by id."""
    near = df.join(small(centers.select(cluster, "centroid")), cluster).withColumn("distance", euclidean(vector, "centroid"))
    return top_m_per_group(near, [cluster], [F.asc(F.round("distance", 9)), F.asc(id_col)], m)


def assign(df: DataFrame, centers: DataFrame, cluster: str, id_col: str, vector: str = "embedding") -> DataFrame:
    """(id, cluster): nearest of a short list of centroids, ties to the smaller cluster."""
    c = centers.select(F.collect_list(F.struct(F.col(cluster).alias("c"), "centroid")).alias("_centers"))
    best = F.array_min(F.transform("_centers", lambda x: F.struct(F.round(euclidean(F.col(vector), x["centroid"]), 9).alias("d"), x["c"].alias("c"))))
    return df.crossJoin(small(c)).select(id_col, best["c"].alias(cluster))


def parents(df: DataFrame, child: str, parent: str, noise: int = -1) -> DataFrame:
    """(child, parent): each child's parent by majority of members, the smaller on a tie; noise has none."""
    return plurality(df.where((F.col(child) != noise) & (F.col(parent) != noise)), [child], parent).select(child, parent)


def project(df: DataFrame, id_col: str, k: int, sample: int = 50_000, seed: int = 0, vector: str = "embedding") -> DataFrame:
    """(id, x0 .. xk-1): principal components, fitted on at most `sample` rows picked by hash of id."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    wide = df.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(wide.orderBy(F.xxhash64(id_col, F.lit(seed))).limit(sample))
    return model.transform(wide).select(id_col, vector_to_array("p").alias("p")).select(id_col, *(F.col("p")[i].alias(f"x{i}") for i in range(k)))


def cluster_levels(df: DataFrame, id_col: str, sizes: Mapping[str, int], sample: int = 50_000, seed: int = 1, vector: str = "embedding") -> DataFrame:
    """(id, level columns): bisecting k-means at several granularities, fitted on a bounded sample, applied to all rows."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    out = df.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    part = out.orderBy(F.xxhash64(id_col, F.lit(seed))).limit(sample).cache()
    for level, k in sizes.items():
        out = BisectingKMeans(k=k, seed=seed, featuresCol="v", predictionCol=level).fit(part).transform(out)
    part.unpersist()
    return out.select(id_col, *sizes)


def tfidf_terms(tokens: DataFrame, group: str, doc: str, term: str, top: int = 20, min_df: int = 2, max_df: float = 0.6) -> DataFrame:
    """(group, term, weight, place): mean of each document's unit-length tf x smooth idf, best terms of each group.

    tokens: one row for each occurrence; a document belongs to one group.
    """
    tf = tokens.groupBy(group, doc, term).agg(F.count(F.lit(1)).alias("tf"))
    size = tokens.groupBy(group).agg(F.count_distinct(doc).alias("docs"))
    n = size.agg(F.sum("docs").alias("n"))
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))).select(term, (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, term).select(group, doc, term, (F.col("tf") * F.col("idf")).alias("w"))
    unit = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc))))
    mean = unit.groupBy(group, term).agg(F.sum("w").alias("s")).join(size, group).select(group, term, (F.col("s") / F.col("docs")).alias("weight"))
    order = Window.partitionBy(group).orderBy(F.desc(F.round("weight", 9)), F.asc(term))
    return mean.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def phrases(text: Column, stops: Sequence[str]) -> Column:
    """Words of three letters or more of the folded text, without the stop words, and each two of them in a row."""
    # whole words that are of these letters alone, found by one expression a text
    words = F.filter(F.regexp_extract_all(fold(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{3,}+(?![\p{L}\p{N}_])"), F.lit(0)), lambda w: ~w.isin(*stops))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.element_at(F.transform(F.array(words), lambda w: F.concat(w, pairs(w))), 1)


def cluster_terms(docs: DataFrame, group: str, doc: str, text: str, stops: Sequence[str], top: int = 20, min_df: int = 2, max_df: float = 0.6, features: int = 5000) -> DataFrame:
    """(group, term, weight, place): the words and pairs of words that stand out in each cluster, weighed within it.

    A cluster's vocabulary is its `features` most frequent terms (ties by term) that `min_df` of its documents or more
    and no greater share than `max_df` hold.  The weight is the mean, over all its documents, of unit-length tf x
    smooth idf.  Clusters without such terms give no rows.  docs: one row a document.
    """
    size = docs.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    few = len(size.take(VOCABULARY // features + 1)) * features <= VOCABULARY  # clusters, whose vocabularies are then broadcast
    terms = docs.select(group, doc, phrases(F.col(text), stops).alias("_t"))
    # a document is one row, so the documents of a term are counted without gathering a document's terms
    each = F.concat(F.transform("_t", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("tf"))), F.transform(F.array_distinct("_t"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("tf"))))
    counts = terms.select(group, F.inline(each)).groupBy(group, "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total"))
    known = counts.join(F.broadcast(size) if few else size, group).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    kept = known.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("total"), F.asc("term")))).where(F.col("_r") <= features)
    idf = kept.select(group, "term", "_r", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    # only words of the vocabularies leave their task, once: by number, to their document
    met = terms.select(group, doc, F.explode("_t").alias("term")).join(F.broadcast(idf) if few else idf, [group, "term"]).select(group, doc, "_r", "idf").repartition(group, doc)
    w = met.groupBy(group, doc, "_r").agg((F.count(F.lit(1)) * F.first("idf")).alias("w"))
    unit = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group, doc))))
    mean = unit.groupBy(group, "_r").agg(F.sum("w").alias("s")).join(kept.select(group, "_r", "term", "n"), [group, "_r"]).select(group, "term", (F.col("s") / F.col("n")).alias("weight"))
    order = Window.partitionBy(group).orderBy(F.desc(F.round("weight", 9)), F.asc("term"))
    return mean.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def labels(terms: DataFrame, group: str, term: str, words: int = 3) -> DataFrame:
    """(group, label): the best terms joined."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", term))), lambda x: x[term])
    return terms.where(F.col("place") <= words).groupBy(group).agg(F.array_join(parts, ", ").alias("label"))


def stratified_sample(df: DataFrame, strata: Sequence[str], id_col: str, target: int, must: DataFrame | None = None, seed: int = 3) -> DataFrame:
    """About `target` rows in proportion to the strata, rounding repaired in the largest, rows of `must` included."""
    n = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_total"))
    quota = n.crossJoin(F.broadcast(total)).withColumn("_q", F.round(F.lit(target) * F.col("_n") / F.col("_total")).cast("long"))
    spare = quota.agg((F.lit(target) - F.sum("_q")).alias("_spare"), F.max(F.struct("_n", *(F.col(s) for s in strata))).alias("_largest"))
    fixed = quota.crossJoin(F.broadcast(spare)).withColumn("_q", F.col("_q") + F.when(F.struct("_n", *(F.col(s) for s in strata)) == F.col("_largest"), F.col("_spare")).otherwise(0))
    keys = [df[s].eqNullSafe(fixed[s]) for s in strata]
    joined = df.join(small(fixed.select(*strata, "_q")), keys)
    for s in strata:
        joined = joined.drop(fixed[s])
    first = F.lit(0)
    if must is not None:
        joined = joined.join(must.select(id_col, F.lit(True).alias("_must")), id_col, "left")
        first = F.when(F.col("_must"), 0).otherwise(1)
    w = Window.partitionBy(*strata).orderBy(first, F.xxhash64(F.col(id_col), F.lit(seed)), id_col)
    keep = F.col("_r") <= F.col("_q")
    if must is not None:
        keep = keep | F.coalesce("_must", F.lit(False))
    return joined.withColumn("_r", F.row_number().over(w)).where(keep).select(*df.columns)
