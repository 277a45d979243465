"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every bit position gets a non-zero vector of r + 1 bits; for each of the 2^(r+1) - 1
non-zero vectors v a table keys fingerprints by the positions whose vector has an odd product with v.
At most r differing positions give r equations in r + 1 unknowns, so some v ignores all of them:
every pair within the radius meets in some table, none is missed.

Work is on distinct fingerprints.  A fingerprint that shares a bucket may be near another one of it only
in bits that bucket's mask ignores.  Flipping each of these once gives at most 65 points a fingerprint;
two fingerprints lie within 2 bits if and only if they share a point, and each is linked to the
smallest one at its point.  That is linear in the fingerprints whatever a bucket's size, no pairs are
made, and no point is shared by more than 65 fingerprints.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.graph import components

SEED = 42
RADIUS = 2
BLOCK = 1 << 16  # shingles hashed at a time


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash over the word shingles of a text, A-Z lower-cased; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words) - width + 1
    if n < 2:
        return xxh64_intdigest(b" ".join(words), seed) if words else 0
    votes = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        columns = [words[at + j : at + j + m] for j in range(width)]
        h = np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*columns)), repeat(seed)), ">u8", m)
        votes += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs.  Null text: 0.  Other columns are ignored."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return common.text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def table_keys(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(t, key, fp): every fingerprint once in every table."""
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = F.explode(F.array(*(F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks))))
    return distinct.select("fp", tables.alias("x")).select("x.t", "x.key", "fp")


def loose_bits(keys: DataFrame, shared: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, loose): bits that some shared bucket of a fingerprint ignores.

    `shared` (t, key) comes from storage, so that Spark may split a bucket that many fingerprints share.
    """
    ignored = F.element_at(F.lit([_signed(m ^ (1 << 64) - 1) for m in covering_masks(radius)]), F.col("t").cast("int") + 1)
    return keys.join(shared, ["t", "key"]).groupBy("fp").agg(F.bit_or(ignored).alias("loose"))


def near_edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges with the same components as all pairs of `fp` within the radius (1 or 2)."""
    if radius not in (1, 2):
        raise ValueError("the radius must be 1 or 2")
    keys = table_keys(distinct, radius)
    shared = common.cut(keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key"))
    met = common.cut(loose_bits(keys, shared, radius))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("loose").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    flips = F.transform(bits, lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    points = met.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    if radius == 1:  # a neighbour is itself a point
        return points.where("fp > point").join(met.select(F.col("fp").alias("point")), "point").select(F.col("fp").alias("a"), F.col("point").alias("b"))
    heads = points.groupBy("point").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return points.join(heads, "point").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct()


def to_group(labelled: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of a root with its name; `named` comes from storage, so that Spark may split a large component."""
    return labelled.join(named, "root")


def groups(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of (doc_id, fp).

    root is the smallest fingerprint (as a signed number) of the component, component_id its smallest doc_id.
    """
    distinct = common.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = common.cut(components(near_edges(distinct, radius)).withColumnRenamed("node", "fp"))
    labelled = common.cut(distinct.join(parts, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    named = common.cut(labelled.groupBy("root").agg(F.min("least").alias("component_id")))
    return common.cut(to_group(labelled, named).select("fp", "root", "component_id"))


def to_documents(fps: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of (.., fp) with root and component_id; both sides are stored, so Spark may split a fingerprint of many copies."""
    return fps.join(found, "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = 3, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of `radius` bits or fewer.

    Texts without words (null, empty, blank) share fingerprint 0.  Exact copies share a fingerprint and
    so a component.  Rows without an id get a component but never name one (null if none can).
    Repeated rows come back each; an empty table gives no rows; other columns are ignored.
    """
    fps = common.cut(fingerprints(docs, width, seed, id_col, text_col))
    return to_documents(fps, groups(fps, radius)).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, then of the smallest SHA-256 of its text.

    Columns of any type and name stay as they are.  Unlike texts under one id are documents of their own.
    Of rows that repeat both id and text any one stays.  Rows without an id cannot be told apart by
    one and all stay.  An empty table gives no rows.  Whole texts are shuffled once at most.
    """
    key, text = common.quoted(id_col), common.quoted(text_col)
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    same = [common.fresh(docs, "doc_id_of_text"), common.fresh(docs, "digest_of_text")]
    wide = docs.withColumns({same[0]: key.cast("long"), same[1]: digest})

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "digest"])

    rows = wide.select(F.col(same[0]).alias("doc_id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"), F.col(same[1]).alias("digest")).where("doc_id IS NOT NULL")
    rows = common.cut(rows.mapInArrow(run, "doc_id long, fp long, digest string"))
    each = to_documents(rows, groups(rows, radius)).groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = each.groupBy("root").agg(F.min(F.struct("doc_id", "digest", "n")).alias("f"))
    first, _ = common.stage(first.select("f.doc_id", "f.digest", "f.n"), "first-of-group")
    own = common.own_columns(docs)
    only = lambda rule: wide.join(first.where(rule).select(F.col("doc_id").alias(same[0]), F.col("digest").alias(same[1])), same, "left_semi").select(*common.own_columns(wide))
    out = only("n = 1").select(*own).unionByName(docs.where(key.isNull()))
    if first.where("n > 1").isEmpty():
        return out
    again = common.cut(only("n > 1"))  # stored, so that copies are dropped before the shuffle
    return out.unionByName(again.dropDuplicates(same).select(*own))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
