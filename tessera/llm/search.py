"""Ranked lexical search over dual-sorted wavelet trees.

A shard holds the documents of a stretch of a partition, so building it shuffles nothing.  Its postings, term by term
and within a term by falling impact, are one sequence of document ordinals, kept as a wavelet tree over the ordinals, level by
level: a bit tells which half of a node's documents a posting goes to, and each half keeps the order.  So a term is an
interval of every node, and the first posting of that interval has the term's highest impact among the node's documents:
the same sequence is sorted by impact and can be walked by document.

A search starts with the root and always opens the nodes of the highest bounds, a beam of them at a time.  A node's bound is
the sum of its terms' weights times their leading impacts; at a leaf it is the document's exact score.  Nodes
that cannot reach the k-th best score found so far, in this shard or in earlier ones of the task, are left closed; so the
k best are exact.  Each task hands on k documents an item at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.decontamination import _KEEP as KEEP

SHARD_POSTINGS = 1_000_000  # about 130 MB in a Python worker while it is searched
SLICE_BYTES = 4 << 20
QUERY_TERMS = 1_000_000  # terms of all items of a slice, which is broadcast: some 100 MB
BEAM = 256
ROW_GROUP = 16 << 20
INDEX = "corpus_docs long, doc_ids array<bigint>, terms array<string>, df array<int>, impacts binary, bits binary"
FOUND = "item_id long, doc_id long, score long"
_TABLE = np.frombuffer(KEEP, np.uint8)


# -- words ---------------------------------------------------------------------------------------


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, A-Z lower-cased and separators as blanks; where each text starts, and the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return _TABLE[raw], offsets - offsets[0]


def term_counts(texts: pa.Array) -> np.ndarray:
    """Number of terms of each text, with repeats."""
    raw, at = _raw(texts)
    inside = raw != 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = at[:-1][np.diff(at) > 0]
    starts[first] = inside[first]  # whatever the text before ends with
    total = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(starts, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all terms in a row, number of each text's)."""
    raw, at = _raw(texts)
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
    lists = pc.ascii_split_whitespace(clean)
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), np.diff(upto[ends])


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of texts of bounded size; a longer text is one of its own."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield at, to
        at = to


def impact(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), where m = 50 + (50 n docs) div words."""
    m = np.array([50 + 50 * x * docs // words for x in n.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


# -- shards --------------------------------------------------------------------------------------


class Builder:
    """Collects postings of whole documents until a shard is full."""

    def __init__(self, docs: int, words: int):
        self.docs, self.words = docs, words
        self.clear()

    def clear(self) -> None:
        self.ids, self.parts, self.size, self.n_docs = [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        """The documents that have terms, of a slice of a batch."""
        flat, n = terms_of(texts)
        has = n > 0
        if not has.any():
            return
        coded = flat.dictionary_encode()
        doc = np.repeat(np.arange(int(has.sum())), n[has])
        pair, tf = np.unique(doc * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
        doc, term = np.divmod(pair, len(coded.dictionary))
        self.ids.append(ids.filter(pa.array(has)))
        self.parts.append((coded.dictionary, term, doc + self.n_docs, impact(tf, n[has][doc], self.docs, self.words)))
        self.n_docs += int(has.sum())
        self.size += len(pair)

    def row(self) -> pa.RecordBatch:
        """The shard as a row of the index; ordinals ascend with the document id (nulls last), terms are sorted."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        ordinal = np.empty(len(order), np.int64)
        ordinal[order] = np.arange(len(order))
        coded = pa.concat_arrays([d for d, *_ in self.parts]).dictionary_encode()
        names = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(names), np.int64)
        place[names] = np.arange(len(names))
        code, at = place[coded.indices.to_numpy()], 0
        term = []
        for words, t, *_ in self.parts:
            term.append(code[at : at + len(words)][t])
            at += len(words)
        term, doc, imp = np.concatenate(term), ordinal[np.concatenate([p[2] for p in self.parts])], np.concatenate([p[3] for p in self.parts])
        by = np.lexsort((doc, -imp, term))
        values = [self.docs, ids.take(pa.array(order)).to_pylist(), coded.dictionary.take(pa.array(names)).to_pylist(), np.bincount(term).tolist(), imp[by].astype("<i4").tobytes(), levels(doc[by], height(len(ids)))]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["corpus_docs", "doc_ids", "terms", "df", "impacts", "bits"])
        self.clear()
        return out


def height(docs: int) -> int:
    return max(1, (docs - 1).bit_length())


def levels(docs: np.ndarray, tall: int) -> bytes:
    """The bits of all levels, each padded to whole bytes; the ones of a level go behind its zeros."""
    out = []
    for level in range(tall):
        bit = (docs >> (tall - 1 - level)) & 1 == 1
        out.append(np.packbits(bit).tobytes())
        docs = np.concatenate([docs[~bit], docs[bit]])
    return b"".join(out)


class Shard:
    """A row of the index, ready to be searched: ones before each place of a level, and impacts in each level's order."""

    def __init__(self, doc_ids: pa.Array, terms: pa.Array, df: np.ndarray, impacts, bits):
        self.doc_ids, self.terms = doc_ids, terms
        self.starts = np.concatenate([[0], np.cumsum(df, dtype=np.int64)])
        self.size, self.tall = int(self.starts[-1]), height(len(doc_ids))
        a, wide = np.frombuffer(impacts, "<i4"), -(-self.size // 8)
        self.impacts, self.ones = np.empty((self.tall + 1, self.size), np.int32), np.zeros((self.tall, self.size + 1), np.int32)
        self.zeros = np.empty(self.tall, np.int64)
        for level in range(self.tall):
            self.impacts[level] = a
            bit = np.unpackbits(np.frombuffer(bits, np.uint8, wide, level * wide), count=self.size).astype(bool)
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = self.size - self.ones[level, -1]
            a = np.concatenate([a[~bit], a[bit]])
        self.impacts[self.tall] = a
        self.impacts, self.ones = self.impacts.reshape(-1), self.ones.reshape(-1)

    def places(self, terms: pa.Array) -> np.ndarray:
        """Where each term stands in this shard; -1 if it does not occur."""
        return pc.fill_null(pc.index_in(terms, self.terms), -1).to_numpy()

    def best(self, places: np.ndarray, weights: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ordinals, scores) of the k best documents of score `floor` and above 0; equal scores by ascending ordinal."""
        low, high, term = self.starts[places], self.starts[places + 1], np.arange(len(places))
        owner = np.zeros(len(places), np.int64)
        bound = np.array([float(weights @ self.impacts[low])])
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        docs, scores, need, last = np.zeros(0, np.int64), np.zeros(0), float(max(1, floor)), -1
        while True:
            first = prefix << (self.tall - level)
            keep = (bound > need) | ((bound == need) & ((last < 0) | (first < last)))
            if not keep.all():
                held = keep[owner]
                owner, term, low, high = (np.cumsum(keep) - 1)[owner[held]], term[held], low[held], high[held]
                bound, level, prefix = bound[keep], level[keep], prefix[keep]
            if not len(bound):
                return docs, scores.astype(np.int64)
            opened = np.ones(len(bound), bool)
            if len(bound) > BEAM:
                opened[:] = False
                opened[np.argpartition(bound, -BEAM)[-BEAM:]] = True
            mine = opened[owner]
            parent, t, a, b = (np.cumsum(opened) - 1)[owner[mine]], term[mine], low[mine], high[mine]
            at = level[opened]
            deep = at[parent]
            one_a, one_b = self.ones[deep * (self.size + 1) + a], self.ones[deep * (self.size + 1) + b]
            behind = self.zeros[deep]
            child = np.concatenate([2 * parent, 2 * parent + 1])
            a, b = np.concatenate([a - one_a, behind + one_a]), np.concatenate([b - one_b, behind + one_b])
            some = a < b
            child, t, a, b = child[some], np.concatenate([t, t])[some], a[some], b[some]
            deep = np.repeat(at + 1, 2)
            reach = np.bincount(child, weights[t] * self.impacts[deep[child] * self.size + a], len(deep))  # whole numbers below 2^53
            under = np.repeat(2 * prefix[opened], 2)
            under[1::2] += 1
            leaf = (deep == self.tall) & (reach >= need)
            if leaf.any():
                docs, scores = np.concatenate([docs, under[leaf]]), np.concatenate([scores, reach[leaf]])
                top = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[top], scores[top]
                if len(docs) == k:
                    need, last = max(need, scores[-1]), docs[-1]
            node = (deep < self.tall) & (reach >= need)
            held, rest = node[child], ~mine
            shut = int((~opened).sum())
            owner = np.concatenate([(np.cumsum(~opened) - 1)[owner[rest]], shut + (np.cumsum(node) - 1)[child[held]]])
            term, low, high = np.concatenate([term[rest], t[held]]), np.concatenate([low[rest], a[held]]), np.concatenate([high[rest], b[held]])
            bound, level, prefix = np.concatenate([bound[~opened], reach[node]]), np.concatenate([level[~opened], deep[node]]), np.concatenate([prefix[~opened], under[node]])


# -- Spark ---------------------------------------------------------------------------------------


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with at least one term, terms of all with repeats)."""

    def run(batches):
        for batch in batches:
            for at, to in text_slices(batch.column(0)):
                n = term_counts(batch.column(0).slice(at, to - at))
                yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "words"])

    got = docs.select(F.coalesce(common.quoted(text_col), F.lit("")).cast("string").alias("text")).mapInArrow(run, "docs long, words long")
    row = got.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    return row["docs"] or 0, row["words"] or 0


def write_index(docs: DataFrame, path: str, shard_postings: int = SHARD_POSTINGS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of all documents to `path`: a Parquet table with one row a shard.

    Null texts and texts without a term are in no shard.  Rows without an id and repeated rows are documents of
    their own.  A document is never split: the longest texts must fit a task.  An empty table gives an empty index.
    Other columns are ignored.  Statistics are counted in a first pass over all documents.
    """
    n_docs, n_words = corpus_size(docs, text_col)

    def run(batches):
        shard = Builder(n_docs, n_words)
        for batch in batches:
            ids, texts = batch.columns
            for at, to in text_slices(texts):
                shard.add(ids.slice(at, to - at), texts.slice(at, to - at))
                if shard.size >= shard_postings:
                    yield shard.row()
        if shard.size:
            yield shard.row()

    rows = common.text_rows(docs, id_col, text_col, "string").mapInArrow(run, INDEX)
    rows.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("parquet.page.size.row.check.min", 4).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each pair once; items without an id and texts without terms give none."""

    def run(batches):
        for batch in batches:
            flat, n = terms_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), flat], names=["item_id", "term"])

    rows = items.select(common.quoted(item_col).cast("long").alias("item_id"), F.coalesce(common.quoted(text_col), F.lit("")).cast("string").alias("text"))
    return rows.where("item_id IS NOT NULL").mapInArrow(run, "item_id long, term string").distinct()


def _slices(weighted: DataFrame, query_terms: int) -> Iterator[list]:
    """Bounded lists of (item_id, [(term, df), ...]); one slice is on the driver at a time, an item is never split."""
    held, size = [], 0
    for r in weighted.toLocalIterator():
        if held and size + len(r["terms"]) > query_terms:
            yield held
            held, size = [], 0
        held.append((r["item_id"], [(t["term"], t["df"]) for t in r["terms"]]))
        size += len(r["terms"])
    if held:
        yield held


class Queries:
    """A slice of items: distinct terms, and for each item their places in that list and their weights."""

    def __init__(self, items: list, docs: int):
        self.terms: dict[str, int] = {}
        self.items = []
        for item, terms in items:
            rated = [(self.terms.setdefault(t, len(self.terms)), w) for t, df in terms if (w := weight(df, docs)) > 0]
            if rated:
                at, w = zip(*rated, strict=True)
                self.items.append((item, np.array(at), np.array(w, np.float64)))


def _searcher(queries_cast, k: int):
    def run(batches):
        queries = queries_cast.value
        terms = pa.array(list(queries.terms), pa.string())
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by item: ids, which are null, scores; k each
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, names, df, impacts, bits = (c[i] for c in batch.columns)
                shard = Shard(ids.values, names.values, df.values.to_numpy(), impacts.as_buffer(), bits.as_buffer())
                null, ids = ids.values.is_null().to_numpy(zero_copy_only=False), ids.values.fill_null(0).to_numpy()
                del names, df, impacts, bits
                places = shard.places(terms)
                for item, at, weights in queries.items:
                    here = places[at] >= 0
                    if not here.any():
                        continue
                    old = best.get(item)
                    docs, scores = shard.best(places[at[here]], weights[here], k, int(old[2][-1]) if old and len(old[2]) == k else 0)
                    if len(docs):
                        new = ids[docs], null[docs], scores
                        both = new if old is None else tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                        top = np.lexsort((both[0], both[1], -both[2]))[:k]
                        best[item] = tuple(x[top] for x in both)
                del shard  # before the next one is read
        for item, (ids, null, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=null), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 50, query_terms: int = QUERY_TERMS, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of score above 0, exactly.

    Equal scores rank by ascending doc_id, those without an id last.  Rows of one item_id are one item.  Items without
    an id or without a term in the index have no rows.  Documents that repeat rank each.  Items are broadcast in slices of
    at most query_terms terms (an item of more is a slice of its own), each searched over the whole index.
    """
    spark, asked = items.sparkSession, item_terms(items, item_col, text_col)
    asked, path = common.stage(asked, "search-items")
    try:
        docs = index.agg(F.max("corpus_docs").alias("n")).first()["n"] or 0
        held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.df").cast("long").alias("df"))
        counts = held.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
        weighted = asked.join(counts, "term").groupBy("item_id").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
        found = None
        for part in _slices(weighted, query_terms):
            rows = index.mapInArrow(_searcher(spark.sparkContext.broadcast(Queries(part, docs)), k), FOUND)
            found = rows if found is None else found.unionByName(rows)
    finally:
        common.drop(spark, path)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "search-index")
    write_index(common.read(spark, sf_dir, "documents"), path)
    return search(read_index(spark, path), common.read(spark, sf_dir, "benchmark"))


ORACLE_OP13 = r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS n_all, sum(n)::BIGINT AS l_all FROM docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
scores AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all))))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN weights USING (term), total GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
