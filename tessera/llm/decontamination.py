"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Training texts are scanned in place: words become small integers through the benchmark's own
vocabulary (0: a word the benchmark never uses, so no window holds it), rolling hashes of the runs of
known words are looked up in the hash set, and each hit is verified against the n-gram's words.
The broadcast is bounded: a benchmark of more than `max_ngrams` windows is split by item into slices
of bounded size, each scanned in turn; only places and items of hits are carried from slice to slice.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

MAX_NGRAMS = 1_000_000  # a slice: at most about 200 MB in a Python worker
_KEEP = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" or c > 127 else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return text.translate(_KEEP).split()


class Grams:
    """The hash set: vocabulary, and for each window length the sorted hashes and exact windows."""

    def __init__(self, items: list[tuple[int | None, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, list[int | None]]] = {}
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not words:
                continue
            size, a = min(n, len(words)), np.array(words, np.uint32)
            for i in range(len(words) - size + 1):
                owners = self.windows.setdefault(size, {}).setdefault(a[i : i + size].tobytes(), [])
                if not owners or owners[-1] != item:  # items come one by one; an id that comes again is listed again
                    owners.append(item)
        self.hashes = {size: np.unique(self.rolling(np.frombuffer(b"".join(w), np.uint32).reshape(-1, size).T)) for size, w in self.windows.items()}

    @staticmethod
    def rolling(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out + c) * _MULTIPLIER
            out ^= out >> np.uint64(29)
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """(which words are hit, items that occur); None if none are."""
        get = self.vocabulary.get
        a = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
        edge = np.flatnonzero(np.diff(a != 0, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        hit, items = None, set()
        for size, windows in self.windows.items():
            for s, e in zip(starts[ends - starts >= size].tolist(), ends[ends - starts >= size].tolist(), strict=True):
                run = a[s:e]
                h = self.rolling([run[j : e - s - size + 1 + j] for j in range(size)])
                known = self.hashes[size]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for i in np.flatnonzero(known[at] == h).tolist():
                    owners = windows.get(run[i : i + size].tobytes())
                    if owners is not None:
                        if hit is None:
                            hit = np.zeros(len(words), bool)
                        hit[s + i : s + i + size] = True
                        items.update(owners)
        return hit, items


def _slices(benchmark: DataFrame, n: int, max_ngrams: int, item_col: str, text_col: str):
    """Yield bounded lists of (item_id, text); only one slice is on the driver at a time."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("text")).where(F.col("text").isNotNull())
    held, size = [], 0
    for r in rows.toLocalIterator():
        words = words_of(bytes(r["text"]))
        for at in range(0, max(1, len(words) - n + 1), max_ngrams):  # a huge item is cut so that each window stays in one part
            part = b" ".join(words[at : at + max_ngrams + n - 1])
            if size and size + len(words) > max_ngrams:
                yield held
                held, size = [], 0
            held.append((r["item"], part))
            size += min(len(words), max_ngrams)
    if held:
        yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_ngrams: int = MAX_NGRAMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, spans, items): hit word spans [start, end), ascending and merged, and the items that occur.

    A window is n consecutive words of an item, or a whole shorter item.  Null texts have no words.
    An item without an id is searched for but not listed.  Repeated documents and items: each on its own.
    An empty benchmark hits nothing.  Other columns are ignored.
    """
    rows, name = common.text_rows(docs, id_col, text_col), "found"
    found = _scan(rows, name, "text", benchmark, n, max_ngrams, item_col)
    return found.select("doc_id", *(F.col(name)[c].alias(c) for c in ("n_words", "spans", "items")))


FOUND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<bigint>>"


def _scan(rows: DataFrame, name: str, text_col: str, benchmark: DataFrame, n: int, max_ngrams: int, item_col: str = "item_id") -> DataFrame:
    """rows with a column `name` of FOUND.  Only texts go to Python, so other columns may be of any name and type.

    One slice: a column of one narrow pass, nothing is joined or shuffled.  More: rows are numbered and stored once,
    each slice's hits are written as places, and all hits of a row are joined to it.
    """
    spark, text = rows.sparkSession, common.quoted(text_col)
    slices = _slices(benchmark, n, max_ngrams, item_col, "text")
    items, more = next(slices, []), next(slices, None)
    if more is None:
        return common.with_columns(rows, **{name: _scanner(spark.sparkContext.broadcast(Grams(items, n)))(text)})
    number, found = common.fresh(rows, "row"), common.fresh(rows, "hits")
    numbered, places = common.cut(rows.withColumn(number, F.monotonically_increasing_id())), []
    for part in itertools.chain([items, more], slices):
        grams = spark.sparkContext.broadcast(Grams(part, n))
        hits = numbered.select(F.col(number).alias("row"), _scanner(grams)(text).alias("f")).where("size(f.spans) > 0").select("row", "f.spans", "f.items")
        places.append(common.stage(hits, "benchmark-hits"))
        grams.destroy()
    hits = reduce(DataFrame.unionByName, (p for p, _ in places)).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = hits.select("row", F.struct(_merged(F.array_sort("spans")).alias("spans"), "items").alias(found))
    words = _scanner(spark.sparkContext.broadcast(Grams([], n)))(text)["n_words"]
    none = F.from_json(F.lit('{"spans":[],"items":[]}'), "struct<spans:array<struct<start:int,end:int>>,items:array<bigint>>")
    held = numbered.join(hits.withColumnRenamed("row", number), number, "left")
    got = F.coalesce(F.col(found), none)
    return common.with_columns(held, **{name: F.struct(words.alias("n_words"), got["spans"].alias("spans"), got["items"].alias("items"))}).select(*common.own_columns(rows), *([common.quoted(name)] if name not in rows.columns else []))


def _merged(spans: F.Column) -> F.Column:
    """Ascending spans, those that meet or overlap as one."""
    put = lambda a, s: F.array_append(a, F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def step(a, s):
        top = F.element_at(a, -1)
        wide = F.struct(top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end"))
        return F.when(F.size(a) == 0, put(a, s)).when(top["end"] >= s["start"], F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), wide)).otherwise(put(a, s))

    return F.aggregate(spans, F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>"), step)


def _scanner(grams_cast):
    kinds = {"n_words": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "items": pa.list_(pa.int64())}

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        grams, out = grams_cast.value, {k: [] for k in kinds}
        for text in texts.to_pylist():
            words = words_of(text.encode() if isinstance(text, str) else text or b"")
            hit, found = grams.scan(words)
            edge = [] if hit is None else np.flatnonzero(np.diff(hit, prepend=False, append=False)).tolist()
            out["n_words"].append(len(words))
            out["spans"].append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)])
            out["items"].append(sorted(i for i in found if i is not None))
        return pa.StructArray.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    return scan


def n_hit(spans: str | F.Column = "spans") -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(spans: str | F.Column = "spans", n_words: str | F.Column = "n_words") -> F.Column:
    """The rule of the contract: something is hit, and hits are a twentieth of the words or more."""
    n = n_hit(spans)
    return (n > 0) & (20 * n >= (F.col(n_words) if isinstance(n_words, str) else n_words))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_ngrams: int = MAX_NGRAMS, text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones, with their own columns, of any name and type; each row is judged by its own text."""
    name = common.fresh(docs, "found")
    found = F.col(name)
    return _scan(docs, name, text_col, benchmark, n, max_ngrams).where(~contaminated(found["spans"], found["n_words"])).select(*common.own_columns(docs))


def remove_passages(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_ngrams: int = MAX_NGRAMS, text_col: str = "text") -> DataFrame:
    """docs with the benchmark windows cut out of their texts; all rows and other columns, of any name and type, stay.

    Null texts stay null; texts without a hit stay as they are; an empty benchmark removes nothing.
    """

    @F.arrow_udf("string")
    def cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([remove_spans(t.encode(), [(s["start"], s["end"]) for s in spans]).decode() if spans else t for t, spans in rows], pa.string())

    name, text = common.fresh(docs, "found"), common.quoted(text_col).cast("string")
    found = _scan(docs, name, text_col, benchmark, n, max_ngrams)
    return common.with_columns(found, **{text_col: cut_out(text, F.col(name)["spans"])}).select(*common.own_columns(docs))


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (and without the punctuation right behind each)."""
    clean, at, ends = text.translate(_KEEP), 0, []
    for w in words_of(text):
        s = clean.index(w, at)
        at = s + len(w)
        ends.append((s, at))
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : ends[s][0]])
        last = ends[e][0] if e < len(ends) else len(text)
    return b"".join([*out, text[last:]])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE_OP10 = """
WITH dw AS (SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
          FROM bw, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM grams),
hits AS (SELECT dw.r, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM dw, sizes, unnest(range(1, len(w) - size + 2)) AS u(i)),
found AS (SELECT h.r, h.i, h.size, g.item_id FROM hits h JOIN grams g USING (size, g)),
spots AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, size)) AS u(j) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN spots USING (r) LEFT JOIN items USING (r)
"""
