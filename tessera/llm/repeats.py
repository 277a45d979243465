"""Substring dedup over the de Bruijn graph of word windows.

Every window of `width` words is an edge between the grams of width - 1 words it begins and ends with.
Edges are dealt by minimiser: the smallest hash among the grams of `gram` words inside a window.  Equal windows
have equal minimisers, and consecutive windows of a text mostly share one, so a stretch of edges travels as
one row: about one row for fifteen words.  Then, all through Spark joins:

* Candidates.  A minimiser met once holds no repeated edge.  Stretches of one minimiser that all read alike, by a
  short digest, repeat whole; where they differ, those met twice repeat whole and one row of each distinct
  stretch is expanded into edges, which are counted one by one by half the SHA-256 of their words.
* Compaction.  Stretches that repeat whole and follow each other in a text meet at a node.  Its degrees are the numbers of
  distinct stretches that come in and go out anywhere, the ends of repeats included; at a nonbranching node (one in,
  one out) they are joined, so that a long repeated span becomes one path, once in each text.
* Verification.  The words of every path are read at its source coordinates and compared, word for word, with
  those at all other places of the path: they agree if their least and greatest are equal.  Paths that lie in one
  text only, which has copies, need no comparison.  Where words differ behind equal digests, all edges of the
  minimisers concerned are compared by their words instead.

So no short digest or rolling hash decides anything by itself, and no pairs of occurrences are ever made.  Whole
texts and lone edges are told apart by 128 bits of a cryptographic digest.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

WIDTH = 35
GRAM = 8
_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base modulo 2^64, and of its inverse; kept at the longest text's length."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        steps = [np.full(size, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        _powers = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def rolling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers): the hash of words i..j is (sums[j] - sums[i]) * inverse[i]."""
    from xxhash import xxh3_64_intdigest

    n = len(words)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n) * up[:n], out=sums[1:])
    return sums, down


def sliding_min(a: np.ndarray, span: int) -> np.ndarray:
    size = 1
    while size * 2 <= span:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (span - size)], a[span - size :]) if size < span else a


def stretches(words: list[bytes], width: int, gram: int):
    """(minimisers, first windows, numbers of windows, windows repeated inside the text)."""
    sums, down = rolling(words)
    n = len(words) - width + 1
    grams = _mix((sums[gram:] - sums[:-gram]) * down[: len(words) - gram + 1])
    least = sliding_min(grams, width - gram + 1)
    edge = np.flatnonzero(np.diff(least)) + 1
    lo = np.concatenate([[0], edge])
    windows = (sums[width:] - sums[:-width]) * down[:n]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    own = np.zeros(n, bool)
    for i, j in zip(order[:-1][same].tolist(), order[1:][same].tolist(), strict=True) if same.any() else ():
        if words[i : i + width] == words[j : j + width]:
            own[i] = own[j] = True
    return least[lo], lo, np.diff(np.append(lo, n)), own


def digest64(words: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(words)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of True."""
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    return edge[::2], edge[1::2] - edge[::2]


STRETCH = "tid binary, anchor long, digest long, lo int, n int, m int"


def _emit_stretches(width: int, gram: int):
    digest_of = digest64
    schema = pa.schema([("tid", pa.binary()), ("anchor", pa.int64()), ("digest", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("m", pa.int32())])

    def run(batches):
        for batch in batches:
            copies: dict[bytes, list] = {}
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                copies.setdefault(tid, [text, 0])[1] += 1
            tids, columns, held = [], ([], [], [], [], []), 0
            for tid, (text, m) in copies.items():
                words = text.split()
                if len(words) < width:
                    continue
                anchors, lo, n, own = stretches(words, width, gram)
                digests = [digest_of(b" ".join(words[s : s + k + width - 1])) for s, k in zip(lo.tolist(), n.tolist(), strict=True)]
                a, k = runs(own)  # rows without a minimiser: windows already known to be repeated
                tids += [tid] * (len(lo) + len(a))
                held += len(lo) + len(a)
                null = np.zeros(len(a), np.int64)
                for column, new in zip(columns, (np.concatenate([anchors.view(np.int64), null]), np.concatenate([np.array(digests, np.uint64).view(np.int64), null]), np.concatenate([lo, a]), np.concatenate([n, k]), np.concatenate([np.full(len(lo), min(m, 2)), null])), strict=True):
                    column.append(new)
                if held > 1 << 17:
                    yield finish(tids, columns)
                    tids, columns, held = [], ([], [], [], [], []), 0
            if held:
                yield finish(tids, columns)

    def finish(tids, columns):
        anchor, digest, lo, n, m = map(np.concatenate, columns)
        return pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(anchor, mask=m == 0), pa.array(digest), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(m.astype(np.int32))], schema=schema)

    return run


EDGE = "a long, b long, tid binary, lo int, w int"


def _emit_edges(width: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tid", pa.binary()), ("lo", pa.int32()), ("w", pa.int32())])

    def run(batches):
        last = None  # copies of a text mostly lie side by side; further ones do no harm, they are repeats
        for batch in batches:
            columns, digests = ([], [], []), []
            for tid, text, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tid == last:
                    continue
                last, words = tid, text.split()
                for r in rows:
                    found: dict[bytes, list[int]] = {}
                    for s in range(r["lo"], r["lo"] + r["n"]):
                        found.setdefault(b" ".join(words[s : s + width]), []).append(s)
                    for window, at in found.items():  # repeats inside the text are known: one row says so, however many there are
                        digests.append(sha256(window).digest()[:16])
                        for column, value in zip(columns, (tid, at[0], min(2, r["w"] + len(at) - 1)), strict=True):
                            column.append(value)
                if len(digests) > 1 << 17:
                    yield finish(columns, digests)
                    columns, digests = ([], [], []), []
            if digests:
                yield finish(columns, digests)

    def finish(columns, digests):
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *(pa.array(c, t) for c, t in zip(columns, schema.types[2:], strict=True))], schema=schema)

    return run


def _emit_words(width: int, single: bool):
    """(head_a, head_b, n, words) of every span of a text; single: (words, tid, lo, w) of every window of the spans."""

    def run(batches):
        last = None
        for batch in batches:
            out, held = [], 0
            for tid, text, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tid == last:
                    continue
                last, words = tid, text.split()
                for r in rows:
                    if single:
                        out += [(b" ".join(words[s : s + width]), tid, s, r["w"]) for s in range(r["lo"], r["lo"] + r["n"])]
                    else:
                        out.append((r["head_a"], r["head_b"], r["n"], b" ".join(words[r["lo"] : r["lo"] + r["n"] + width - 1])))
                    held += r["n"] * (width if single else 1) * 8
                    if held > 16 << 20:
                        yield finish(out)
                        out, held = [], 0
            if out:
                yield finish(out)

    types = [pa.binary(), pa.binary(), pa.int32(), pa.int32()] if single else [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["words", "tid", "lo", "w"] if single else ["head_a", "head_b", "n", "words"]

    def finish(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)

    return run


def covered(n_words: int, windows: list, width: int) -> np.ndarray:
    """Which words lie in one of the windows lo .. lo + n - 1 of any (lo, n)."""
    step = np.zeros(n_words + 1, np.int64)
    if windows:
        a = np.array([(x["lo"], x["n"]) for x in windows], np.int64)
        np.add.at(step, a[:, 0], 1)
        np.add.at(step, a[:, 0] + a[:, 1] + width - 1, -1)
    return np.cumsum(step[:-1]) > 0


KEY = ["key_a", "key_b"]
HEAD = ["head_a", "head_b", "n"]


def on_anchor(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Stretches of minimisers met more than once; `paths` is stored, so that Spark may split a minimiser of boilerplate."""
    return rows.join(paths, "anchor")


def nonbranching(pieces: DataFrame) -> DataFrame:
    """Keys of pieces that only go on what one other piece begins: (key_a, key_b).

    pieces: (tid, lo, n, key_a, key_b), places in a text not overlapping.  Between a piece and the one right behind
    it lies a node.  It is nonbranching if the first has one successor everywhere and the second one predecessor
    everywhere; the end of a repeat counts as a successor of its own.
    """
    w = Window.partitionBy("tid").orderBy("lo")
    key = F.struct(*KEY)
    after = F.when(F.lead("lo").over(w) == F.col("lo") + F.col("n"), F.lead(key).over(w))
    before = F.when(F.lag(F.col("lo") + F.col("n")).over(w) == F.col("lo"), F.lag(key).over(w))
    around = pieces.select(*KEY, after.alias("after"), before.alias("before"))
    one = lambda c: F.when(F.every(F.col(c).isNotNull()) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    nodes = around.groupBy(*KEY).agg(one("after"), one("before"))
    firsts = nodes.where("after IS NOT NULL").select(F.col("key_a").alias("from_a"), F.col("key_b").alias("from_b"), F.col("after.key_a").alias("key_a"), F.col("after.key_b").alias("key_b"))
    seconds = nodes.where("before IS NOT NULL").select(*KEY, F.col("before.key_a").alias("from_a"), F.col("before.key_b").alias("from_b"))
    return seconds.join(firsts, [*KEY, "from_a", "from_b"]).select(*KEY)


def compacted(pieces: DataFrame, inner: DataFrame) -> DataFrame:
    """(tid, lo, n, head_a, head_b, w, anchors): each text's paths; `inner` (stored) names the pieces that go on a path."""
    marked = pieces.join(inner.withColumn("goes_on", F.lit(True)), KEY, "left")
    w = Window.partitionBy("tid").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("path", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w))
    head = F.min_by(F.struct(*KEY), "lo")
    paths = marked.groupBy("tid", "path").agg(F.min("lo").alias("lo"), F.sum("n").cast("int").alias("n"), head.alias("h"), F.max("w").alias("w"), F.collect_list("key_a").alias("anchors"))
    return paths.select("tid", "lo", "n", F.col("h.key_a").alias("head_a"), F.col("h.key_b").alias("head_b"), "w", "anchors")


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """(tid, windows): for each distinct text that has any, the windows whose words also start elsewhere, as array<struct<lo, n>>.

    tid is half the text's SHA-256; lo counts words from 0, n is a number of consecutive windows.  Tables between
    the steps are staged and dropped as soon as the next one is written.
    """
    spark, staged = docs.sparkSession, {}
    texts = docs.select(text_id(F.coalesce(common.quoted(text_col), F.lit(""))).alias("tid"), F.coalesce(common.quoted(text_col), F.lit("")).cast("binary").alias("text"))

    def keep(name: str, df: DataFrame) -> DataFrame:
        df, staged[name] = common.stage(df, f"repeats-{name}")
        return df

    def forget(*names: str) -> None:
        for name in names:
            common.drop(spark, staged.pop(name))

    def with_text(spans: DataFrame, *columns: str) -> DataFrame:
        """(tid, text, rows): each text that has spans, with them; a text's spans are no more than its words."""
        rows = keep("wanted", spans.groupBy("tid").agg(F.collect_list(F.struct(*columns)).alias("rows")))
        return texts.join(rows, "tid").select("tid", "text", "rows")

    # candidates
    rows = keep("stretches", texts.mapInArrow(_emit_stretches(width, min(gram, width)), STRETCH))
    paths = rows.where("anchor IS NOT NULL").groupBy("anchor").agg(F.sum("m").alias("met"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    paths = keep("anchors", paths.where("met > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike")))
    own = keep("own", rows.where("anchor IS NULL").select("tid", "lo", "n"))
    met = keep("met", on_anchor(rows, paths).groupBy("tid", "lo", "n", "anchor", "digest", "alike").agg(F.least(F.sum("m"), F.lit(2)).cast("int").alias("w")))
    forget("stretches", "anchors")
    branching = met.where("NOT alike")
    distinct = keep("distinct", branching.groupBy("anchor", "digest").agg(F.sum("w").alias("met"), F.min(F.struct("tid", "lo", "n")).alias("at")))
    spans = distinct.select("at.tid", "at.lo", "at.n", F.least("met", F.lit(2)).cast("int").alias("w"))
    edges = keep("edges", with_text(spans, "lo", "n", "w").mapInArrow(_emit_edges(width), EDGE))
    forget("wanted")
    twice = keep("twice", edges.groupBy("a", "b").agg(F.sum("w").alias("met")).where("met > 1").select("a", "b"))
    again = branching.join(distinct.where("met > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
    whole = met.where("alike").unionByName(again)
    pieces = keep("pieces", whole.select("tid", "lo", "n", F.col("anchor").alias("key_a"), F.col("digest").alias("key_b"), "w"))
    single = keep("single", edges.where("w = 1").join(twice, ["a", "b"], "left_semi").select("tid", "lo", F.lit(1).alias("n")))
    forget("edges", "twice", "distinct")
    # compaction
    inner = keep("inner", nonbranching(pieces))
    spans = keep("spans", compacted(pieces, inner))
    forget("pieces", "inner")
    # verification
    held = spans.groupBy(*HEAD).agg(F.count(F.lit(1)).alias("places"), F.sum("w").alias("copies"))
    held = keep("held", held)
    shared = spans.join(held.where("places > 1").select(*HEAD), HEAD, "left_semi")
    read = with_text(shared, "lo", *HEAD).mapInArrow(_emit_words(width, False), "head_a long, head_b long, n int, words binary")
    unlike = read.groupBy(*HEAD).agg((F.min("words") == F.max("words")).alias("equal")).where("NOT equal").select(*HEAD)
    wrong = keep("wrong", unlike.unionByName(held.where("places = 1 AND copies = 1").select(*HEAD)))
    forget("wanted", "held")
    known = own.unionByName(single)
    found = known.unionByName(spans.select("tid", "lo", "n"))
    if not wrong.isEmpty():  # words differ behind equal digests
        found = known.unionByName(spans.join(wrong, HEAD, "left_anti").select("tid", "lo", "n")).unionByName(_by_words(met, spans, wrong, with_text, width, keep))
    out = found.distinct().groupBy("tid").agg(F.collect_list(F.struct("lo", "n")).alias("windows"))
    out, _ = common.stage(out, "repeats")
    for name in list(staged):
        forget(name)
    return out


def _by_words(met: DataFrame, spans: DataFrame, wrong: DataFrame, with_text, width: int, keep) -> DataFrame:
    """(tid, lo, n) of repeated windows of the minimisers that occur in wrong paths, grouped by their words."""
    anchors = spans.join(wrong, HEAD, "left_semi").select(F.explode("anchors").alias("anchor")).distinct()
    windows = with_text(met.join(anchors, "anchor", "left_semi"), "lo", "n", "w").mapInArrow(_emit_words(width, True), "words binary, tid binary, lo int, w int")
    windows = keep("windows", windows.distinct())
    twice = keep("words", windows.groupBy("words").agg(F.sum("w").alias("met")).where("met > 1").select("words"))
    return windows.join(twice, "words", "left_semi").select("tid", "lo", F.lit(1).alias("n"))


def text_id(text: F.Column) -> F.Column:
    """Half the SHA-256 of a text: texts that share it are taken for copies."""
    return F.unhex(F.left(F.sha2(text.cast("binary"), 256), F.lit(32)))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, kept): removed word spans [start, end) and the words that stay, joined by one space.

    Words are separated by ASCII white space.  Every copy of a repeated window goes, the first too.
    Null, empty and shorter texts lose nothing; repeated rows are copies of each other; a null id stays
    null; an empty table gives no rows; other columns are ignored.
    """
    windows = repeated_windows(docs, width, gram, text_col)
    texts = common.text_rows(docs, id_col, text_col).withColumn("tid", text_id(F.col("text")))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            counts, spans, kept = [], [], []
            for text, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                a, k = runs(covered(len(words), rows, width))
                counts.append(len(words))
                spans.append([{"start": s, "end": s + n} for s, n in zip(a.tolist(), k.tolist(), strict=True)])
                at, left = 0, []
                for s in spans[-1]:
                    left += words[at : s["start"]]
                    at = s["end"]
                kept.append(b" ".join(left + words[at:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, schema.field(2).type), pa.array(kept, pa.binary())], schema=schema)

    joined = texts.join(windows, "tid", "left").select("doc_id", "text", "windows")
    return joined.mapInArrow(run, "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept binary")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP9 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
hot AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + j AS p FROM win JOIN hot USING (g), unnest(range(0, 35)) AS u(j)),
kept AS (SELECT d.r, count(*) AS n, string_agg(d.w[p], ' ' ORDER BY p) AS t
         FROM d, unnest(range(1, len(w) + 1)) AS u(p) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = d.r AND gone.p = u.p) GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
