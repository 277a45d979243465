"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Pass 1 turns texts into ids and stages them as 16-bit integers; pass 2 counts ids over the whole
corpus; pass 3 range-partitions the staged ids by document id and writes segments of bounded size.  Reading
is table driven: blocks of a fixed number of ids start at recorded bit offsets, so all blocks wanted of a
segment are decoded side by side, and documents are reached without decoding those before them.

Files are Parquet with one row a segment: its place (range partition, ids before it there), first and last document
id, numbers of documents and ids, and the segment's bytes, which stay as they are.  The index columns are read
without the bytes; a file may hold any number of segments and is read by row group.

Segment (little-endian):
  magic "TSHUF01\\n" | header: payload bytes, documents, ids, blocks, ids a block, vocabulary, code limit,
  bytes of packed lengths (8 x u64) | code lengths (u8 each, zlib) | doc ids i64 | doc id is null u8 |
  ids of each document u64 | first bit of each block u64 | payload (codes, high bit first, 8 bytes pad)
  | crc32 of all that u32
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.tokens import binary_column, default_vocabulary, encoder

MAGIC = b"TSHUF01\n"
HEADER = struct.Struct("<8Q")
LIMIT = 18
BLOCK = 128
SEGMENT_IDS = 500_000
#: Rows of a segment are written to files in row groups of about this many bytes.
ROW_GROUP = 16 << 20
MOST_PARTS = 1_000_000  # one row a range partition is broadcast up to here: 16 MB
SEGMENT = "part int, before long, first_doc long, last_doc long, n_docs long, n_ids long, segment binary"


# -- codes ---------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    level, leaves = weight, []
    is_leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        leaves.append(is_leaf)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        level, is_leaf = both[by], by < n
    leaves.append(is_leaf)
    take, lengths = 2 * n - 2, np.zeros(n, np.uint8)
    for is_leaf in reversed(leaves):
        got = int(is_leaf[:take].sum())
        lengths[:got] += 1
        take = 2 * (take - got)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(code of each id, decoding table): codes ascend by (length, id); the table maps `limit` bits to id << 5 | length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.int64)
    span = np.int64(1) << (limit - size)
    first = np.cumsum(span) - span
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (first >> (limit - size)).astype(np.uint64)
    table = np.zeros(1 << limit, np.uint32)
    filled = np.repeat((order << 5 | size).astype(np.uint32), span)
    table[: len(filled)] = filled
    return codes, table


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(big-endian bytes, number of bits, first bit of each id)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    bits = int(ends[-1]) if len(ids) else 0
    words = np.zeros(bits // 64 + 2, np.uint64)
    if len(ids):
        code, word = codes[ids], at >> 6
        room = 64 - (at & 63) - size
        fits = room >= 0
        own = np.where(fits, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[heads]] = np.add.reduceat(own, heads)
        over = np.flatnonzero(~fits)
        words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words.byteswap().view(np.uint8)[: (bits + 7) // 8], bits, at


def block_counts(sizes: np.ndarray, block: int) -> np.ndarray:
    """Ids in each block: a document's blocks are full but for its last."""
    n = -(-sizes // block)
    out = np.full(int(n.sum()), block, np.int64)
    ends = np.cumsum(n)
    has = n > 0
    out[ends[has] - 1] = sizes[has] - (n[has] - 1) * block
    return out


def decode_blocks(payload: np.ndarray, firsts: np.ndarray, counts: np.ndarray, table: np.ndarray, limit: int) -> np.ndarray:
    """Decode all blocks in step: one table look-up a block and step; counts: ids in each block."""
    if not len(counts):
        return np.zeros(0, np.uint32)
    steps = int(counts.max())
    b = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    most = len(window) - 1
    out = np.empty((steps, len(firsts)), np.uint32)
    p, mask = firsts.astype(np.int64), np.uint32((1 << limit) - 1)
    for t in range(steps):
        entry = table[window[np.minimum(p >> 3, most)] >> (32 - limit - (p & 7)).astype(np.uint32) & mask]
        out[t] = entry >> 5
        p += entry & 31
    return out.T[np.arange(steps) < counts[:, None]]


# -- segments ------------------------------------------------------------------------------------


def write_segment(doc_ids: list, sizes: list[int], firsts: np.ndarray, payload: np.ndarray, lengths: np.ndarray, block: int, limit: int) -> bytes:
    packed = zlib.compress(lengths.tobytes(), 6)
    body = b"".join((
        MAGIC, HEADER.pack(len(payload), len(doc_ids), sum(sizes), len(firsts), block, len(lengths), limit, len(packed)), packed,
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(sizes, "<u8").tobytes(), firsts.astype("<u8").tobytes(), payload.tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


def read_segment(content: bytes, tables: dict, wanted=None):
    """(doc ids, number of ids of each, first id of each in the segment, ids in a row) of a segment, after checking its crc.

    tables keeps the last decoding table.  wanted: a function from the array of doc ids to a mask; only the
    blocks of the documents it picks are decoded.
    """
    if content[:8] != MAGIC:
        raise ValueError("not a token segment")
    n_bytes, n_docs, n_ids, n_blocks, block, vocab, limit, n_packed = HEADER.unpack_from(content, 8)
    at = 8 + HEADER.size
    packed = content[at : at + n_packed]
    at += n_packed
    docs = np.frombuffer(content, "<i8", n_docs, at)
    null = np.frombuffer(content, "u1", n_docs, at + 8 * n_docs)
    sizes = np.frombuffer(content, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    firsts = np.frombuffer(content, "<u8", n_blocks, at)
    at += 8 * n_blocks
    payload = np.frombuffer(content, "u1", n_bytes, at)
    at += n_bytes
    if len(content) != at + 4 or zlib.crc32(memoryview(content)[:at]) != struct.unpack_from("<I", content, at)[0]:
        raise ValueError("token segment is damaged")
    if packed not in tables:
        tables.clear()
        tables[packed] = canonical(np.frombuffer(zlib.decompress(packed), np.uint8), limit)[1]
    starts, counts = np.cumsum(sizes) - sizes, block_counts(sizes, block)
    if wanted is not None:
        mask = wanted(docs) & (null == 0)
        keep = np.repeat(mask, -(-sizes // block))
        docs, null, sizes, starts, firsts, counts = docs[mask], null[mask], sizes[mask], starts[mask], firsts[keep], counts[keep]
    ids = decode_blocks(payload, firsts, counts, tables[packed], limit)
    return [None if z else int(d) for d, z in zip(docs, null, strict=True)], sizes, starts, ids


# -- Spark ---------------------------------------------------------------------------------------


def tokenize(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids as little-endian u16) of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for at, to, ids, n in encoder(vocabulary, "<u2").slices(batch.column(1), end_id):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), binary_column(ids, n)], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of each row) of a binary column, without a copy of each row."""
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return raw.view("<u2"), np.diff(offsets).astype(np.int64) // 2


def count_ids(ids: DataFrame) -> np.ndarray:
    """Global counts of ids; one row per id and task is shuffled, one per id of the vocabulary comes back."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(flat_ids(batch.column(0))[0], minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 + int(rows["id"].max()) if len(rows) else 1, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def encode_segment(doc_ids: list, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int, limit: int) -> bytes:
    """A segment of whole documents: one run of bits, in which every document starts a new block."""
    payload, _, at = encode_bits(ids, lengths, codes)
    counts = block_counts(sizes, block)
    return write_segment(doc_ids, sizes.tolist(), at[np.cumsum(counts) - counts], payload, lengths, block, limit)


def write_token_files(docs: DataFrame, out_dir: str, vocabulary: str | None = None, end_id: int = 1, block: int = BLOCK, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each followed by end_id, in ascending id order (nulls first) under out_dir.

    Null text: the end id alone.  Repeated ids lie side by side, in order of a hash of their ids, by which an id of
    very many rows is spread over partitions.  An empty table writes no segment.  Other columns are
    ignored.  The vocabulary must have fewer than 65,536 ids.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    ids, staged = common.stage(tokenize(common.text_rows(docs, id_col, text_col, "string"), path, end_id), "token-ids")
    try:
        lengths_cast = spark.sparkContext.broadcast(code_lengths(count_ids(ids), limit))  # bounded by the vocabulary

        def run(batches):
            lengths, part = lengths_cast.value, TaskContext.get().partitionId()
            codes, _ = canonical(lengths, limit)
            docs, parts, sizes, total, done = [], [], [], 0, 0

            def row():
                content = encode_segment(docs, np.concatenate(parts), np.concatenate(sizes), lengths, codes, block, limit)
                return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in (done, docs[0], docs[-1], len(docs), total)), pa.array([content], pa.binary())], names=names).add_column(0, "part", pa.array([part], pa.int32()))

            names = ["before", "first_doc", "last_doc", "n_docs", "n_ids", "segment"]
            for batch in batches:
                flat, n = flat_ids(batch.column(1))
                ends, at = np.cumsum(n), 0
                names_of = batch.column(0).to_pylist()
                while at < len(n):  # a segment ends with the document that fills it, wherever a batch ends
                    before = int(ends[at - 1]) if at else 0
                    to = min(len(n), int(np.searchsorted(ends, before + SEGMENT_IDS - total)) + 1)
                    docs += names_of[at:to]
                    parts.append(flat[before : int(ends[to - 1])].copy())
                    sizes.append(n[at:to])
                    total += int(ends[to - 1]) - before
                    at = to
                    if total >= SEGMENT_IDS:
                        yield row()
                        docs, parts, sizes, total, done = [], [], [], 0, done + total
            if docs:
                yield row()

        order = (F.col("doc_id").asc_nulls_first(), F.col("h"))
        ranged = ids.withColumn("h", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order)
        out = ranged.select("doc_id", "ids").mapInArrow(run, SEGMENT).write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false")
        out.option("parquet.block.size", ROW_GROUP).option("parquet.page.size.row.check.min", 4).parquet(out_dir)
    finally:
        common.drop(spark, staged)


def ids_ahead(index: DataFrame) -> DataFrame:
    """(part, ahead): ids in all earlier range partitions, from (part, before, n_ids) of segments; one row a partition."""
    totals = index.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))
    ahead = common.cut(totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead")))
    return F.broadcast(ahead) if ahead.count() <= MOST_PARTS else ahead


def read_token_files(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian u32, start counted over all files in document order.

    first and last bound the document ids wanted, both included (rows without an id are then left out): only segments
    that may hold some are read, and of these only the documents' own blocks are decoded.
    """
    rows = spark.read.schema(SEGMENT).parquet(path)
    ahead = ids_ahead(rows.select("part", "before", "n_ids"))
    bounded = first is not None or last is not None
    low, high = -(1 << 63) if first is None else first, (1 << 63) - 1 if last is None else last
    if bounded:
        rows = rows.where((F.col("last_doc") >= low) & (F.coalesce("first_doc", F.lit(-(1 << 63))) <= high))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        tables = {}
        for batch in batches:
            for i in range(batch.num_rows):
                docs, sizes, starts, ids = read_segment(batch.column(1)[i].as_py(), tables, (lambda d: (d >= low) & (d <= high)) if bounded else None)
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + batch.column(0)[i].as_py()), pa.array(sizes), binary_column(ids.astype("<u4"), sizes)], schema=schema)

    placed = rows.select("part", "before", "segment").join(ahead, "part")
    return placed.select((F.col("before") + F.col("ahead")).alias("base"), "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.shared_path(spark, "token-files")
    write_token_files(common.read(spark, sf_dir, "documents"), out)
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
